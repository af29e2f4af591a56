"""Area centres and radius counts without comparing every centre with every point."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions.dates import Span
from footmark.functions.geo import haversine_km
from footmark.session import checkpointed

#: Distinct points of a crowded cell that a task takes on.
SALT_ROWS = 4096
KM_PER_DEGREE = 111.19508

# Display names of known areas.
AREA_ALIASES = {
    ("Philadelphia", "19103"): "Rittenhouse",
    ("Philadelphia", "19104"): "University City",
    ("Philadelphia", "19106"): "Old City",
    ("Philadelphia", "19107"): "Washington Square West",
    ("Philadelphia", "19123"): "Northern Liberties",
    ("Philadelphia", "19147"): "Queen Village",
}


def area_name(city: str, postal_code: str) -> Column:
    named = F.concat(F.lit("ZIP "), F.col(postal_code))
    for (c, z), alias in AREA_ALIASES.items():
        named = F.when((F.col(city) == c) & (F.col(postal_code) == z), alias).otherwise(named)
    return named


def area_centres(businesses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of members' valid coordinates per area; unassigned listings have no area."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return businesses.where(F.col("area_id").isNotNull()).groupBy(*keys).agg(
        F.avg(F.when(located, F.col("latitude"))).alias("latitude"),
        F.avg(F.when(located, F.col("longitude"))).alias("longitude"))


def within_radius(
    centres: DataFrame, points: DataFrame, keys: Sequence[str], scope: Sequence[str],
    radius_km: float, carry: Sequence[str] = (),
) -> DataFrame:
    """Number of points within the radius of each centre, optionally split by carried columns.

    Points are reduced to grid cells of a quarter radius. Cells wholly inside the circle
    contribute their count; only cells on its rim are joined point by point, after equal
    coordinates collapsed to one row. A cell with more than ``SALT_ROWS`` rows is dealt out to as many
    tasks as its count asks for; others are left whole. Centres without coordinates are absent from the result.
    """
    cells = max(1, math.ceil(360.0 * KM_PER_DEGREE / max(radius_km, 1e-3) * 4))
    step = 360.0 / cells
    row = lambda lat: F.floor((lat + F.lit(90.0)) / F.lit(step))
    col = lambda lon: F.floor((lon + F.lit(180.0)) / F.lit(step))
    exact = (
        points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy(*scope, *carry, "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"_row": row(F.col("latitude")), "_col": F.pmod(
            col(F.col("longitude")), F.lit(cells))})
    )
    whole = exact.groupBy(*scope, *carry, "_row", "_col").agg(F.sum("n").alias("n"))

    lat, lon = F.col("_clat"), F.col("_clon")
    reach = F.lit(radius_km / KM_PER_DEGREE * 1.001)
    widest = F.least(F.lit(180.0), reach / F.greatest(
        F.lit(1e-6), F.cos(F.radians(F.least(F.lit(89.9), F.abs(lat) + reach)))))
    near = (
        centres.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select(*keys, F.col("latitude").alias("_clat"), F.col("longitude").alias("_clon"))
        .withColumn("_row", F.explode(F.sequence(row(lat - reach), row(lat + reach))))
        .withColumn("_c", F.explode(F.sequence(
            col(lon - widest), F.least(col(lon + widest), col(lon - widest) + cells - 1))))
    )
    south, west = F.col("_row") * F.lit(step) - 90.0, F.col("_c") * F.lit(step) - 180.0
    corners = [haversine_km(lat, lon, a, b)
               for a in (south, south + F.lit(step)) for b in (west, west + F.lit(step))]
    near = near.select(
        *keys, "_clat", "_clon", "_row", F.pmod("_c", F.lit(cells)).alias("_col"),
        ((F.greatest(*corners) <= radius_km * 0.999) & (F.abs(lat) < 75)).alias("_inside"))

    on = [*scope, "_row", "_col"]
    inner = near.where("_inside").join(whole, on).select(*keys, *carry, "n")
    salts = crowded_cells(exact, on)
    salted = exact.join(salts, on, "left").withColumn("_salt", F.pmod(
        F.xxhash64("latitude", "longitude", *carry), F.coalesce("_salts", F.lit(1)).cast("long"))).drop("_salts")
    rim = (
        near.where(~F.col("_inside")).join(salts, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1)))
        .drop("_salts").join(salted, [*on, "_salt"])
        .where(haversine_km(lat, lon, F.col("latitude"), F.col("longitude")) <= radius_km)
        .select(*keys, *carry, "n")
    )
    return inner.unionByName(rim).groupBy(*keys, *carry).agg(F.sum("n").alias("n"))


def crowded_cells(rows: DataFrame, cell: Sequence[str]) -> DataFrame:
    """(cell, _salts) of the cells with more than ``SALT_ROWS`` rows: how many tasks share each of them."""
    return rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("_salts")).where("_salts > 1")


def nearest(points: DataFrame, sites: DataFrame, site: str) -> DataFrame:
    """(latitude, longitude, site, km): the nearest site of every distinct coordinate, the smallest name of equals.

    Rings of grid cells: a coordinate is compared with the sites of its own and the eight cells around it, and
    it is settled if the best of them is no farther than the border of that block, beyond which no other site
    can be nearer. What is left goes on with cells four times as wide, at last with all sites. The first cells
    hold about one site each. Coordinates without any site and sites without coordinates are left out.
    """
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    at = sites.where(located).select(F.col(site).alias("_site"), F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"))
    box = at.agg(F.count(F.lit(1)).alias("n"), (F.max("_slat") - F.min("_slat")).alias("h"), (F.max("_slon") - F.min("_slon")).alias("w")).first()
    rest = points.where(located).select("latitude", "longitude").distinct()
    if not box["n"]:
        return rest.where(F.lit(False)).select("*", F.lit(None).cast(sites.schema[site].dataType).alias(site), F.lit(0.0).alias("km"))
    step, parts = min(30.0, max(1e-3, math.sqrt(max(box["h"], 1e-3) * max(box["w"], 1e-3) / box["n"]))), []
    while True:
        rest, whole = checkpointed(rest), step >= 60.0
        cells = 1 if whole else math.floor(360.0 / step)
        width = 360.0 / cells
        row = lambda c: F.lit(0) if whole else F.floor((F.col(c) + F.lit(90.0)) / F.lit(step)).cast("int")
        col = lambda c: F.lit(0) if whole else F.pmod(
            F.floor((F.col(c) + F.lit(180.0)) / F.lit(width)).cast("int"), F.lit(cells))
        around = lambda c: F.explode(F.array(F.lit(0)) if whole else F.array(c - 1, c, c + 1))
        block = rest.withColumn("_row", around(row("latitude"))).withColumn("_c", around(col("longitude"))).withColumn(
            "_col", F.pmod("_c", F.lit(cells))).drop("_c").distinct()
        placed = at.withColumns({"_row": row("_slat"), "_col": col("_slon")})
        km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_slat"), F.col("_slon"))
        best = block.join(placed, ["_row", "_col"]).groupBy("latitude", "longitude").agg(
            F.min(F.struct(km.alias("km"), F.col("_site").alias("site"))).alias("best"))
        # To leave the block one must cross a whole cell: so many degrees of latitude, or of longitude at one's own latitude.
        along = F.asin(F.cos(F.radians("latitude")) * F.lit(math.sin(math.radians(min(width, 90.0))))) * F.lit(math.degrees(1) * KM_PER_DEGREE)
        border = F.least(F.lit(step * KM_PER_DEGREE), along) * F.lit(0.999)
        judged = checkpointed(rest.join(best, ["latitude", "longitude"], "left").withColumn(
            "_done", F.lit(whole) | F.coalesce(F.col("best.km") <= border, F.lit(False))))
        parts.append(judged.where("_done").select("latitude", "longitude", F.col("best.site").alias(site), F.col("best.km").alias("km")))
        rest = judged.where("NOT _done").select("latitude", "longitude")
        if whole or rest.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        step *= 4


def area_summaries(
    businesses: DataFrame, counts: DataFrame, centres: DataFrame, scope: Sequence[str],
    span: Span, coverage: Span, radius_km: float, min_businesses: int = 5,
) -> DataFrame:
    """ZIP membership, weekly rate, ratings, nearby listings, weather match and YoY.

    ``counts`` has current and previous totals per scope and area. The radius changes only the
    nearby count. YoY needs both windows wholly covered and prior activity.
    """
    keys = [*scope, "area_id"]
    covered = span.intersect(coverage)
    days = covered.days if covered else 0
    back = span.previous_year()
    full = coverage.contains(span) and coverage.contains(back)
    members = businesses.where(F.col("area_id").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("businesses"), F.avg("stars").alias("mean_rating"),
        F.count("stars").alias("rated_businesses"),
        F.coalesce(F.sum(F.when(F.col("stars").isNotNull(), F.col("review_count"))), F.lit(0))
        .alias("rated_reviews"),
        (F.count("station_id") / F.count(F.lit(1))).alias("weather_match_rate"),
    ).where(F.col("businesses") >= min_businesses)
    area_keys = [k for k in centres.columns if k not in ("latitude", "longitude")]
    wanted = members.select(*keys).join(centres, area_keys)
    nearby = within_radius(wanted, businesses, keys, scope, radius_km).withColumnRenamed(
        "n", "nearby")
    n = lambda c: F.coalesce(c, F.lit(0))
    current, previous = n("current"), n("previous")
    yoy = ((current / F.lit(max(days, 1))) / (previous / F.lit(back.days)) - 1) * 100
    return (
        members.join(counts, keys, "left").join(nearby, keys, "left")
        .select(
            *keys, "businesses", current.alias("checkins"),
            (current * 7 / F.lit(days) if days else F.lit(0.0)).alias("weekly_checkins"),
            "mean_rating", "rated_businesses", "rated_reviews", n("nearby").alias("nearby"),
            "weather_match_rate",
            F.when(F.lit(full and days > 0) & (previous > 0), yoy).alias("yoy_percent"))
    )


def attach_boundaries(areas: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Areas with their valid geometry; areas without one keep a null geometry for counting."""
    return areas.join(boundaries.select("postal_code", "polygons"), "postal_code", "left")
