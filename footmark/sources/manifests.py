"""Acquisition manifests: what they promise, checked rule by rule, and their days against the days that came.

Days are kept as bitmaps: one bit a day in buckets of fixed size for each station and variable, built and merged
by Spark's own aggregates. Missing, extra and doubled days then follow from three bit counts in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footmark.sources import files

# Units of the three variables of a station source.
UNITS = {"tmax": "degreeF", "tmin": "degreeF", "pcpn": "inch"}
ID = "^[A-Z0-9]{11}$"
NATIVE_SUFFIX = " 6"


def _extended(base: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*base.fields, *[T.StructField(n, t) for n, t in more.items()]])


_STATION = _extended(files.STATION_MANIFEST["stations"].dataType.elementType, sids=T.ArrayType(T.StringType()))
_SCOPE = _extended(files.STATION_MANIFEST["scope"].dataType, geographic_support=T.StringType(),
                   station_ids=T.ArrayType(T.StringType()))
_KEPT = [f for f in files.STATION_MANIFEST.fields if f.name not in ("scope", "stations")]
#: A station manifest in full, with the digests of its files and the number of stations that its scope counts.
MANIFEST = T.StructType([
    *_KEPT, T.StructField("scope", _SCOPE), T.StructField("stations", T.ArrayType(_STATION)),
    T.StructField("variables", T.ArrayType(T.StructType([
        T.StructField("variable", T.StringType()), T.StructField("unit", T.StringType())]))),
    T.StructField("observations_digest", T.StringType()), T.StructField("mapping_digest", T.StringType()),
    T.StructField("scope_stations", T.LongType()),
])


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests, one JSON document a row; unreadable ones fail the job."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def rules(observations: str, mapping: str) -> dict[str, Column]:
    """What makes a manifest unusable, by name; a condition that is unknown counts as broken.

    ``observations`` and ``mapping`` are the digests of the files that came. The stations of a manifest lie in
    one array, as they do in its document.
    """
    days = F.datediff("scope.end", "scope.start").cast("long") + 1
    ids, stations, units = F.col("scope.station_ids"), F.col("stations"), F.col("variables")
    named = F.transform(stations, lambda s: s["station_id"])
    every = lambda good: F.forall(stations, good)

    def audited(s: Column) -> Column:
        return F.forall(F.map_values(s["coverage"]), lambda c: (c["requested_days"] == days) & (c["observed_days"] >= 0)
                        & (c["missing_days"] >= 0) & (c["observed_days"] + c["missing_days"] == days))

    good = {
        "version or status": (F.col("schema_version") == 1) & (F.col("status") == "complete"),
        "observations digest": F.col("observations_digest") == observations,
        "mapping digest": F.col("mapping_digest") == mapping,
        "days": (days > 0) & (F.col("scope.days") == days),
        "frequency": F.col("scope.frequency") == "daily",
        "support": F.col("scope.geographic_support") == "station",
        "units": (F.size(units) == len(UNITS)) & (F.array_sort(F.transform(
            units, lambda v: F.concat_ws("=", v["variable"], v["unit"]))) == F.array(
            *[F.lit(f"{v}={u}") for v, u in sorted(UNITS.items())])),
        "station ids": (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)),
        "id form": F.forall(ids, lambda i: i.rlike(ID)),
        "repeated or unlisted station": (F.size(F.array_distinct(named)) == F.size(named))
        & (F.size(F.array_except(named, ids)) == 0),
        "absent station": F.size(F.array_except(ids, named)) == 0,
        "station rows": every(lambda s: s["rows"] == days * len(UNITS)),
        "station name": every(lambda s: F.length(F.trim(s["name"])) > 0),
        "native id": every(lambda s: F.array_contains(s["sids"], F.concat(s["station_id"], F.lit(NATIVE_SUFFIX)))),
        "coordinates": every(lambda s: s["latitude"].between(-90, 90) & s["longitude"].between(-180, 180)),
        "variables": every(lambda s: F.array_sort(F.map_keys(s["coverage"])) == F.array(*map(F.lit, sorted(UNITS)))),
        "day counts": every(audited),
        "rows": F.col("rows") == F.size(stations) * days * len(UNITS),
        "scope stations": F.col("scope_stations") == F.size(stations),
    }
    return {name: ~F.coalesce(c, F.lit(False)) for name, c in good.items()}


def problems(rows: DataFrame, observations: str, mapping: str) -> DataFrame:
    """The manifests with ``problems``: the names of the rules that each of them breaks, in the rules' order."""
    broken = [F.when(c, F.lit(name)) for name, c in rules(observations, mapping).items()]
    return rows.withColumn("problems", F.array_compact(F.array(*broken)))


# ---- days as bitmaps ----------------------------------------------------------------------


def day_bitmaps(rows: DataFrame, keys: Sequence[str], start: date) -> DataFrame:
    """(keys, bucket, days, rows): the days from ``start`` on that a key has, as bits, and the rows that gave them."""
    number = (F.datediff("day", F.lit(start)) + 1).cast("long")
    return rows.where(F.col("day") >= F.lit(start)).groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("days"), F.count(F.lit(1)).alias("rows"))


def day_differences(listed: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, listed_days, found_days, missing_days, extra_days, doubled_rows) of two tables of day bitmaps.

    A day is missing if it is listed and not found, extra if found and not listed; rows beyond one a day are doubled.
    """
    bits = F.bitmap_count("days")
    side = listed.select(*keys, "bucket", "days", bits.alias("l"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("r"))
    other = found.select(*keys, "bucket", "days", F.lit(0).cast("long").alias("l"), bits.alias("f"), F.col("rows").alias("r"))
    merged = side.unionByName(other).groupBy(*keys, "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("days")).alias("all"), *[F.sum(c).alias(c) for c in "lfr"])
    total = lambda c: F.sum(c).cast("long")
    return merged.groupBy(*keys).agg(
        total("l").alias("listed_days"), total("f").alias("found_days"), total(F.col("all") - F.col("f")).alias("missing_days"),
        total(F.col("all") - F.col("l")).alias("extra_days"), total(F.col("r") - F.col("f")).alias("doubled_rows"))
