"""Business and category summaries, rankings and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions.dates import Span
from footmark.operators.ordering import exact_quantiles, rank_rows

# Ranking metrics.
BUSINESS_METRICS = (
    "Recorded check-ins", "Check-ins / day", "Rating (snapshot)", "Reviews (snapshot)",
)
CATEGORY_METRICS = (
    "Recorded check-ins", "Check-ins / day", "Check-ins / business / day", "Listed businesses",
)

# Curated co-tags by parent tag and facet.
FACETS = {
    "Restaurants": {
        "Cuisine": (
            "American (New)", "American (Traditional)", "Italian", "Chinese", "Mexican",
            "Japanese", "Thai", "Vietnamese", "Indian", "French", "Mediterranean", "Southern",
            "Cajun/Creole", "Caribbean", "Cuban",
        ),
        "Format / product": (
            "Pizza", "Sandwiches", "Fast Food", "Burgers", "Breakfast & Brunch",
            "Coffee & Tea", "Cafes", "Seafood", "Sushi Bars", "Bakeries", "Food Trucks", "Bars",
        ),
    },
    "Day Spas": {
        "Service": (
            "Massage", "Skin Care", "Nail Salons", "Hair Salons", "Hair Removal", "Waxing",
            "Massage Therapy", "Eyelash Service", "Medical Spas", "Reflexology",
            "Laser Hair Removal",
        ),
    },
}


def summaries(businesses: DataFrame, totals: DataFrame, span: Span) -> DataFrame:
    """Every listing with its totals; no recorded activity is 0, weekend share then null."""
    n = F.coalesce("checkins", F.lit(0))
    days = F.lit(span.days)
    return businesses.join(totals, "business_id", "left").select(
        *businesses.columns,
        n.alias("checkins"),
        F.coalesce("active_days", F.lit(0)).alias("active_days"),
        F.coalesce("weekend_checkins", F.lit(0)).alias("weekend_checkins"),
        (n * 7 / days).alias("weekly_checkins"),
        (n / days).alias("daily_checkins"),
        F.when(n > 0, F.col("weekend_checkins") / n).alias("weekend_share"),
    )


def _business_order(metric: str) -> list[Column]:
    if metric not in BUSINESS_METRICS:
        raise ValueError(f"Unknown business ranking metric: {metric}")
    value = {
        "Rating (snapshot)": F.col("stars").desc_nulls_last(),
        "Reviews (snapshot)": F.col("review_count").desc(),
    }.get(metric, F.col("checkins").desc())
    return [value, F.col("business_id").asc()]


def rank_businesses(rows: DataFrame, scope: Sequence[str], metric: str) -> DataFrame:
    return rank_rows(rows, scope, _business_order(metric), "rank")


def distinct_tags(businesses: DataFrame, scope: Sequence[str]) -> DataFrame:
    return businesses.select(*scope, F.explode("categories").alias("tag")).distinct()


def co_tags(businesses: DataFrame, scope: Sequence[str], parent: str = "parent") -> DataFrame:
    """Available co-tags with their facet; every tag also belongs to 'Source categories'.

    The curated facet lists are fixed literals, so the facet is a column expression.
    """
    facet = None
    for parent_tag, facets in FACETS.items():
        for name, tags in facets.items():
            hit = (F.col(parent) == parent_tag) & F.col("tag").isin(*tags)
            facet = F.when(hit, name) if facet is None else facet.when(hit, name)
    tags = distinct_tags(businesses, [*scope, parent] if parent not in scope else scope).where(
        F.col("tag") != F.col(parent))
    return tags.select(
        "*", F.explode(F.array_compact(F.array(F.lit("Source categories"), facet))).alias("facet")
    )


def category_summaries(rows: DataFrame, scope: Sequence[str], span: Span) -> DataFrame:
    """Each exact tag on its own; groups overlap and are never additive.

    Medians come from distributed order statistics: one tag may cover most listings.
    """
    tagged = rows.select(
        *scope, F.explode(F.array_distinct("categories")).alias("tag"), "checkins"
    )
    keys, days = [*scope, "tag"], F.lit(span.days)
    total, listed = F.sum("checkins"), F.count(F.lit(1))
    stats = tagged.groupBy(*keys).agg(
        listed.alias("businesses"),
        F.sum((F.col("checkins") > 0).cast("long")).alias("active_businesses"),
        total.alias("checkins"),
        (total * 7 / (days * listed)).alias("weekly_per_business"),
        (total / (days * listed)).alias("daily_per_business"),
        F.when(total > 0, F.max("checkins") / total).alias("top_share"),
    )
    medians = exact_quantiles(tagged, keys, "checkins", {"median_checkins": 0.5})
    return stats.join(medians, keys).withColumns({
        "median_weekly": F.col("median_checkins") * 7 / days,
        "median_daily": F.col("median_checkins") / days,
    }).drop("median_checkins")


def rank_categories(rows: DataFrame, scope: Sequence[str], metric: str) -> DataFrame:
    if metric not in CATEGORY_METRICS:
        raise ValueError(f"Unknown category ranking metric: {metric}")
    value = {"Listed businesses": "businesses",
             "Check-ins / business / day": "daily_per_business"}.get(metric, "checkins")
    return rank_rows(rows, scope, [F.col(value).desc(), F.col("tag").asc()], "rank")


def data_note(businesses: Column, checkins: Column) -> Column:
    return (
        F.when(businesses < 5, "Few businesses (<5)").when(checkins < 20, "Few check-ins (<20)")
        .otherwise("Descriptive comparison")
    )


def category_table(rows: DataFrame, scope: Sequence[str], minimum: int) -> DataFrame:
    """Ranked category table: groups below the minimum are removed after aggregation."""
    kept = rows.where(F.col("businesses") >= minimum)
    return rank_categories(kept, scope, "Recorded check-ins").select(
        *scope, "rank", "tag", "checkins", "businesses", "active_businesses",
        F.round(F.col("top_share") * 100, 1).alias("largest_share_pct"),
        data_note(F.col("businesses"), F.col("checkins")).alias("data_note"),
    )


def competitor_list(rows: DataFrame, scope: Sequence[str], covered: Span | None) -> DataFrame:
    """Listing table; without covered history activity is null and order is alphabetical."""
    known = covered is not None
    order = _business_order("Recorded check-ins") if known else [F.col("name"), F.col("business_id")]
    unknown = F.lit(None)
    return rank_rows(rows, scope, order, "position").select(
        *scope, "position", "name", "postal_code",
        (F.col("checkins") if known else unknown.cast("long")).alias("checkins"),
        (F.round("daily_checkins", 3) if known else unknown.cast("double")).alias("daily_checkins"),
        "stars", "review_count",
        F.when(F.col("is_open"), "Open").otherwise("Closed").alias("status"),
        F.array_join("categories", ", ").alias("source_categories"),
        "business_id",
    )


def map_table(
    rows: DataFrame, projected: DataFrame, scope: Sequence[str], recorded_required: bool
) -> DataFrame:
    """Recorded + projected totals, null when a required part is missing and then ranked last."""
    recorded = F.col("checkins").cast("double") if recorded_required else F.lit(0.0)
    joined = rows.join(projected, "business_id", "left").withColumn(
        "combined", F.when(F.col("projected").isNotNull() & (
            F.col("checkins").isNotNull() | F.lit(not recorded_required)),
            F.round(recorded + F.col("projected"), 9)))
    ranked = rank_rows(
        joined, scope,
        [F.col("combined").desc_nulls_last(), F.col("name"), F.col("business_id")], "place")
    return ranked.select(
        *scope, F.when(F.col("combined").isNotNull(), F.col("place")).alias("rank"),
        "business_id", "name", "latitude", "longitude", "checkins", "projected", "combined",
    )


def headline(rows: DataFrame, scope: Sequence[str], projected: DataFrame) -> DataFrame:
    """Members, total, unweighted mean rating over rated members, median per business, and what is projected.

    ``projected`` has a row for each business that a projection supports; a scope without one has no sum.
    """
    stats = rows.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("businesses"),
        F.sum("checkins").alias("checkins"),
        F.count("stars").alias("rated"),
        F.avg("stars").alias("mean_rating"),
        F.avg("checkins").alias("mean_checkins"),
    )
    ahead = projected.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("projected_businesses"), F.sum("projected").alias("projected"))
    return stats.join(
        exact_quantiles(rows, scope, "checkins", {"median_checkins": 0.5}), list(scope)).join(
        ahead, list(scope), "left").withColumn("projected_businesses", F.coalesce("projected_businesses", F.lit(0)))


def comparison_matrix(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Metric rows by member position (1-4) for the chosen members of each scope."""
    text = lambda c: F.coalesce(c, F.lit("Unavailable"))
    long = rows.where(F.col("rank") <= 4).select(
        *scope, "rank",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("line"), F.lit(name).alias("metric"), value.alias("value"))
            for i, (name, value) in enumerate([
                ("Recorded check-ins", F.format_number("checkins", 0)),
                ("Days with check-ins", F.format_number("active_days", 0)),
                ("Weekend share (%)", text(F.when(
                    F.col("weekend_share").isNotNull(),
                    F.format_string("%.1f", F.col("weekend_share") * 100)))),
                ("Rating (snapshot)", text(F.when(F.col("stars").isNotNull(), F.format_string(
                    "%.1f", F.col("stars"))))),
                ("Reviews (snapshot)", F.format_number("review_count", 0)),
                ("Operating status (snapshot)",
                 F.when(F.col("is_open"), "Open").otherwise("Closed")),
                ("Source categories", F.array_join("categories", ", ")),
            ])
        ])).alias("cell"),
    ).select(*scope, "rank", "cell.*")
    return long.groupBy(*scope, "line", "metric").pivot("rank", [1, 2, 3, 4]).agg(
        F.first("value")
    ).toDF(*scope, "line", "metric", "first", "second", "third", "fourth")


def search(rows: DataFrame, needle: str, top_n: int | None = None) -> DataFrame:
    """Listings whose name or id contains the needle, case aside; all of them unless ``top_n`` is given.

    With ``top_n`` the first by lower-cased name and id are returned, a report of that size.
    """
    wanted = F.lower(F.lit(needle.strip()))
    name = F.lower(F.coalesce("name", F.lit("")))
    found = rows.where(name.contains(wanted) | F.lower(F.col("business_id").cast("string")).contains(wanted))
    return found if top_n is None else found.orderBy(name, "business_id").limit(top_n)
