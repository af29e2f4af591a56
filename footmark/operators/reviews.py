"""Dated review ratings per calendar period, inside the period or cumulative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footmark.functions import dates
from footmark.functions.dates import Span


def daily_totals(reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    return reviews.groupBy(*keys, "day").agg(
        F.sum("stars").cast("long").alias("star_sum"), F.count(F.lit(1)).alias("review_count"))


def scope_history(days: DataFrame, businesses: DataFrame, scope: Sequence[str], until) -> DataFrame:
    """Star sum and count per scope-day with no lower date bound."""
    rows = days.where(F.col("day") <= F.lit(until))
    return (
        rows.join(businesses.select("business_id", *scope), "business_id")
        .groupBy(*scope, "day")
        .agg(F.sum("star_sum").alias("star_sum"), F.sum("review_count").alias("review_count"))
    )


def rating_periods(
    history: DataFrame, keys: Sequence[str], span: Span, coverage: Span, mode: str
) -> DataFrame:
    """Review-weighted mean per bin (``period``) or through its end (``cumulative``).

    Bins hold at most a few hundred rows per key, so the running sum over bins is bounded;
    reviews are reduced to bins before it.
    """
    if mode not in ("cumulative", "period"):
        raise ValueError("Choose cumulative or period review ratings.")
    kind = dates.grain(span)
    inside = history.where(coverage.holds(F.col("day")) & (F.col("day") <= F.lit(span.end)))
    early = F.col("day") < F.lit(span.start)
    per_bin = inside.groupBy(
        *keys, F.when(~early, dates.bin_first(F.col("day"), kind)).alias("first")
    ).agg(F.sum("star_sum").alias("stars"), F.sum("review_count").alias("n"))
    prior = per_bin.where(F.col("first").isNull()).select(
        *keys, F.col("stars").alias("prior_stars"), F.col("n").alias("prior_n"))
    window = dates.period_columns(F.col("first"), span)
    grid = history.select(*keys).distinct().select(
        *keys, F.explode(dates.bin_array(span)).alias("first"))
    rows = grid.join(per_bin, [*keys, "first"], "left").join(prior, list(keys), "left").withColumns({
        **window, **{c: F.coalesce(c, F.lit(0)) for c in ("stars", "n", "prior_stars", "prior_n")}})
    through = Window.partitionBy(*keys).orderBy("first").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    covered = (F.col("period_start") <= F.lit(coverage.end)) & (
        F.col("period_end") >= F.lit(coverage.start))
    if mode == "cumulative":
        stars = F.sum("stars").over(through) + F.col("prior_stars")
        count = F.sum("n").over(through) + F.col("prior_n")
    else:
        stars, count = F.col("stars"), F.col("n")
    return rows.select(
        *keys, "period", "period_start", "period_end",
        F.when(covered & (count > 0), stars / count).alias("rating"),
        F.when(covered, count).otherwise(0).alias("review_count"),
        F.when(covered, F.col("n")).otherwise(0).alias("new_reviews"),
        F.when(covered, F.least("period_end", F.lit(coverage.end))).alias("rating_as_of"),
        F.lit(mode).alias("rating_mode"))
