"""County climate scenarios against a common baseline, and long rolling means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.functions.weather_values import celsius, millimetres
from footmark.operators.ordering import exact_quantiles

# Baseline years, future windows, and the width of the rolling mean.
BASELINE = (1976, 2005)
WINDOWS = {"2030–2059": (2030, 2059), "2070–2099": (2070, 2099)}
ROLLING_YEARS = 10


def annual(rows: DataFrame) -> DataFrame:
    value = F.col("value").cast("double")
    return rows.where(F.col("frequency") == "annual").select(
        "*", F.col("period").cast("int").alias("year"),
        F.when(F.col("variable") == "pcpn", millimetres(value)).otherwise(celsius(value))
        .alias("metric"))


def change(metric: Column, base: Column) -> Column:
    """Percent for rain, degrees otherwise."""
    return F.when(F.col("variable") == "pcpn", (metric / base - 1) * 100).otherwise(metric - base)


def baseline(years: DataFrame) -> DataFrame:
    history = years.where(
        (F.col("dataset") == "historical_modeled") & (F.col("statistic") == "weighted_mean")
        & F.col("year").between(*BASELINE))
    return history.groupBy("county_fips", "variable").agg(
        F.avg("metric").alias("baseline_metric"), F.count(F.lit(1)).alias("baseline_years"))


def projections(years: DataFrame) -> DataFrame:
    return years.where(F.col("dataset") == "projections").join(
        baseline(years), ["county_fips", "variable"]).withColumn(
        "change", change(F.col("metric"), F.col("baseline_metric")))


def rolling_mean(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Trailing ten-row mean, null until the window is full. A series has one row per year."""
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(-(ROLLING_YEARS - 1), 0)
    return rows.withColumn("smooth", F.when(
        F.count(value).over(w) == ROLLING_YEARS, F.avg(value).over(w)))


def window_changes(projected: DataFrame, businesses: DataFrame) -> DataFrame:
    """Thirty-year means per county and scenario with the business count as context."""
    label = None
    for name, (first, last) in WINDOWS.items():
        hit = F.col("year").between(first, last)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    rows = projected.where(F.col("statistic") == "weighted_mean").withColumn("window", label).where(
        "window IS NOT NULL")
    means = rows.groupBy("county_fips", "variable", "scenario", "window").agg(
        F.avg("metric").alias("future_metric"), F.first("baseline_metric").alias("baseline_metric"),
        F.count(F.lit(1)).alias("years"))
    return means.withColumn("change", change(F.col("future_metric"), F.col("baseline_metric"))).join(
        businesses, "county_fips", "left")


def median_change(changes: DataFrame) -> DataFrame:
    return exact_quantiles(changes, ["variable", "scenario", "window"], "change",
                           {"median_change": 0.5})


def inventory(rows: DataFrame) -> DataFrame:
    return rows.groupBy("frequency", "dataset", "scenario", "statistic").agg(
        F.countDistinct("county_fips").alias("counties"), F.count(F.lit(1)).alias("rows"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def period_completeness(years: DataFrame) -> DataFrame:
    """Per county series: distinct years against the span from first to last year."""
    return years.groupBy("county_fips", "dataset", "scenario", "variable").agg(
        F.countDistinct("year").alias("years"), F.count(F.lit(1)).alias("rows"),
        (F.max("year") - F.min("year") + 1).alias("expected_years"),
    ).withColumn("complete", (F.col("years") == F.col("expected_years"))
                 & (F.col("rows") == F.col("years")))
