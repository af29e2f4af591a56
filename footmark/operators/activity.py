"""Recorded activity: scoped totals, calendar bins, heatmaps, shares and indices.

``activity`` has one row per (business_id, day, hour) with count ``n``; only hours with
activity are stored. ``businesses`` carries scope columns. Counts are aggregated per business
before the join, so a busy business is one row when it meets its listing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.config import Filters
from footmark.functions import dates
from footmark.functions.dates import Span


def has_tag(tag: str) -> Column:
    """Exact array membership; never a substring."""
    return F.array_contains("categories", tag)


def in_scope(businesses: DataFrame, filters: Filters) -> DataFrame:
    out = businesses
    if filters.metro is not None:
        out = out.where(F.col("metro") == filters.metro)
    if filters.category is not None:
        out = out.where(has_tag(filters.category))
    if filters.co_tag is not None:
        out = out.where(has_tag(filters.co_tag))
    return out


def restrict_members(rows: DataFrame, members: DataFrame | None) -> DataFrame:
    """None keeps everything; an empty member table keeps nothing."""
    if members is None:
        return rows
    return rows.join(members.select("business_id").distinct(), "business_id", "left_semi")


def in_windows(day: Column, span: Span, include_previous_year: bool) -> Column:
    current = span.holds(day)
    return current | span.previous_year().holds(day) if include_previous_year else current


def _with_scope(rows: DataFrame, businesses: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.join(businesses.select("business_id", *columns), "business_id")


def by_area_hour(
    activity: DataFrame, businesses: DataFrame, scope: Sequence[str], span: Span,
    include_previous_year: bool = True, members: DataFrame | None = None,
) -> DataFrame:
    """Check-ins per scope, area (0 keeps unusable ZIPs), date and hour."""
    rows = restrict_members(
        activity.where(in_windows(F.col("day"), span, include_previous_year)), members
    )
    return (
        _with_scope(rows, businesses, [*scope, "area_id"])
        .groupBy(*scope, F.coalesce("area_id", F.lit(0)).alias("area_id"), "day", "hour")
        .agg(F.sum("n").alias("checkins"))
    )


def business_totals(activity: DataFrame, span: Span) -> DataFrame:
    """Total, distinct active days and weekend total per business with any activity."""
    daily = business_days(activity, span)
    return daily.groupBy("business_id").agg(
        F.sum("checkins").alias("checkins"),
        F.count(F.lit(1)).alias("active_days"),
        F.sum(F.when(dates.is_weekend(F.col("day")), F.col("checkins")).otherwise(0))
        .alias("weekend_checkins"),
    )


def business_days(activity: DataFrame, span: Span) -> DataFrame:
    return (
        activity.where(span.holds(F.col("day")))
        .groupBy("business_id", "day").agg(F.sum("n").alias("checkins"))
    )


def business_months(activity: DataFrame, span: Span) -> DataFrame:
    """Sparse monthly counts; boundary months hold only the selected days."""
    return (
        activity.where(span.holds(F.col("day")))
        .groupBy("business_id", dates.month_start(F.col("day")).alias("month"))
        .agg(F.sum("n").alias("checkins"))
    )


def scope_days(
    activity: DataFrame, businesses: DataFrame, scope: Sequence[str], span: Span
) -> DataFrame:
    return (
        _with_scope(business_days(activity, span), businesses, scope)
        .groupBy(*scope, "day").agg(F.sum("checkins").alias("checkins"))
    )


def month_rates(
    activity: DataFrame, businesses: DataFrame, span: Span
) -> DataFrame:
    """Every listing x selected month, zero filled, with clipped calendar days."""
    month = F.col("month")
    days = (
        F.datediff(F.least(F.last_day(month), F.lit(span.end)),
                   F.greatest(month, F.lit(span.start))) + 1
    )
    grid = businesses.select("business_id", F.explode(dates.month_array(span)).alias("month"))
    n = F.coalesce("checkins", F.lit(0))
    return (
        grid.join(business_months(activity, span), ["business_id", "month"], "left")
        .select("business_id", "month", n.alias("checkins"), days.alias("calendar_days"),
                (n * 7 / days).alias("weekly_checkins"),
                (n / days).alias("daily_checkins"))
    )


def period_totals(
    daily: DataFrame, groups: DataFrame, keys: Sequence[str], span: Span,
    coverage: Span | None = None, count: str = "checkins",
) -> DataFrame:
    """Totals in adaptive week/month/year bins, zero filled only where covered.

    ``groups`` lists the keys that must appear. The midpoint comes from the whole window,
    the bounds and covered days from the covered part of each bin.
    """
    covered = span if coverage is None else span.intersect(coverage)
    if covered is None:
        return _no_periods(groups, keys, span, count)
    kind = dates.grain(span)
    first = F.col("first")
    totals = (
        daily.where(covered.holds(F.col("day")))
        .groupBy(*keys, dates.bin_first(F.col("day"), kind).alias("first"))
        .agg(F.sum(count).alias(count))
    )
    grid = groups.select(*keys).distinct().select(
        *keys, F.explode(dates.bin_array(span, covered)).alias("first")
    )
    window = dates.period_columns(first, span)
    lower = F.greatest(window["period_start"], F.lit(covered.start))
    upper = F.least(window["period_end"], F.lit(covered.end))
    return grid.join(totals, [*keys, "first"], "left").select(
        *keys,
        window["period"].alias("period"),
        lower.alias("period_start"),
        upper.alias("period_end"),
        (F.datediff(upper, lower) + 1).alias("covered_days"),
        window["midpoint"].alias("midpoint"),
        F.coalesce(count, F.lit(0)).alias(count),
    )


def _no_periods(groups: DataFrame, keys: Sequence[str], span: Span, count: str) -> DataFrame:
    window = dates.period_columns(F.lit(span.start), span)
    return groups.where(F.lit(False)).select(
        *keys, window["period"].alias("period"), window["period_start"].alias("period_start"),
        window["period_end"].alias("period_end"), window["covered_days"].alias("covered_days"),
        window["midpoint"].alias("midpoint"), F.lit(0).cast("long").alias(count),
    )


def heatmap(hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All 7 x 24 weekday/hour cells per key, zeros included."""
    counts = hourly.groupBy(
        *keys, dates.weekday(F.col("day")).alias("weekday"), "hour"
    ).agg(F.sum("checkins").alias("checkins"))
    grid = hourly.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.join(counts, [*keys, "weekday", "hour"], "left").withColumn(
        "checkins", F.coalesce("checkins", F.lit(0))
    )


def month_of_year_profile(daily: DataFrame, keys: Sequence[str], span: Span) -> DataFrame:
    """Per month of year: covered days, count, daily mean and index (100 = overall mean)."""
    day = F.col("day")
    calendar = (
        daily.sparkSession.range(1).select(F.explode(dates.day_array(span)).alias("day"))
        .groupBy(F.month(day).alias("month_of_year"))
        .agg(F.count(F.lit(1)).alias("calendar_days"))
    )
    counts = daily.where(span.holds(day)).groupBy(
        *keys, F.month(day).alias("month_of_year")
    ).agg(F.sum("checkins").alias("checkins"))
    totals = counts.groupBy(*keys).agg(F.sum("checkins").alias("total"))
    grid = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_of_year"))
    mean = F.coalesce("checkins", F.lit(0)) / F.col("calendar_days")
    overall = F.col("total") / F.lit(span.days)
    return (
        grid.join(calendar, "month_of_year", "left")
        .join(counts, [*keys, "month_of_year"], "left")
        .select(
            *keys, "month_of_year", F.coalesce("calendar_days", F.lit(0)).alias("calendar_days"),
            F.coalesce("checkins", F.lit(0)).alias("checkins"), "total",
            mean.alias("daily_mean"),
            F.when(F.col("total") > 0, mean / overall * 100).alias("monthly_index"),
        )
    )


def activity_summary(hourly: DataFrame, keys: Sequence[str], span: Span) -> DataFrame:
    """One row per key: shares, busiest day, peak hour and month, seasonality ratio.

    The first maximum wins. Seasonality needs all twelve months and whole boundary months.
    """
    rows = hourly.where(span.holds(F.col("day")))
    weekday = dates.weekday(F.col("day"))
    by_day = rows.groupBy(*keys, weekday.alias("k")).agg(F.sum("checkins").alias("v"))
    by_hour = rows.groupBy(*keys, F.col("hour").alias("k")).agg(F.sum("checkins").alias("v"))
    first_max = F.max_by("k", F.struct(F.col("v"), -F.col("k")))
    names = F.array(*[F.lit(d) for d in (
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    week = by_day.groupBy(*keys).agg(
        F.sum("v").alias("checkins"),
        (F.sum(F.when(F.col("k") < 5, F.col("v")).otherwise(0)) / F.sum("v"))
        .alias("weekday_share"),
        (F.sum(F.when(F.col("k") >= 5, F.col("v")).otherwise(0)) / F.sum("v"))
        .alias("weekend_share"),
        F.element_at(names, (first_max + 1).cast("int")).alias("busiest_day"),
    )
    hour = by_hour.groupBy(*keys).agg(first_max.alias("peak_hour"))
    months = month_of_year_profile(rows, keys, span)
    whole = (
        span.start.day == 1
        and span.end.toordinal() == dates._next_month(span.end).toordinal() - 1
        and len({m.month for m in dates.full_months(span)}) == 12
    )
    ratio = F.when(
        F.lit(whole) & (F.min("daily_mean") > 0), F.max("daily_mean") / F.min("daily_mean")
    )
    year = months.groupBy(*keys).agg(
        F.max_by("month_of_year",
                 F.struct(F.coalesce("daily_mean", F.lit(0.0)), -F.col("month_of_year")))
        .alias("peak_month"),
        ratio.alias("seasonality_ratio"),
    )
    return week.join(hour, list(keys)).join(year, list(keys)).select(
        *keys, "checkins", (F.col("checkins") * 7 / F.lit(span.days)).alias("weekly_checkins"),
        "weekday_share", "weekend_share", "busiest_day", "peak_hour", "peak_month",
        "seasonality_ratio",
    )


def annual_share(daily: DataFrame, city: Sequence[str], area: str, span: Span) -> DataFrame:
    """Share of each area in its city's check-ins per year; years without any are null."""
    rows = daily.where(span.holds(F.col("day")))
    year = F.year("day").alias("year")
    part = rows.groupBy(*city, area, year).agg(F.sum("checkins").alias("checkins"))
    whole = part.groupBy(*city, "year").agg(F.sum("checkins").alias("city_checkins"))
    years = F.sequence(F.lit(span.start.year), F.lit(span.end.year))
    grid = rows.select(*city, area).distinct().select("*", F.explode(years).alias("year"))
    n = F.coalesce("checkins", F.lit(0))
    return (
        grid.join(part, [*city, area, "year"], "left").join(whole, [*city, "year"], "left")
        .select(*city, area, "year", n.alias("checkins"),
                F.try_divide(n, F.col("city_checkins")).alias("share"))
    )


def weekly_series(daily: DataFrame, keys: Sequence[str], span: Span) -> DataFrame:
    """Zero-filled Monday weeks inside the covered span."""
    weeks = F.sequence(F.trunc(F.lit(span.start), "week"), F.lit(span.end),
                       F.expr("interval 7 days"))
    rows = daily.where(span.holds(F.col("day")))
    counts = rows.groupBy(*keys, F.trunc("day", "week").alias("week")).agg(
        F.sum("checkins").alias("checkins"))
    grid = rows.select(*keys).distinct().select("*", F.explode(weeks).alias("week"))
    return grid.join(counts, [*keys, "week"], "left").withColumn(
        "checkins", F.coalesce("checkins", F.lit(0)))


def weekday_totals(daily: DataFrame, keys: Sequence[str], span: Span, coverage: Span) -> DataFrame:
    """Weekday and month totals where uncovered days stay unknown, not zero."""
    spine = daily.select(*keys).distinct().select(
        "*", F.explode(dates.day_array(span)).alias("day"))
    known = F.when(coverage.holds(F.col("day")), F.coalesce("checkins", F.lit(0)))
    return (
        spine.join(daily, [*keys, "day"], "left")
        .groupBy(*keys, dates.month_start(F.col("day")).alias("month"))
        .agg(F.sum(known).alias("checkins"), F.count(known).alias("known_days"),
             *[F.sum(F.when(dates.weekday(F.col("day")) == i, known)).alias(name)
               for i, name in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))])
    )
