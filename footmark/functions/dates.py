"""Calendar arithmetic: windows, coverage, adaptive bins and date presets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    """Inclusive date interval."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError("The end date must be on or after the start date.")

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def intersect(self, other: "Span") -> "Span | None":
        start, end = max(self.start, other.start), min(self.end, other.end)
        return Span(start, end) if start <= end else None

    def contains(self, other: "Span") -> bool:
        return self.start <= other.start and other.end <= self.end

    def previous_year(self) -> "Span":
        return Span(_year_back(self.start), _year_back(self.end))

    def holds(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))

    def after(self, coverage: "Span") -> "Span | None":
        """The part strictly after coverage; covered dates are never projected."""
        if self.end <= coverage.end:
            return None
        first = max(self.start, date.fromordinal(coverage.end.toordinal() + 1))
        return Span(first, self.end)


def _year_back(day: date) -> date:
    last = 28 if (day.month, day.day) == (2, 29) else day.day
    return day.replace(year=day.year - 1, day=last)


def previous_year(day: Column) -> Column:
    """Matching date one year earlier; a leap day becomes February 28."""
    return F.add_months(day, -12)


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_days(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def calendar_cell(day: Column) -> Column:
    """0-83: seven weekdays for each of twelve months."""
    return (F.month(day) - 1) * 7 + F.weekday(day)


def covered_days(start: Column, end: Column, coverage: Span) -> Column:
    """Days of [start, end] inside coverage, 0 when disjoint."""
    lower = F.greatest(start, F.lit(coverage.start))
    upper = F.least(end, F.lit(coverage.end))
    return F.greatest(F.lit(0), F.datediff(upper, lower) + 1)


# Below 90 days weekly bins, above 730 days yearly bins, else monthly.
WEEK_BELOW_DAYS = 90
YEAR_ABOVE_DAYS = 730


def grain(span: Span) -> str:
    width = (span.end - span.start).days
    return "week" if width < WEEK_BELOW_DAYS else "year" if width > YEAR_ABOVE_DAYS else "month"


def grain_column(start: Column, end: Column) -> Column:
    width = F.datediff(end, start)
    return (
        F.when(width < WEEK_BELOW_DAYS, "week").when(width > YEAR_ABOVE_DAYS, "year")
        .otherwise("month")
    )


def bin_first(day: Column, kind: str) -> Column:
    return F.trunc(day, kind)


def bin_last(first: Column, kind: str) -> Column:
    if kind == "week":
        return F.date_add(first, 6)
    if kind == "month":
        return F.last_day(first)
    return F.date_sub(F.add_months(first, 12), 1)


def bin_label(first: Column, kind: str) -> Column:
    if kind == "week":
        return F.concat(F.lit("Week of "), F.date_format(first, "yyyy-MM-dd"))
    return F.date_format(first, "yyyy" if kind == "year" else "MMMM yyyy")


def period_columns(first: Column, span: Span) -> dict[str, Column]:
    """Label and clipped bounds of a bin of ``span``; the midpoint uses the clipped bounds."""
    kind = grain(span)
    lower = F.greatest(first, F.lit(span.start))
    upper = F.least(bin_last(first, kind), F.lit(span.end))
    half_seconds = F.datediff(upper, lower) * 43200
    return {
        "period": bin_label(first, kind),
        "period_start": lower,
        "period_end": upper,
        "covered_days": F.datediff(upper, lower) + 1,
        "midpoint": F.timestamp_seconds(
            F.unix_date(lower).cast("long") * 86400 + half_seconds
        ).cast("timestamp_ntz"),
    }


def day_array(span: Span) -> Column:
    return F.sequence(F.lit(span.start), F.lit(span.end), F.expr("interval 1 day"))


def month_array(span: Span) -> Column:
    return F.sequence(
        F.lit(span.start.replace(day=1)), F.lit(span.end), F.expr("interval 1 month")
    )


def bin_array(span: Span, within: Span | None = None) -> Column:
    """First days of all bins of ``span`` that touch ``within``."""
    kind = grain(span)
    inner = within or span
    step = {"week": "interval 7 days", "month": "interval 1 month", "year": "interval 1 year"}
    return F.sequence(
        F.trunc(F.lit(inner.start), kind), F.lit(inner.end), F.expr(step[kind])
    )


def full_months(span: Span) -> list[date]:
    """First days of calendar months lying wholly inside the span."""
    months, cursor = [], span.start
    if cursor.day != 1:
        cursor = _next_month(cursor)
    while _next_month(cursor).toordinal() - 1 <= span.end.toordinal():
        months.append(cursor)
        cursor = _next_month(cursor)
    return months


def _next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


# Preset names with their lengths in recorded days.
RECENT_PRESETS = {
    "Recorded activity overview": 365,
    "Latest recorded 7 days": 7,
    "Latest recorded 30 days": 30,
    "Latest recorded 90 days": 90,
}
FORECAST_DAYS = 30


def preset_bounds(start: Column, end: Column) -> Column:
    """Array of (preset, from, to) for a coverage interval held in two columns."""
    rows = [
        F.struct(F.lit(name).alias("preset"),
                 F.greatest(start, F.date_sub(end, n - 1)).alias("from_date"),
                 end.alias("to_date"))
        for name, n in RECENT_PRESETS.items()
    ]
    rows.append(F.struct(F.lit("Seasonal patterns").alias("preset"), start.alias("from_date"),
                         end.alias("to_date")))
    ahead = F.date_add(end, FORECAST_DAYS)
    rows.append(F.struct(F.lit("Forecast period preview").alias("preset"),
                         F.date_add(end, 1).alias("from_date"), ahead.alias("to_date")))
    rows.append(F.struct(F.lit("History → forecast preview").alias("preset"),
                         F.greatest(start, F.date_sub(end, 29)).alias("from_date"),
                         ahead.alias("to_date")))
    return F.array(*rows)
