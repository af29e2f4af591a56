from datetime import date

import pytest
from pyspark.sql import functions as F

from footmark.functions import dates
from footmark.functions.dates import Span


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_leap_day_moves_to_february_28(spark):
    row = one(spark, a=dates.previous_year(F.lit(date(2020, 2, 29))),
              b=dates.previous_year(F.lit(date(2021, 3, 31))))
    assert (row["a"], row["b"]) == (date(2019, 2, 28), date(2020, 3, 31))
    assert Span(date(2020, 2, 29), date(2020, 3, 1)).previous_year().start == date(2019, 2, 28)


def test_span_rules():
    with pytest.raises(ValueError):
        Span(date(2020, 1, 2), date(2020, 1, 1))
    a, b = Span(date(2020, 1, 1), date(2020, 1, 31)), Span(date(2020, 1, 20), date(2020, 3, 1))
    assert a.intersect(b) == Span(date(2020, 1, 20), date(2020, 1, 31))
    assert a.intersect(Span(date(2021, 1, 1), date(2021, 1, 1))) is None
    assert b.after(a) == Span(date(2020, 2, 1), date(2020, 3, 1)) and a.after(a) is None


@pytest.mark.parametrize("days,kind", [(89, "week"), (90, "month"), (730, "month"), (731, "year")])
def test_grain_limits(spark, days, kind):
    start = date(2015, 1, 1)
    end = date.fromordinal(start.toordinal() + days)
    assert dates.grain(Span(start, end)) == kind
    assert one(spark, g=dates.grain_column(F.lit(start), F.lit(end)))["g"] == kind


def test_full_months_need_whole_months():
    span = Span(date(2020, 1, 2), date(2020, 4, 29))
    assert dates.full_months(span) == [date(2020, 2, 1), date(2020, 3, 1)]
    assert dates.full_months(Span(date(2020, 1, 1), date(2020, 1, 31))) == [date(2020, 1, 1)]


def test_covered_days_and_cell(spark):
    cov = Span(date(2020, 1, 10), date(2020, 1, 20))
    row = one(spark, a=dates.covered_days(F.lit(date(2020, 1, 1)), F.lit(date(2020, 1, 12)), cov),
              b=dates.covered_days(F.lit(date(2020, 2, 1)), F.lit(date(2020, 2, 2)), cov),
              c=dates.calendar_cell(F.lit(date(2020, 12, 6))))
    assert (row["a"], row["b"], row["c"]) == (3, 0, 83)


def test_presets(spark):
    bounds = dates.preset_bounds(F.lit(date(2020, 1, 1)), F.lit(date(2020, 1, 15)))
    rows = {r["preset"]: (r["from_date"], r["to_date"])
            for r in spark.range(1).select(F.inline(bounds)).collect()}
    assert rows["Latest recorded 7 days"] == (date(2020, 1, 9), date(2020, 1, 15))
    assert rows["Latest recorded 30 days"] == (date(2020, 1, 1), date(2020, 1, 15))
    assert rows["Forecast period preview"] == (date(2020, 1, 16), date(2020, 2, 14))
