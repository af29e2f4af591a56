from datetime import date

from footmark.functions.dates import Span
from footmark.operators import reviews as rev

SCHEMA = "business_id long, day date, star_sum long, review_count long"
ROWS = [(1, date(2018, 5, 1), 10, 2), (1, date(2020, 1, 7), 3, 1), (1, date(2020, 1, 20), 4, 1),
        (1, date(2020, 1, 28), 1, 1), (1, date(2015, 1, 1), 50, 10)]
SPAN = Span(date(2020, 1, 1), date(2020, 2, 4))
COVERAGE = Span(date(2017, 1, 1), date(2020, 1, 22))


def run(spark, mode):
    rows = rev.rating_periods(spark.createDataFrame(ROWS, SCHEMA), ["business_id"], SPAN, COVERAGE, mode)
    return [(r["rating"], r["review_count"], r["new_reviews"], r["rating_as_of"])
            for r in rows.orderBy("period_start").collect()]


def test_cumulative_carries_and_stops_at_coverage(spark):
    assert run(spark, "cumulative") == [
        (5.0, 2, 0, date(2020, 1, 5)), (13 / 3, 3, 1, date(2020, 1, 12)),
        (13 / 3, 3, 0, date(2020, 1, 19)), (17 / 4, 4, 1, date(2020, 1, 22)),
        (None, 0, 0, None), (None, 0, 0, None)]


def test_period_mode_leaves_gaps(spark):
    assert [r[0] for r in run(spark, "period")] == [None, 3.0, None, 4.0, None, None]
