from datetime import date

import pytest
from pyspark.sql import functions as F

from footmark.config import Filters
from footmark.functions.dates import Span
from footmark.operators import activity as act
from footmark.operators import business as biz


@pytest.fixture()
def listings(spark):
    return spark.createDataFrame([
        (1, "A", "m", 1, ["Coffee & Tea", "Cafes"], 4.0, 10, True, "S1"),
        (2, "B", "m", 1, ["Coffee", "Cafes"], None, 30, False, "S1"),
        (3, "C", "m", None, ["Cafes"], 5.0, 20, True, None)],
        "business_id long, name string, metro string, area_id int, categories array<string>, "
        "stars double, review_count int, is_open boolean, station_id string")


@pytest.fixture()
def hours(spark):
    return spark.createDataFrame([
        (1, date(2020, 1, 4), 9, 2), (1, date(2020, 1, 4), 10, 1), (1, date(2020, 1, 6), 9, 4),
        (3, date(2020, 1, 5), 9, 5), (1, date(2019, 1, 4), 9, 7)],
        "business_id long, day date, hour int, n long")


SPAN = Span(date(2020, 1, 1), date(2020, 1, 10))


def test_exact_tag_is_not_a_substring(listings):
    assert [r["business_id"] for r in act.in_scope(listings, Filters(SPAN, category="Coffee")).collect()] == [2]


def test_totals_days_and_weekend(hours):
    rows = {r["business_id"]: tuple(r)[1:] for r in act.business_totals(hours, SPAN).collect()}
    assert rows == {1: (7, 2, 3), 3: (5, 1, 5)}


def test_zero_activity_listing_stays_with_null_share(listings, hours):
    rows = biz.summaries(listings, act.business_totals(hours, SPAN), SPAN)
    got = {r["business_id"]: (r["checkins"], r["weekend_share"]) for r in rows.collect()}
    assert got == {1: (7, 3 / 7), 2: (0, None), 3: (5, 1.0)}


def test_unassigned_area_is_zero_and_previous_year_included(listings, hours):
    rows = act.by_area_hour(hours, listings, ["metro"], SPAN, True).collect()
    assert {(r["area_id"], r["day"].year): r["checkins"] for r in rows if r["hour"] == 9 and
            r["day"] != date(2020, 1, 6)} == {(1, 2020): 2, (0, 2020): 5, (1, 2019): 7}


def test_empty_member_list_is_not_no_list(spark, listings, hours):
    none = spark.createDataFrame([], "business_id long")
    assert act.by_area_hour(hours, listings, ["metro"], SPAN, False, none).count() == 0
    assert act.by_area_hour(hours, listings, ["metro"], SPAN, False).count() == 4


def test_month_rates_clip_boundary_months(listings, hours):
    span = Span(date(2019, 12, 30), date(2020, 1, 10))
    rows = {(r["business_id"], r["month"]): (r["checkins"], r["calendar_days"])
            for r in act.month_rates(hours, listings, span).collect()}
    assert rows[1, date(2020, 1, 1)] == (7, 10) and rows[2, date(2019, 12, 1)] == (0, 2)
    assert len(rows) == 6


def test_periods_are_zero_inside_coverage_and_absent_outside(listings, hours):
    daily = act.scope_days(hours, listings, ["metro"], Span(date(2020, 1, 1), date(2020, 1, 31)))
    rows = act.period_totals(daily, listings, ["metro"], Span(date(2020, 1, 1), date(2020, 1, 31)),
                             Span(date(2020, 1, 3), date(2020, 1, 14))).orderBy("period_start").collect()
    assert [(r["period"], r["period_start"], r["covered_days"], r["checkins"]) for r in rows] == [
        ("Week of 2019-12-30", date(2020, 1, 3), 3, 8),
        ("Week of 2020-01-06", date(2020, 1, 6), 7, 4),
        ("Week of 2020-01-13", date(2020, 1, 13), 2, 0)]
    assert str(rows[0]["midpoint"]) == "2020-01-03 00:00:00"  # from the whole window
    out = act.period_totals(daily, listings, ["metro"], SPAN, Span(date(2021, 1, 1), date(2021, 1, 2)))
    assert out.count() == 0


def test_summary_first_maximum_wins(spark):
    rows = spark.createDataFrame([(1, date(2020, 1, 6), 5, 3), (1, date(2020, 1, 7), 4, 3)],
                                 "area_id int, day date, hour int, checkins long")
    got = act.activity_summary(rows, ["area_id"], SPAN).first()
    assert (got["busiest_day"], got["peak_hour"], got["peak_month"]) == ("Monday", 4, 1)
    assert got["seasonality_ratio"] is None and got["weekly_checkins"] == pytest.approx(4.2)


def test_unknown_days_are_null_not_zero(spark):
    daily = spark.createDataFrame([("m", date(2020, 1, 1), 2)], "metro string, day date, checkins long")
    rows = act.weekday_totals(daily, ["metro"], Span(date(2020, 1, 1), date(2020, 2, 5)),
                              Span(date(2020, 1, 1), date(2020, 1, 31))).orderBy("month").collect()
    assert (rows[0]["checkins"], rows[0]["known_days"]) == (2, 31)
    assert rows[1]["checkins"] is None and rows[1]["known_days"] == 0


def test_rating_rank_puts_missing_last(listings, hours):
    rows = biz.summaries(listings, act.business_totals(hours, SPAN), SPAN)
    ranked = biz.rank_businesses(rows, ["metro"], "Rating (snapshot)").orderBy("rank").collect()
    assert [r["business_id"] for r in ranked] == [3, 1, 2]
    with pytest.raises(ValueError):
        biz.rank_businesses(rows, ["metro"], "Nope")


def test_categories_overlap_and_medians(listings, hours):
    rows = biz.summaries(listings, act.business_totals(hours, SPAN), SPAN)
    got = {r["tag"]: r for r in biz.category_summaries(rows, ["metro"], SPAN).collect()}
    cafes = got["Cafes"]
    assert (cafes["businesses"], cafes["checkins"], cafes["active_businesses"]) == (3, 12, 2)
    assert cafes["median_daily"] == pytest.approx(0.5) and cafes["top_share"] == pytest.approx(7 / 12)
    assert got["Coffee"]["top_share"] is None


def test_map_total_needs_both_parts(spark, listings, hours):
    rows = biz.summaries(listings, act.business_totals(hours, SPAN), SPAN).withColumns(
        {"latitude": F.lit(1.0), "longitude": F.lit(1.0)})
    projected = spark.createDataFrame([(2, 9.5)], "business_id long, projected double")
    got = {r["business_id"]: (r["rank"], r["combined"])
           for r in biz.map_table(rows, projected, ["metro"], True).collect()}
    assert got == {1: (None, None), 2: (1, 9.5), 3: (None, None)}
