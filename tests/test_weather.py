from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from footmark.functions import weather_values as wv
from footmark.functions.dates import Span
from footmark.operators import weather as wx

REPORT = ("station_id string, day date, variable string, value double, unit string, "
          "raw_value string, flag string, is_trace boolean")
DAY = date(2020, 1, 1)


@pytest.mark.parametrize("variable,value,unit,raw,flag,trace,expected", [
    ("tmax", 89.6, "degreeF", "89.6", "", False, 32.0),
    ("tmin", 32.0, "degreeF", "32", " ", False, 0.0),
    ("pcpn", 0.1, "inch", "0.1", "", False, 2.54),
    ("pcpn", None, "inch", "T", "T", True, 0.0),
    ("pcpn", None, "inch", "T", "", False, 0.0),
    ("pcpn", 0.5, "inch", "0.5A", "A", False, None),
    ("tmax", 50.0, "degreeF", "50", "T", False, None),
    ("tmax", 50.0, "degreeC", "50", "", False, None),
    ("tmax", -999.0, "degreeF", "", "", False, None),
    ("tmax", float("nan"), "degreeF", "", "", False, None),
    ("tmax", float("-inf"), "degreeF", "", "", False, None),
    ("pcpn", -0.1, "inch", "-0.1", "", False, None),
    ("pcpn", None, "inch", "M", "", False, None),
    ("snow", 1.0, "inch", "1", "", False, None),
])
def test_acceptance_policy(spark, variable, value, unit, raw, flag, trace, expected):
    df = spark.createDataFrame([("S", DAY, variable, value, unit, raw, flag, trace)], REPORT)
    got = df.select(wv.accepted_value().alias("v")).first()["v"]
    assert got == (None if expected is None else pytest.approx(expected))


@pytest.mark.parametrize("raw,rain,expected", [
    ("T", True, 0.0), ("T", False, None), ("", True, None), ("1.5s", False, None), ("-3", False, -3.0),
    ("-3", True, None), ("NaN", False, None), ("Infinity", False, None), (" 2. ", True, 2.0), (".5", True, 0.5)])
def test_hourly_text(spark, raw, rain, expected):
    assert spark.range(1).select(wv.hourly_value(F.lit(raw), rain).alias("v")).first()["v"] == expected


@pytest.mark.parametrize("variable,value,label", [
    ("tmax", -0.1, "Temperature < 0 °C"), ("tmax", 0.0, "0 ≤ temperature < 10 °C"),
    ("tmin", 30.0, "Temperature ≥ 30 °C"), ("pcpn", 0.0, "0 mm (dry / trace)"),
    ("pcpn", 0.2, "0 < rain < 1 mm"), ("pcpn", 1.0, "1 ≤ rain < 5 mm"), ("pcpn", 20.0, "Rain ≥ 20 mm"),
    ("pcpn", -1.0, None), ("tmax", float("inf"), None)])
def test_band_edges(spark, variable, value, label):
    index = wv.band_index(F.lit(value), variable)
    assert spark.range(1).select(wv.band_label(index, variable).alias("b")).first()["b"] == label


def test_incoherent_pair_drops_both_temperatures(spark):
    rows = [("S", DAY, "tmax", 40.0, "degreeF", "", "", False),
            ("S", DAY, "tmin", 50.0, "degreeF", "", "", False),
            ("S", DAY, "pcpn", 0.0, "inch", "", "", False),
            ("S", DAY + timedelta(1), "tmax", 40.0, "degreeF", "", "", False),
            ("S", DAY + timedelta(1), "tmin", 50.0, "degreeF", "", "", False)]
    got = wx.station_days(spark.createDataFrame(rows, REPORT)).collect()
    assert [(r["day"], r["tmin"], r["tmax"], r["pcpn"]) for r in got] == [(DAY, None, None, 0.0)]


@pytest.fixture()
def world(spark):
    rng = np.random.default_rng(3)
    span = Span(DAY, DAY + timedelta(59))
    days = [(f"S{s}", DAY + timedelta(i), *[None if rng.random() < 0.2 else float(v) for v in (
        rng.normal(5, 8), rng.normal(18, 10), max(0.0, rng.normal(1, 4)))])
        for s in range(2) for i in range(60)]
    counts = [(b, DAY + timedelta(i), int(rng.integers(1, 9)))
              for b in range(4) for i in range(60) if rng.random() < 0.4 and b != 3]
    links = [(0, "S0"), (1, "S1"), (2, None), (3, "S1")]
    return (span, days, counts, links,
            spark.createDataFrame(days, "station_id string, day date, tmin double, tmax double, pcpn double"),
            spark.createDataFrame(counts, "business_id long, day date, checkins long"),
            spark.createDataFrame(links, "business_id long, station_id string"))


def dense(span, days, counts, links, column):
    weather = {(r[0], r[1]): r[column] for r in days}
    seen = {(b, d): n for b, d, n in counts}
    for b, s in links:
        pairs = [(weather.get((s, span.start + timedelta(i))), seen.get((b, span.start + timedelta(i)), 0))
                 for i in range(span.days)]
        yield b, [(w, n) for w, n in pairs if w is not None]


def test_band_table_equals_dense_brute_force(world):
    span, days, counts, links, wdf, ddf, bdf = world
    got = {(r["business_id"], r["band_index"]): r
           for r in wx.band_table(ddf, bdf, wdf, span, "tmax").collect()}
    assert len(got) == 4 * 5
    edges = [0, 10, 20, 30]
    for b, pairs in dense(span, days, counts, links, 3):
        for k in range(5):
            values = [n for w, n in pairs if int(np.searchsorted(edges, w, side="right")) == k]
            row = got[b, k]
            assert (row["day_count"], row["zero_days"]) == (len(values), values.count(0))
            if values:
                np.testing.assert_allclose([row["q1"], row["median"], row["q3"]],
                                           np.percentile(values, [25, 50, 75]))
                assert (row["minimum"], row["maximum"]) == (min(values), max(values))
            else:
                assert row["median"] is None and row["minimum"] is None


def test_correlation_equals_dense_numpy(world):
    span, days, counts, links, wdf, ddf, bdf = world
    got = {r["business_id"]: r for r in wx.correlation(ddf, bdf, wdf, span, "tmax").collect()}
    for b, pairs in dense(span, days, counts, links, 3):
        assert got[b]["paired_days"] == len(pairs) and got[b]["missing_days"] == 60 - len(pairs)
        if len(pairs) >= 3 and len({n for _, n in pairs}) > 1:
            assert got[b]["pearson_r"] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1])
        else:
            assert got[b]["pearson_r"] is None


def test_covered_zero_and_missing_weather(world):
    span, *_, wdf, ddf, bdf = world
    short = Span(span.start, span.start + timedelta(9))
    rows = wx.business_weather_days(ddf, bdf, wdf, span, short)
    assert rows.count() == 40 and rows.where("checkins IS NULL").count() == 0
    assert rows.where("business_id = 2 AND tmax IS NOT NULL").count() == 0


def moved_rows(plan):
    """Rows that a plan has written to its shuffles."""
    found = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    children = plan.children()
    return found + sum(moved_rows(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_days_of_businesses_are_written_after_the_last_shuffle(spark, limit):
    span = Span(date(2020, 1, 1), date(2020, 12, 31))
    at = lambda i: span.start + timedelta(i)
    names = [*range(40), 3, None]  # a repeated business and one without a key
    links = [(b, None if b == 7 else f"S{(b or 0) % 3}") for b in names]
    counts = {(b, i): b + i for b in range(30) for i in range(0, 366, 50 + b)}
    weather = {(f"S{k}", i): (float(i), i + 1.0, None if i % 5 == 0 else k / 2) for k in (0, 2) for i in range(3, 366, 2 + k)}
    ddf = spark.createDataFrame([(b, at(i), n) for (b, i), n in counts.items()]
                                + [(1, at(-1), 9), (1, at(366), 9), (None, at(5), 9)], "business_id long, day date, checkins long")
    wdf = spark.createDataFrame([(s, at(i), *v) for (s, i), v in weather.items()] + [("S0", at(-1), 1.0, 2.0, 0.0), (None, at(5), 1.0, 2.0, 0.0)],
                                "station_id string, day date, tmin double, tmax double, pcpn double")
    bdf = spark.createDataFrame(links, "business_id long, station_id string")
    expected = []
    for b, s in links:
        for i in range(366):
            tmin, tmax, pcpn = weather.get((s, i), (None, None, None))
            expected.append((s, at(i), b, counts.get((b, i), 0), tmin, tmax, pcpn, None not in (tmin, tmax, pcpn)))
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = wx.business_weather_days(ddf, bdf, wdf, span, span)
        got = rows.collect()
        moved = moved_rows(rows._jdf.queryExecution().executedPlan())
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert rows.columns == ["station_id", "day", "business_id", "checkins", "tmin", "tmax", "pcpn", "weather_available"]
    assert 0 < moved < 42 * 366 / 4


LCD = ("STATION string, DATE string, REPORT_TYPE string, SOURCE string, "
       "HourlyDryBulbTemperature string, HourlyPrecipitation string")


def test_latest_report_is_independent_of_input_order(spark):
    rows = [("X", "2020-01-01T05:10:00", "FM-15", "1", "1.0", ""),
            ("X", "2020-01-01T05:50:00", "FM-15", "2", "2.0", "T"),
            ("X", "2020-01-01T05:50:00", "FM-15", "3", "3.0", "0.1"),
            ("X", "2020-01-01T05:59:00", "FM-16", "4", "9.0", "0")]
    results = []
    for order in (rows, rows[::-1]):
        got = wx.latest_hourly(spark.createDataFrame(order, LCD)).collect()
        assert len(got) == 1
        results.append((got[0]["temperature_c"], got[0]["source_code"]))
    assert results[0] == results[1] == (3.0, "3")


def test_box_statistics_and_pooled_agree(spark):
    rows = [("S", DAY + timedelta(i), "tmax", v) for i, v in enumerate([4.0, 1.0, None, 3.0, 2.0])]
    samples = spark.createDataFrame(rows, "station_id string, day date, series string, value double")
    span = Span(date(2019, 12, 30), date(2020, 1, 5))
    for pooled in (False, True):
        r = wx.box_stats(samples, ["station_id"], span, pooled=pooled).first()
        assert (r["readings"], r["q1"], r["median"], r["q3"], r["mean"]) == (4, 1.75, 2.5, 3.25, 2.5)
        assert (r["first_report"], r["last_report"]) == (DAY, DAY + timedelta(4))
        assert str(r["midpoint"]) == "2020-01-02 00:00:00"
        assert str(r["observed_midpoint"]) == "2020-01-03 00:00:00"


def test_hourly_boxes_report_coverage(spark):
    rows = [("S", DAY, "temperature", 1.0)] * 12
    samples = spark.createDataFrame(rows, "station_id string, day date, series string, value double")
    r = wx.box_stats(samples, ["station_id"], Span(DAY, DAY), hourly=True).first()
    assert (r["expected"], r["coverage_pct"]) == (24, 50.0)


def test_layer_rejects_another_period_length(spark):
    b = spark.createDataFrame([(1, 7, "S"), (2, 7, "S"), (3, 7, None)],
                              "business_id long, area_id int, station_id string")
    s = spark.createDataFrame([("S", 10.0, 5, 10)],
                              "station_id string, mean_tmax double, tmax_days int, selected_days int")
    good = wx.business_layer(b, s, "temp_max", Span(DAY, DAY + timedelta(9)))
    r = wx.area_weather(good, ["area_id"]).first()
    assert (r["value"], r["usable_businesses"], r["total_businesses"], r["stations"]) == (10.0, 2, 3, "S")
    other = wx.business_layer(b, s, "temp_max", Span(DAY, DAY + timedelta(8)))
    assert wx.area_weather(other, ["area_id"]).first()["value"] is None


def test_dominant_station_tie_goes_to_smallest(spark):
    b = spark.createDataFrame([(1, "S2"), (1, "S1"), (1, None), (1, None), (1, None), (2, None)],
                              "area_id int, station_id string")
    rows = {r["area_id"]: (r["station_id"], r["station_businesses"], r["businesses"])
            for r in wx.dominant_station(b, ["area_id"]).collect()}
    assert rows == {1: ("S1", 1, 5), 2: (None, 0, 1)}
