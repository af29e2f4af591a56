from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footmark.config import ForecastConfig
from footmark.functions.dates import Span
from footmark.operators import forecast as fc
from footmark.operators import longrun as lr
from footmark.operators import models as ml

COVERAGE = Span(date(2016, 12, 1), date(2019, 12, 31))
TRAIN = Span(date(2017, 1, 1), date(2018, 12, 31))
ASSESS = Span(date(2019, 1, 1), date(2019, 12, 31))
CONFIG = ForecastConfig()


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(2)
    rows = []
    for b in range(6):
        day = COVERAGE.start
        while day <= COVERAGE.end:
            if rng.random() < (0.004 if b == 5 else 0.3):
                rows.append((b, day, int(rng.integers(1, 4))))
            day += timedelta(1)
    rows = [r for r in rows if not (r[0] == 4 and r[1] <= date(2017, 6, 1))]  # late opener
    daily = spark.createDataFrame(rows, "business_id long, day date, checkins long")
    listed = spark.createDataFrame(
        [(b, f"B{b}", "m", "Restaurants", ["Restaurants", "Pizza", f"T{b % 2}"], f"S{b % 2}") for b in range(6)],
        "business_id long, name string, metro string, parent string, categories array<string>, station_id string")
    groups = fc.fit(daily, listed, ["metro"], TRAIN, COVERAGE, CONFIG)
    return rows, daily, listed, groups


def test_cohort_support_and_shrinkage(world):
    rows, _, _, groups = world
    got = {r["business_id"]: r for r in groups.collect()}
    assert 4 not in got and 5 not in got and set(got) == {0, 1, 2, 3}
    cell, expo = (6 - 1) * 7 + 2, fc.exposure(TRAIN)
    hits = {b: sum(n for k, d, n in rows if k == b and TRAIN.start <= d <= TRAIN.end and
                   (d.month - 1) * 7 + d.weekday() == cell) for b in got}
    want = (hits[1] + 30 * sum(hits.values()) / (4 * expo[cell])) / (expo[cell] + 30)
    assert got[1]["rates"][cell] == pytest.approx(want)
    assert got[1]["source_categories"] == ["Pizza", "T1"]
    assert sum(expo) == TRAIN.days and min(expo) > 0


def test_sparse_scores_equal_dense(world):
    rows, daily, _, groups = world
    errors = {r["business_id"]: r for r in fc.business_errors(groups, daily, ASSESS).collect()}
    seen = {(b, d): n for b, d, n in rows}
    for g in groups.collect():
        dev = err = 0.0
        for i in range(ASSESS.days):
            d = ASSESS.start + timedelta(i)
            y, mu = seen.get((g["business_id"], d), 0), g["rates"][(d.month - 1) * 7 + d.weekday()]
            dev += 2 * (mu - y + (y * np.log(y / mu) if y else 0.0))
            err += abs(y - mu)
        assert errors[g["business_id"]]["deviance_sum"] == pytest.approx(dev)
        assert errors[g["business_id"]]["error_sum"] == pytest.approx(err)


def test_projection_sums_its_days_and_guards_dates(world):
    *_, groups = world
    span = Span(date(2019, 1, 1), date(2019, 3, 15))
    total = {r["business_id"]: r["projected"] for r in fc.project(groups, span, TRAIN.end, CONFIG).collect()}
    daily = fc.daily_projection(groups, span).groupBy("business_id").agg(F.sum("projected").alias("p")).collect()
    assert all(total[r["business_id"]] == pytest.approx(r["p"]) for r in daily)
    with pytest.raises(ValueError):
        fc.project(groups, TRAIN, TRAIN.end, CONFIG)
    long = Span(date(2019, 1, 1), date(2038, 12, 31))
    assert fc.project(groups, long, TRAIN.end, CONFIG).count() == len(total)
    with pytest.raises(ValueError):
        fc.fit(world[1], world[2], ["metro"], Span(date(2010, 1, 1), date(2018, 1, 1)), COVERAGE, CONFIG)


def test_batches_are_bounded_and_ordered(spark):
    groups = spark.range(300).select(F.col("id").alias("business_id"), F.lit("m").alias("metro"))
    rows = fc.batches(groups, ["metro"], 128).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("business_id").alias("a")).orderBy("batch").collect()
    assert [(r["n"], r["a"]) for r in rows] == [(128, 0), (128, 128), (44, 256)]


def weather_world(spark, n_days=400, seed=4):
    """Three businesses of one scope at two stations with a known weather effect."""
    rng = np.random.default_rng(seed)
    days, hits = [], []
    for station in ("S0", "S1"):
        for i in range(n_days):
            day, low = date(2017, 1, 1) + timedelta(i), float(rng.normal(5, 5))
            high, rain = low + float(rng.gamma(2, 4)), float(rng.gamma(1, 2))
            days.append((station, day, low, high if i % 50 else None, rain))
            for b, at in ((0, "S0"), (1, "S0"), (2, "S1")):
                count = int(rng.poisson(np.exp(-1.5 + 0.6 * b + 0.05 * high)))
                if at == station and count:
                    hits.append((b, day, count))
    groups = spark.createDataFrame([(0, "m", "S0"), (1, "m", "S0"), (2, "m", "S1"), (3, "m", "S1"), (4, "m", None)],
                                   "business_id long, metro string, station_id string")
    daily = spark.createDataFrame(hits, "business_id long, day date, checkins long")
    weather = spark.createDataFrame(days, "station_id string, day date, tmin double, tmax double, pcpn double")
    return groups, daily, weather, Span(date(2017, 1, 1), date(2017, 1, 1) + timedelta(n_days - 1))


def test_fit_converges_meets_totals_and_maximises(spark):
    groups, daily, weather, span = weather_world(spark)
    fitted = ml.fit(groups, daily, weather, span, span, ["metro"])
    effects = {r["model"]: r for r in fitted.effects.collect()}
    assert set(effects) == set(ml.WEATHER_MODELS) and all(r["converged"] for r in effects.values())
    rows = ml.panel(groups, daily, weather, span, span, ["metro"])
    got = ml.predict(fitted, rows, ["metro"]).toPandas()
    assert set(got.business_id) == {0, 1, 2} and (got.predicted > 0).all()  # 3 has no visits, 4 no station
    for (_, model), part in got.groupby(["business_id", "model"]):
        assert part.predicted.sum() == pytest.approx(part.checkins.sum(), rel=1e-9)
    for model, r in effects.items():
        part = got[got.model == model]
        x = ml._design(part, model, r["scaling"])
        gradient = x.T @ (part.predicted - part.checkins) / r["observations"] + 0.01 * np.array(r["theta"])
        assert np.abs(gradient).max() < 1e-5 and r["observations"] == len(part)
        mean = part.groupby("business_id").checkins.transform("mean")
        assert deviance(part.checkins, part.predicted) < 0.97 * deviance(part.checkins, mean)


def deviance(y, mu):
    return 2 * float(np.mean(mu - y + np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0)))


def test_spline_basis_sums_to_one_and_continues_linearly():
    x = np.linspace(0, 10, 21)
    full = ml._basis(x, 0.0, 10.0)
    assert full.shape == (21, 6) and (full.sum(axis=1) <= 1 + 1e-12).all()
    out = ml._basis(np.array([10.0, 11.0, 12.0]), 0.0, 10.0)
    np.testing.assert_allclose(out[2] - out[1], out[1] - out[0], atol=1e-12)
    inner = ml._basis(np.array([10.0 - 1e-6, 10.0]), 0.0, 10.0)
    np.testing.assert_allclose((inner[1] - inner[0]) / 1e-6, out[1] - out[0], atol=1e-4)


def test_unfitted_scopes_and_unknown_models(spark):
    groups, daily, weather, span = weather_world(spark, 40)
    none = ml.fit(groups, daily.where("false"), weather, span, span, ["metro"], ["poisson"])
    assert none.effects.count() == 0 and none.owns.count() == 0
    with pytest.raises(ValueError):
        ml.fit(groups, daily, weather, span, span, ["metro"], ["boosted"])
    with pytest.raises(ValueError):
        ml.fit(groups, daily, weather, span, Span(span.start, span.start), ["metro"])


def test_repeated_readings_fail_the_models_days(spark):
    from footmark.operators import weather as wx
    reports = spark.createDataFrame([("S", date(2020, 1, 1), "tmax", 70.0, "70", "", "degreeF", False)] * 2,
                                    "station_id string, day date, variable string, value double, raw_value string, flag string, unit string, is_trace boolean")
    assert wx.station_days(reports).count() == 1
    with pytest.raises(Exception, match="repeated"):
        wx.station_days(reports, unique=True).collect()


@pytest.mark.parametrize("start,end", [((2020, 2, 27), (2020, 3, 2)), ((2019, 12, 31), (2031, 1, 1)), ((2020, 5, 5), (2020, 5, 5))])
def test_exposure_equals_counting_days(start, end):
    span, want = Span(date(*start), date(*end)), [0] * 84
    for i in range(span.days):
        d = span.start + timedelta(i)
        want[(d.month - 1) * 7 + d.weekday()] += 1
    assert fc.exposure(span) == want


def test_observed_period_needs_every_day(spark):
    groups = spark.createDataFrame([(1, "m", 0, "S0"), (2, "m", 0, "S1")],
                                   "business_id long, metro string, batch int, station_id string")
    d = date(2020, 1, 1)
    days = spark.createDataFrame([("S0", d, 1.0, 2.0, 0.0), ("S0", d + timedelta(1), 1.0, 2.0, 0.0),
                                  ("S1", d, 1.0, 2.0, 0.0), ("S1", d + timedelta(1), 1.0, None, 0.0)],
                                 "station_id string, day date, tmin double, tmax double, pcpn double")
    rows = ml.observed_days(groups, days, Span(d, d + timedelta(1)), ["metro"]).collect()
    assert sorted((r["business_id"], r["day"]) for r in rows) == [(1, d), (1, d + timedelta(1))]


def test_scenario_leaves_out_months_without_normals(spark):
    groups = spark.createDataFrame([(1, "m", "p", 0), (2, "m", "p", 0)],
                                   "business_id long, metro string, parent string, batch int")
    normals = spark.createDataFrame([(1, "p", 4, 1.0, 2.0, 0.0), (1, "p", 5, 1.0, 2.0, 0.0), (2, "p", 4, 1.0, 2.0, 0.0)],
                                    "business_id long, parent string, month int, tmin double, tmax double, pcpn double")
    cells = ml.scenario_cells(groups, normals, ["metro", "parent"], [4, 5])
    assert {r["business_id"] for r in cells.collect()} == {1} and cells.count() == 14
    with pytest.raises(ValueError):
        ml.explicit_weather(groups, ["metro"], date(2020, 1, 1), (5.0, 1.0, 0.0))


def test_county_change_units_and_rolling(spark):
    rows = [("c", v, "historical_modeled", "h", y, val) for y in range(1976, 2006) for v, val in (("tmax", 50.0), ("pcpn", 1.0))]
    rows += [("c", v, "projections", "r", y, val) for y in range(2030, 2060) for v, val in (("tmax", 68.0), ("pcpn", 2.0))]
    df = spark.createDataFrame(rows, "county_fips string, variable string, dataset string, scenario string, year int, value double")
    full = df.withColumns({"frequency": F.lit("annual"), "statistic": F.lit("weighted_mean"), "period": F.col("year").cast("string")}).drop("year")
    pro = lr.projections(lr.annual(full))
    context = spark.createDataFrame([("c", 7)], "county_fips string, businesses long")
    got = {r["variable"]: r["change"] for r in lr.window_changes(pro, context).collect()}
    assert got["tmax"] == pytest.approx(10.0) and got["pcpn"] == pytest.approx(100.0)
    smooth = lr.rolling_mean(pro, ["county_fips", "variable"], "change").where("variable = 'tmax'").orderBy("year").collect()
    assert [r["smooth"] is None for r in smooth[:10]] == [True] * 9 + [False]


def brute_scores(part):
    return {"businesses": part.business_id.nunique(), "observations": len(part), "poisson_deviance": deviance(part.checkins, part.predicted),
            "mae": float(np.abs(part.checkins - part.predicted).mean()), "recorded_checkins": part.checkins.sum(),
            "predicted_checkins": part.predicted.sum()}


def test_sums_of_station_days_equal_the_dense_panel(spark):
    groups, daily, weather, span = weather_world(spark)
    groups = groups.withColumns({"overall_rate": F.lit(0.2) + F.col("business_id"), "rates": F.transform(
        F.sequence(F.lit(1), F.lit(84)), lambda i: i / F.lit(40.0) + F.col("business_id"))})
    fitted = ml.fit(groups, daily, weather, span, span, ["metro"])
    dense = ml.panel(groups, daily, weather, span, span, ["metro"])
    rows = ml.predict(fitted, dense, ["metro"]).toPandas()
    sums = {r["model"]: r for r in ml.training_sums(fitted, groups, daily, weather, span, ["metro"]).collect()}
    for model, part in rows.groupby("model"):
        assert sums[model]["businesses"] == 3 and sums[model]["observations"] == len(part)
        assert sums[model]["recorded"] == part.checkins.sum() and sums[model]["fitted"] == pytest.approx(part.predicted.sum())
    calendars = ["overall_mean", "month_weekday_shrunk"]
    scores = {r["model"]: r for r in ml.model_scores(fitted, groups, daily, weather, span, ["metro"], calendars, ["metro"]).collect()}
    frame = {r["business_id"]: r for r in groups.collect()}
    base = rows[rows.model == "poisson"]
    for name in calendars:
        rate = [frame[r.business_id]["overall_rate"] if name == "overall_mean" else frame[r.business_id]["rates"][(r.month - 1) * 7 + r.weekday]
                for r in base.itertuples()]
        rows = pd.concat([rows, base.assign(model=name, predicted=rate)])
    for model, part in rows.groupby("model"):
        for name, value in brute_scores(part).items():
            assert scores[model][name] == pytest.approx(value, rel=1e-9), (model, name)


def test_periods_are_two_look_ups_and_need_every_day(spark):
    groups, daily, weather, span = weather_world(spark)
    fitted = ml.fit(groups, daily, weather, span, span, ["metro"], ["poisson"])
    effects = ml.station_effects(fitted, groups, weather, span, ["metro"])
    index, who = ml.day_index(effects, ["metro"]), ml.members(fitted, groups, ["metro"])
    d = date(2017, 1, 1)
    wanted = [("S0", "whole", d + timedelta(1), d + timedelta(49)), ("S0", "one", d + timedelta(3), d + timedelta(3)),
              ("S0", "gap", d + timedelta(40), d + timedelta(60)), ("S1", "starts in a gap", d, d + timedelta(5))]
    periods = spark.createDataFrame(wanted, "station_id string, period string, start_day date, end_day date")
    got = {(r["period"], r["business_id"]): r for r in ml.period_totals(index, who, periods, ["metro"]).collect()}
    assert set(got) == {("whole", 0), ("whole", 1), ("one", 0), ("one", 1)}
    by_day = ml.predict(fitted, ml.panel(groups, daily, weather, span, span, ["metro"]), ["metro"]).toPandas()
    for (name, business), r in got.items():
        part = by_day[(by_day.business_id == business) & (by_day.day >= r["start_day"]) & (by_day.day <= r["end_day"])]
        assert r["projected"] == pytest.approx(part.predicted.sum()) and r["daily_rate"] == pytest.approx(part.predicted.mean())
    runs = {(r["station_id"], r["month"]): r for r in ml.complete_runs(weather, span).collect()}
    january = runs["S0", d]
    assert (january["run_start"], january["run_days"], january["complete_days"], january["whole"]) == (d + timedelta(1), 30, 30, False)
    assert runs["S0", date(2017, 3, 1)]["whole"] and runs["S0", date(2017, 2, 1)]["run_days"] == 19
    assert runs["S0", date(2017, 2, 1)]["complete_days"] == 27


def test_scenarios_sum_calendar_cells_of_given_weather(spark):
    groups, daily, weather, span = weather_world(spark)
    fitted = ml.fit(groups, daily, weather, span, span, ["metro"], ["gam_poisson"])
    ahead = Span(date(2019, 1, 10), date(2019, 2, 20))
    normals = ml.station_normals(weather, span)
    mean = weather.na.drop().where("station_id = 'S0' AND month(day) = 2").agg(F.avg("tmin")).first()[0]
    assert normals.where("station_id = 'S0' AND month = 2").first()["tmin"] == pytest.approx(mean)
    got = {r["business_id"]: r for r in ml.scenario_totals(fitted, groups, normals, fc.exposure(ahead), ["metro"]).collect()}
    held = {(r["station_id"], r["month"]): r for r in normals.collect()}
    days = [(b, "m", s, ahead.start + timedelta(i)) for b, s in ((0, "S0"), (1, "S0"), (2, "S1")) for i in range(ahead.days)]
    rows = spark.createDataFrame(
        [(b, m, d.month, d.weekday(), *[held[s, d.month][c] for c in ml.WEATHER]) for b, m, s, d in days],
        "business_id long, metro string, month int, weekday int, tmin double, tmax double, pcpn double")
    want = ml.predict(fitted, rows, ["metro"]).groupBy("business_id").agg(F.sum("predicted").alias("p")).collect()
    assert set(got) == {0, 1, 2}
    for r in want:
        assert got[r["business_id"]]["projected"] == pytest.approx(r["p"])
        assert got[r["business_id"]]["daily_rate"] == pytest.approx(r["p"] / ahead.days)
    assert ml.scenario_totals(fitted, groups, normals.where("month != 2 OR station_id = 'S1'"), fc.exposure(ahead), ["metro"]).count() == 1
    with pytest.raises(Exception, match="coherent"):
        ml.coherent(normals.withColumn("pcpn", F.lit(-1.0))).collect()


def test_places_of_equal_predictions_follow_ids(spark):
    rows = spark.createDataFrame([(3, "m", 1.0, "x"), (1, "m", 1.0, "x"), (2, "m", 2.0, "x"), (4, "m", 9.0, "y")],
                                 "business_id int, model string, predicted double, basis string")
    got = sorted((r["basis"], r["place"], r["business_id"]) for r in ml.top_of(rows, ["basis"], 2).collect())
    assert got == [("x", 1, 2), ("x", 2, 1), ("y", 1, 4)]


def test_calendar_cells_make_their_map_once(spark):
    rows = spark.createDataFrame([(b, c, 10 * b + c) for b in (1, 2) for c in range(b, 84, 5)], "b int, cell int, n long")
    found = rows.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("found"))
    got = found.select("b", fc._cells("found").alias("counts"))
    for r in got.collect():
        assert r["counts"] == [float(10 * r["b"] + c) if c >= r["b"] and (c - r["b"]) % 5 == 0 else 0.0 for c in range(84)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1 and "lambda" not in plan


def test_a_run_reads_its_observations_once(spark, monkeypatch):
    from footmark.plans import forecast as plans
    reads = []
    for name in ("activity", "station_reports"):
        real = getattr(plans, name)
        monkeypatch.setattr(plans, name, lambda *a, real=real, name=name: reads.append(name) or real(*a))
    rows = plans.experiment_stages(spark, "/root/testdata/sf0.001").collect()
    assert {r["stage"] for r in rows} == {"validation", "test", "final"}
    assert sorted(reads) == ["activity", "station_reports"]
