import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from footmark.config import METRIC_KEYS, PRESETS, ScoringConfig
from footmark.functions.dates import Span
from footmark.operators import sites, site_tables, spatial
from footmark.operators import uncertainty as un


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(
        math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("lat,lon,radius", [(40.0, -75.0, 3.0), (0.01, 179.99, 5.0), (66.0, 10.0, 1.0), (40.0, -75.0, 40.0)])
def test_radius_counts_equal_brute_force(spark, lat, lon, radius):
    rng = np.random.default_rng(1)
    spread = radius / 40
    wrap = lambda x: (x + 180) % 360 - 180
    pts = [("m" if i % 3 else "n", float(lat + rng.normal() * spread), float(wrap(lon + rng.normal() * spread * 1.5)))
           for i in range(500)]
    pts += [("m", lat, wrap(lon))] * 200  # one crowded point
    centres = [("m", i, float(lat + rng.normal() * spread / 2), float(wrap(lon + rng.normal() * spread)))
               for i in range(8)] + [("m", 99, None, None)]
    p = spark.createDataFrame(pts + [("m", None, 1.0)], "scope string, latitude double, longitude double")
    c = spark.createDataFrame(centres, "scope string, area_id int, latitude double, longitude double")
    got = {r["area_id"]: r["n"] for r in spatial.within_radius(c, p, ["scope", "area_id"], ["scope"], radius).collect()}
    want = {i: sum(s == "m" and km(a, b, y, x) <= radius for s, y, x in pts) for _, i, a, b in centres if a is not None}
    assert got == {k: v for k, v in want.items() if v} and 99 not in got


FX = [("33601", 1, 0.010, 5.0, 1.0, None, None, 0.9), ("33602", 2, 0.020, 2.0, 2.0, None, None, 0.8),
      ("33603", 3, 0.020, 2.0, None, None, None, 0.7), ("33604", 4, 0.030, 0.0, 3.0, None, None, None)]
COLS = "postal_code string, area_id long, " + ", ".join(f"{m} double" for m in METRIC_KEYS)


def metrics(spark):
    return spark.createDataFrame(FX, COLS).withColumn("scope", F.lit("s"))


def test_percentiles_of_four_areas(spark):
    rows = sites.percentiles(sites.metric_rows(metrics(spark), ["scope", "area_id"]), ["scope"]).collect()
    p = {(r["metric"], r["area_id"]): r["p"] for r in rows}
    assert [p["demand_rate", i] for i in (1, 2, 3, 4)] == [0.0, 0.5, 0.5, 1.0]
    assert [p["competition", i] for i in (1, 2, 3, 4)] == [0.0, 0.5, 0.5, 1.0]
    assert [p["quality_gap", i] for i in (1, 2, 3, 4)] == [0.0, 0.5, None, 1.0]
    assert p["momentum", 1] is None


def test_scores_sum_contributions_and_rank_stably(spark):
    cfg = ScoringConfig()
    rows = sites.score_areas(metrics(spark), ["scope"], cfg).collect()
    assert len(rows) == 4 * len(PRESETS)
    for r in rows:
        assert r["score"] == pytest.approx(sum(f["contribution"] for f in r["factors"]))
        assert sum(f["effective_weight"] for f in r["factors"]) == pytest.approx(1.0)
        assert r["key_strength"] in METRIC_KEYS and len(r["top_factors"]) == 3
    balanced = sorted((r["rank"], r["postal_code"]) for r in rows if r["preset"] == "Balanced")
    assert balanced[0] == (1, "33604") and [x[0] for x in balanced] == [1, 2, 3, 4]
    again = sites.score_areas(metrics(spark).repartition(3), ["scope"], cfg).collect()
    key = lambda x: (x["preset"], x["area_id"])
    assert [(r["rank"], r["score"]) for r in sorted(rows, key=key)] == [
        (r["rank"], r["score"]) for r in sorted(again, key=key)]


def test_zero_weights_fall_back_to_equal(spark):
    rows = sites.percentiles(sites.metric_rows(metrics(spark), ["scope", "area_id"]), ["scope"])
    only = rows.withColumn("weights", F.array(*[F.lit(1.0 if m == "momentum" else 0.0) for m in METRIC_KEYS]))
    got = sites.factors(only, ["scope", "area_id"]).collect()
    assert all(r["equal_weight_fallback"] for r in got)
    full = next(r for r in got if r["area_id"] == 1)
    assert [f["effective_weight"] for f in full["factors"]] == [0.25, 0.25, 0.25, 0.0, 0.0, 0.25]


def test_weather_effects_by_hand(spark):
    cfg = ScoringConfig(min_weather_days=3)
    span = Span(date(2020, 1, 1), date(2020, 1, 12))
    reports, activity = [], []
    for i in range(12):
        day = date(2020, 1, 1) + timedelta(i)
        reports.append(("S", day, "pcpn", 1.0 if i < 4 else 0.0, "inch", "", "", False))
        reports.append(("S", day, "tmax", 100.0 if i % 2 else 50.0, "degreeF", "", "", False))
        activity.append((1, day, 9, 2 if i < 4 else 4))
    r = spark.createDataFrame(reports, "station_id string, day date, variable string, value double, unit string, "
                              "raw_value string, flag string, is_trace boolean")
    a = spark.createDataFrame(activity, "business_id long, day date, hour int, n long")
    b = spark.createDataFrame([(1, "s", 7, "S", True)],
                              "business_id long, scope string, area_id int, station_id string, in_niche boolean")
    row = sites.weather_effects(r, a, b, ["scope"], span, cfg).first()
    assert (row["wet_days"], row["dry_days"], row["hot_days"], row["observed_days"]) == (4, 8, 6, 12)
    assert row["rain_effect"] == pytest.approx(-0.5) and row["heat_effect"] == pytest.approx(0.0)
    assert row["weather_resilience"] == pytest.approx(0.75)


def test_seed_is_the_low_half_of_eight_digest_bytes(spark):
    import hashlib
    text = "a|b|c"
    want = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % 2**32
    got = spark.range(1).select(sites.scope_seed(F.lit("a"), F.lit("b"), F.lit("c")).alias("s")).first()["s"]
    assert got == want


def ridge(x, y, alphas):
    """One fit by the book: impute, standardize, and the penalty of least leave-one-out squared error."""
    known = x[~np.isnan(x[:, 1]), 1]
    fill = known.mean() if known.size else 0.0
    x = np.where(np.isnan(x), fill, x)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z, best = (x - mean) / np.where(scale > 1e-9, scale, 1.0), None
    for alpha in alphas:
        inverse = np.linalg.inv(z.T @ z + alpha * np.eye(4))
        leverage = np.einsum("ij,jk,ik->i", z, inverse, z) + 1 / len(y)
        coef = inverse @ z.T @ (y - y.mean())
        error = ((((y - y.mean() - z @ coef) / (1 - leverage)) ** 2).mean(), alpha, coef)
        best = error if best is None or error[0] < best[0] else best
    return lambda new: (np.where(np.isnan(new), fill, new) - mean) / np.where(scale > 1e-9, scale, 1.0) @ best[2] + y.mean()


def test_leave_one_out_equals_refitting(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 4))
    x[2, 1] = np.nan
    y = 1 + 2 * x[:, 0] + rng.normal(size=12) * 0.1
    rows = spark.createDataFrame(
        [("s", i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(12)],
        "scope string, area_id int, f0 double, f1 double, f2 double, f3 double, y double")
    cfg = ScoringConfig()
    got = {r["area_id"]: r["residual"] for r in un.leave_one_out(rows, ["scope"], cfg).collect()}
    for i in range(12):
        rest = np.arange(12) != i
        assert got[i] == pytest.approx(y[i] - ridge(x[rest], y[rest], cfg.ridge_alphas)(x[i:i + 1])[0])
    report = un.estimator_report(rows, un.leave_one_out(rows, ["scope"], cfg), ["scope"]).first()
    assert report["reason"] == "ok" and report["n_train"] == 12 and 0 < report["skill"] < 1
    few = rows.where("area_id < 5")
    assert un.estimator_report(few, un.leave_one_out(few, ["scope"], cfg), ["scope"]).first()["reason"] == (
        "insufficient_training_areas")


@pytest.mark.parametrize("unknown,constant", [(0, False), (3, False), (30, False), (2, True)])
def test_estimator_from_sums_equals_the_fit_on_rows(spark, unknown, constant):
    rng = np.random.default_rng(unknown)
    x = rng.normal(size=(30, 4)) * [1, 0.5, 3, 2] + [5, 3.5, 2, 1]
    x[:unknown, 1], x[:, 2] = np.nan, 4.0 if constant else x[:, 2]
    y = 1 + 0.3 * x[:, 0] + rng.normal(size=30)
    rows = spark.createDataFrame(
        [("s", i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i]) if i < 25 or unknown == 30 else None)
         for i in range(30)], "scope string, area_id int, f0 double, f1 double, f2 double, f3 double, y double")
    cfg, n = ScoringConfig(), 30 if unknown == 30 else 25
    whole = ridge(x[:n], y[:n], cfg.ridge_alphas)
    report = spark.createDataFrame([("s", "ok", 0.5)], "scope string, reason string, residual_sd double")
    rates = spark.createDataFrame([("s", 0.25)], "scope string, metro_rate double")
    got = {r["area_id"]: r for r in un.model_rates(rows, report, rates, ["scope"], cfg).collect()}
    for i in range(30):
        assert got[i]["model_rate"] == pytest.approx(max(0.0, math.expm1(whole(x[i:i + 1])[0]) / 1000)) and not got[i]["model_fallback"]
    off = un.model_rates(rows, report.where("false"), rates, ["scope"], cfg).collect()
    assert len(off) == 30 and all(r["model_rate"] == 0.25 and r["model_fallback"] for r in off)


def test_picks_follow_their_digests(spark):
    import hashlib
    rows = spark.createDataFrame([(3, f"b{i}", 2 if i == 1 else 1, 11, float(10**i)) for i in range(5)],
                                 "area_id int, id string, w long, seed long, v double")
    got = {r["draw"]: r["v"] for r in un.resample(rows, ["area_id"], "id", "w", ["v"], "seed", 7, 20).collect()}
    members = [1.0, 10.0, 10.0, 100.0, 1000.0, 10000.0]
    for draw in range(20):
        total = 0.0
        for slot in range(6):
            digest = hashlib.md5(f"11:3:7:{draw}:{slot // 4}".encode()).hexdigest()
            number = int(digest[8 * (slot % 4):8 * (slot % 4) + 8], 16)
            total += members[number * 6 >> 32]
        assert got[draw] == total


def test_noise_is_normal_and_repeatable(spark):
    rows = spark.range(4000).select(F.lit(5).alias("seed"), F.lit(9).alias("area_id"), F.col("id").alias("draw"), F.lit(2.0).alias("sd"))
    values = [[r[0] for r in df.select(un.noise("seed", 2, "draw", "sd")).collect()] for df in (rows, rows.repartition(3, "draw"))]
    assert sorted(values[0]) == sorted(values[1])
    assert abs(np.mean(values[0])) < 0.13 and abs(np.std(values[0]) - 2) < 0.1


def test_resampling_keeps_totals_and_is_repeatable(spark):
    rows = spark.createDataFrame([(3, i, 1, 11, 1.0, float(i)) for i in range(100)],
                                 "area_id int, id long, w int, seed long, one double, v double")
    runs = [un.resample(rows.repartition(n), ["area_id"], "id", "w", ["one", "v"], "seed", 0, 200).toPandas()
            .sort_values("draw") for n in (1, 5)]
    assert (runs[0]["one"] == 100).all() and len(runs[0]) == 200
    assert runs[0]["v"].tolist() == runs[1]["v"].tolist()
    assert abs(runs[0]["v"].mean() - 4950) < 4 * 100 * 28.9 / 10 / math.sqrt(200) + 60
    assert 150 < runs[0]["v"].std() < 450  # sqrt(100) * 28.9 for one multinomial


def test_resampling_many_members_of_one_area(spark):
    rows = spark.range(200_000).select(F.lit(3).alias("area_id"), "id", F.lit(1).alias("w"), F.lit(11).cast("long").alias("seed"),
                                       F.lit(1.0).alias("one"), (F.col("id") % 7).cast("double").alias("v"))
    got = un.resample(rows, ["area_id"], "id", "w", ["one", "v"], "seed", 0, 40).toPandas()
    assert len(got) == 40 and (got["one"] == 200_000).all()
    assert abs(got["v"].mean() - 600_000) < 4 * 2 * math.sqrt(200_000) and got["v"].std() > 300


def test_members_of_one_row_are_dealt_out_before_they_draw(spark):
    tasks, many = int(spark.conf.get("spark.sql.shuffle.partitions")), 40 * un.CHUNK + 5
    rows = spark.createDataFrame([(3, "a", many, 11), (3, "b", 2, 11), (4, "a", 0, 11)], "area_id int, id string, w long, seed long")
    placed = un.slots(rows, ["area_id"], ["id"], "w")
    got = placed.withColumn("task", F.spark_partition_id()).toPandas()
    assert sorted(got["slot"]) == list(range(many + 2)) and set(got["area_id"]) == {3} and set(got["_n"]) == {many + 2}
    assert set(got["slot"][got["id"] == "b"]) == {many, many + 1}
    assert placed.rdd.getNumPartitions() == tasks and got.groupby("task").size().max() < many / 2


def test_intervals_contain_the_point(spark):
    cfg = ScoringConfig()
    points = spark.createDataFrame([("s", 1, 1, 80.0), ("s", 2, 2, 75.0), ("s", 3, 3, 10.0)],
                                   "scope string, area_id int, rank long, score double")
    rng = np.random.default_rng(0)
    drawn = spark.createDataFrame(
        [("s", a, d, round(float(m + rng.normal() * 6), 9)) for d in range(200)
         for a, m in ((1, 80), (2, 78), (3, 10))], "scope string, area_id int, draw int, draw_score double")
    rows = {r["area_id"]: r for r in un.intervals(points, drawn, ["scope"], cfg).collect()}
    for r in rows.values():
        assert r["score_low"] <= r["score"] <= r["score_high"] and r["rank_low"] <= r["rank"] <= r["rank_high"]
    assert rows[2]["tied_with_above"] and not rows[3]["tied_with_above"] and not rows[1]["tied_with_above"]


def test_general_format_and_question_text(spark):
    df = spark.createDataFrame([(12.5,), (0.1234567,), (100.0,), (None,), (1234567.0,), (0.00001234,)], "v double")
    assert [r[0] for r in df.select(site_tables.general(F.col("v"))).collect()] == [
        "12.5", "0.123457", "100", "", "1.23457e+06", "1.234e-05"]
    values = [0.0, -0.5, 1.0, 999999.4, 0.0001, 0.00012345678, 123456.0, 10.0, -1234567.0, 1e-5, 3.14159265, 1e100, 20.25]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r[0] for r in rows.select(site_tables.general(F.col("v"))).collect()] == [f"{v:.6g}" for v in values]
    assert spark.range(1).select(F.format_string("%.1f", F.lit(0.25))).first()[0] == "0.3"
    text = spark.createDataFrame([(" a\t\n b\u0000c ",), ("   ",), (None,), ("x" * 400,)], "t string")
    got = [r[0] for r in text.select(site_tables.clean_question(F.col("t"), 300)).collect()]
    assert got == ["a bc", None, None, "x" * 300]
    assert text.select(site_tables.clean_question(F.col("t"))).collect()[3][0] == "x" * 400


@pytest.mark.parametrize("shape", ["spread", "far", "poles", "wrap"])
def test_nearest_site_equals_brute_force(spark, shape):
    rng = np.random.default_rng(len(shape))
    wrap = lambda x: (x + 180) % 360 - 180
    lat = {"spread": 10 + rng.normal(size=80) * 3, "far": rng.uniform(-60, 60, 80), "poles": rng.uniform(80, 89.9, 80),
           "wrap": rng.normal(size=80)}[shape]
    lon = wrap({"spread": 20 + rng.normal(size=80) * 3, "far": rng.uniform(-180, 180, 80), "poles": rng.uniform(-180, 180, 80),
                "wrap": 179.5 + rng.normal(size=80)}[shape])
    points = [(float(a), float(b)) for a, b in zip(lat, lon)]
    sites_ = [(i, points[i][0] + 0.3, float(wrap(points[i][1] - 0.4))) for i in range(0, 80, 9)] + [(90, 0.0, 0.0), (91, 0.0, 0.0), (92, None, 1.0)]
    sites_ = [(i, None if a is None else min(a, 89.99), b) for i, a, b in sites_]
    p = spark.createDataFrame(points + points[:5] + [(None, 1.0)], "latitude double, longitude double")
    s = spark.createDataFrame(sites_, "site int, latitude double, longitude double")
    got = {(r["latitude"], r["longitude"]): (r["site"], r["km"]) for r in spatial.nearest(p, s, "site").collect()}
    assert set(got) == set(points)
    for a, b in points:
        want = min((km(a, b, y, x), i) for i, y, x in sites_ if y is not None)
        assert got[a, b][0] == want[1] and got[a, b][1] == pytest.approx(want[0], abs=1e-6)
    assert spatial.nearest(p, s.where("site > 91"), "site").count() == 0
    assert spatial.nearest(p.where("false"), s, "site").count() == 0


def test_crowded_cells_are_dealt_out_by_their_count(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SALT_ROWS", 100)
    rng = np.random.default_rng(8)
    pts = [(float(40 + rng.normal() * 0.02), float(-75 + rng.normal() * 0.02)) for _ in range(1000)]
    pts += [(float(40 + rng.uniform(0, 0.001)), float(-75 + rng.uniform(0, 0.001))) for _ in range(500)]  # a third in one cell
    p = spark.createDataFrame(pts, "latitude double, longitude double")
    cell = p.withColumns({"r": F.floor(F.col("latitude") * 200), "c": F.floor(F.col("longitude") * 200)})
    salts = {(r["r"], r["c"]): r["_salts"] for r in spatial.crowded_cells(cell, ["r", "c"]).collect()}
    sizes = {(r["r"], r["c"]): r["count"] for r in cell.groupBy("r", "c").count().collect()}
    assert salts == {k: math.ceil(n / 100) for k, n in sizes.items() if n > 100} and max(salts.values()) >= 5
    heavy = max(salts, key=salts.get)
    parts = cell.where((F.col("r") == heavy[0]) & (F.col("c") == heavy[1])).groupBy(
        F.pmod(F.xxhash64("latitude", "longitude"), F.lit(salts[heavy]))).count().collect()
    counts = sorted(r["count"] for r in parts)
    assert counts[-1] <= 2 * counts[len(counts) // 2]
    c = spark.createDataFrame([(1, 40.0005, -74.9995), (2, 40.01, -75.0)], "area_id int, latitude double, longitude double")
    got = {r["area_id"]: r["n"] for r in spatial.within_radius(c, p, ["area_id"], [], 1.0).collect()}
    assert got == {i: sum(km(a, b, y, x) <= 1.0 for y, x in pts) for i, a, b in ((1, 40.0005, -74.9995), (2, 40.01, -75.0))}
