"""Projection questions: calendar models, weather models, experiment runs, county scenarios."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from footmark.config import ForecastConfig
from footmark.functions import dates
from footmark.functions.dates import Span
from footmark.operators import activity as act
from footmark.operators import business as biz
from footmark.operators import forecast as fc
from footmark.operators import longrun as lr
from footmark.operators import models as ml
from footmark.operators import quality as dq
from footmark.operators import weather as wx
from footmark.plans import weather
from footmark.plans.activity import COVERED_MONTHS, summary_sql
from footmark.plans.domain import (
    COVERAGE, FUTURE, MONTHS, SCOPE, WEATHER_COVERAGE, activity, businesses, sql, station_reports, table, tidy,
)
from footmark.session import checkpointed, scratch_path
from footmark.sinks import versions as vs
from footmark.sources import files

CONFIG = ForecastConfig(min_training_checkins=5)  # the tables hold about ten orders a customer
WINDOWS = {
    "validation": (Span(date(1996, 1, 1), date(1998, 12, 31)),
                   Span(date(1999, 1, 1), date(1999, 12, 31))),
    "test": (Span(date(1997, 1, 1), date(1999, 12, 31)),
             Span(date(2000, 1, 1), date(2000, 12, 31))),
}
FINAL = Span(date(1998, 1, 1), date(2000, 12, 31))
AHEAD = FUTURE.after(COVERAGE)
LATER = Span(date(2001, 1, 1), WEATHER_COVERAGE.end)  # every day after the training window that has weather
METRO = ["metro"]


def _daily(spark, sf):
    return act.business_days(activity(spark, sf, COVERAGE), COVERAGE)


def _groups(spark, sf, span=FINAL, daily=None):
    return fc.fit(_daily(spark, sf) if daily is None else daily, businesses(spark, sf), METRO, span, COVERAGE, CONFIG)


def calendar_fit(spark, sf):
    return tidy(_groups(spark, sf).select(
        "business_id", "metro", "parent", "training_checkins", "active_days", "overall_rate",
        F.posexplode("rates").alias("cell", "rate")))


def _errors(spark, sf, model):
    train, assess = WINDOWS["test"]
    groups = fc.with_model(_groups(spark, sf, train), model)
    return fc.business_errors(groups, _daily(spark, sf), assess)


def business_errors(spark, sf):
    return tidy(_errors(spark, sf, "month_weekday_shrunk").select(
        "business_id", "observed", "predicted", "deviance_sum", "error_sum"))


def _selection(spark, sf):
    return fc.temporal_selection(
        _daily(spark, sf), businesses(spark, sf), METRO, COVERAGE, CONFIG, WINDOWS)


def temporal_scores(spark, sf):
    return tidy(_selection(spark, sf).drop("model_order"))


def selected_model(spark, sf):
    return tidy(fc.select_model(_selection(spark, sf).where("stage = 'validation'")))


def niche_agreement(spark, sf):
    return tidy(fc.niche_agreement(_errors(spark, sf, "month_weekday_shrunk"), METRO))


def rank_pairs(spark, sf):
    rows = fc.observed_and_predicted_ranks(_errors(spark, sf, "month_weekday_shrunk"), SCOPE)
    return tidy(rows.select("metro", "parent", "business_id", "observed_rank", "predicted_rank"))


def _projected(spark, sf):
    return fc.project(_groups(spark, sf), AHEAD, FINAL.end, CONFIG)


def projection(spark, sf):
    return tidy(_projected(spark, sf).select("business_id", "projected", "daily_rate"))


def scope_projection(spark, sf):
    return tidy(fc.scope_projection(_groups(spark, sf), SCOPE, AHEAD))


def daily_projection(spark, sf):
    rows = fc.daily_projection(_groups(spark, sf), AHEAD)
    return tidy(rows.select("business_id", "day", "projected"))


def tag_projection(spark, sf):
    return tidy(fc.tag_projection(_projected(spark, sf), businesses(spark, sf), METRO))


def map_table(spark, sf):
    totals = act.business_totals(activity(spark, sf, COVERED_MONTHS), COVERED_MONTHS)
    rows = biz.summaries(businesses(spark, sf), totals, COVERED_MONTHS)
    projected = _projected(spark, sf).select("business_id", "projected")
    return tidy(biz.map_table(rows, projected, SCOPE, True))


def headline(spark, sf):
    """Recorded and projected totals of every scope, beside ratings and typical activity."""
    totals = act.business_totals(activity(spark, sf, COVERED_MONTHS), COVERED_MONTHS)
    rows = biz.summaries(businesses(spark, sf), totals, COVERED_MONTHS)
    return tidy(biz.headline(rows, SCOPE, _projected(spark, sf)))


def chart_rows(spark, sf):
    """Observed rows, and the projected check-ins of the part of the chart that lies ahead."""
    days = fc.scope_projection(_groups(spark, sf), SCOPE, AHEAD)
    kind = dates.grain(MONTHS)
    bins = days.groupBy("metro", dates.bin_first(F.col("day"), kind).alias("first")).agg(F.sum("projected").alias("value"))
    ahead = bins.select("metro", dates.period_columns(F.col("first"), MONTHS)["period"].alias("period"),
                        F.lit("Projected check-ins").alias("series"), "value")
    return tidy(weather.observed_chart_rows(spark, sf).unionByName(ahead, allowMissingColumns=True))


def month_comparison(spark, sf):
    train, assess = WINDOWS["test"]
    return tidy(fc.month_comparison(_groups(spark, sf, train), _daily(spark, sf), assess))


def model_comparison(spark, sf):
    train, assess = WINDOWS["test"]
    metrics = fc.evaluate_models(_groups(spark, sf, train), _daily(spark, sf), assess, SCOPE)
    return tidy(fc.compare_models(metrics, SCOPE, "overall_mean", "month_weekday_shrunk"))


def same_population(spark, sf):
    return tidy(dq.same_population(_selection(spark, sf), ["stage"], 2))


def sampled(spark, sf):
    """Every supported business with its place in the digest order, from which a sample is a prefix."""
    return tidy(fc.digest_order(_groups(spark, sf), 42).select("business_id", "position"))


def panel_summary(spark, sf):
    """Dense panel of the whole coverage: covered zeros and weather availability per calendar month."""
    span = COVERAGE
    rows = wx.business_weather_days(
        act.business_days(activity(spark, sf, span), span), businesses(spark, sf),
        wx.station_days(station_reports(spark, sf, span), span), span, COVERAGE)
    return tidy(rows.groupBy("business_id", F.month("day").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("checkins").alias("checkins"),
        F.count_if("weather_available").alias("weather_days")))


def label_keys_match(spark, sf):
    """Both models must be scored on identical business-day labels: an empty difference."""
    train, assess = WINDOWS["test"]
    groups = _groups(spark, sf, train)
    label = lambda m: _daily(spark, sf).where(assess.holds(F.col("day"))).join(
        fc.with_model(groups, m).select("business_id"), "business_id")
    diff = dq.keys_match(label("overall_mean"), label("month_weekday_shrunk"))
    return tidy(diff.agg(F.count(F.lit(1)).alias("differences")))


# ---- weather models -----------------------------------------------------------------------


def _supported(spark, sf, span, daily=None):
    return checkpointed(_groups(spark, sf, span, daily))


def _days(spark, sf):
    return checkpointed(wx.station_days(station_reports(spark, sf), unique=True))


def _observations(spark, sf):
    """Check-ins and weather by day, which every step of a fit reads: worked out once."""
    return checkpointed(_daily(spark, sf)), _days(spark, sf)


def _scored(spark, sf, stage, by, observations=None):
    """All models fitted on the stage's window and scored on its assessment days of complete weather."""
    train, assess = WINDOWS[stage]
    daily, days = observations or _observations(spark, sf)
    groups = _supported(spark, sf, train, daily)
    fitted = ml.fit(groups, daily, days, train, COVERAGE, SCOPE)
    return ml.model_scores(fitted, groups, daily, days, assess, SCOPE, fc.MODELS, by)


def weather_model_scores(spark, sf):
    """All models on the same accepted-weather rows, pooled over scopes."""
    return tidy(_scored(spark, sf, "test", []).withColumn("stage", F.lit("test")))


def weather_score_population(spark, sf):
    """Businesses, days and recorded check-ins that every model of a scope is scored on: equal for all four."""
    return tidy(_scored(spark, sf, "test", SCOPE).select(
        *SCOPE, "model", "businesses", "observations", "recorded_checkins"))


def weather_calendar_scores(spark, sf):
    """The calendar models' scores on days of complete weather, scope by scope."""
    return tidy(_scored(spark, sf, "test", SCOPE).where(F.col("model").isin(*fc.MODELS)).drop("businesses"))


def weather_scope_comparison(spark, sf):
    """Every weather model beside the overall mean, scope by scope."""
    metrics = checkpointed(_scored(spark, sf, "test", SCOPE))
    out = None
    for name in ml.WEATHER_MODELS:
        part = fc.compare_models(metrics, SCOPE, "overall_mean", name).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


def _final(spark, sf, kinds, observations=None):
    daily, days = observations or _observations(spark, sf)
    groups = _supported(spark, sf, FINAL, daily)
    return groups, daily, days, ml.fit(groups, daily, days, FINAL, COVERAGE, SCOPE, kinds)


def training_totals(spark, sf):
    """Recorded and fitted totals of every scope and model over the training rows: they must be equal."""
    groups, daily, days, fitted = _final(spark, sf, ml.WEATHER_MODELS)
    rows = ml.training_sums(fitted, groups, daily, days, FINAL, SCOPE)
    return tidy(rows.withColumn("fitted", F.round("fitted", 4)))


def fit_reports(spark, sf):
    """Whether the fit of every scope and model has converged."""
    fitted = _final(spark, sf, ml.WEATHER_MODELS)[3]
    return tidy(fitted.effects.select(*SCOPE, "model", "observations", "converged"))


def weather_normals(spark, sf):
    """Mean accepted weather per supported business and month of the final window."""
    normals = ml.station_normals(wx.station_days(station_reports(spark, sf)), FINAL)
    groups = _supported(spark, sf, FINAL).select("business_id", "parent", "station_id")
    return tidy(groups.join(normals, "station_id").drop("station_id"))


def _scenario(spark, sf):
    groups, _, days, fitted = _final(spark, sf, ["gam_poisson"])
    normals = ml.station_normals(days, FINAL)
    return groups, fitted, ml.scenario_totals(
        fitted, groups, normals, fc.exposure(AHEAD), SCOPE)


def weather_scenario(spark, sf):
    """Projection from monthly normals; businesses without normals for a month are left out."""
    return tidy(_scenario(spark, sf)[2])


def weather_scenario_population(spark, sf):
    """Businesses whose station has normals for every month ahead, with the days that they are projected over."""
    rows = _scenario(spark, sf)[2]
    return tidy(rows.select(*SCOPE, "business_id", "model", F.lit(AHEAD.days).alias("days"),
                            F.col("projected").isNotNull().alias("projected")))


def custom_scenario(spark, sf):
    """Projection under weather given month by month: the mean of all stations' normals, two degrees warmer and
    a tenth wetter, for every business, whatever its own station has."""
    groups, _, days, fitted = _final(spark, sf, ["gam_poisson"])
    given = ml.station_normals(days, FINAL).groupBy("month").agg(
        (F.avg("tmin") + 2).alias("tmin"), (F.avg("tmax") + 2).alias("tmax"), (F.avg("pcpn") * 1.1).alias("pcpn"))
    everywhere = groups.where("station_id IS NOT NULL").select("station_id").distinct().withColumn(
        "month", F.explode(F.sequence(F.lit(1), F.lit(12)))).join(given, "month")
    return tidy(ml.scenario_totals(fitted, groups, ml.coherent(everywhere), fc.exposure(AHEAD), SCOPE).withColumn(
        "weather_basis", F.lit("custom_monthly_weather")))


def scenario_against_calendar(spark, sf):
    """Weather scenario beside the calendar projection of every supported business."""
    groups, _, scenario = _scenario(spark, sf)
    calendar = fc.project(groups, AHEAD, FINAL.end, CONFIG).select(
        "business_id", F.col("projected").alias("calendar_projected"))
    return tidy(calendar.join(scenario.select("business_id", "projected"), "business_id", "left"))


def weather_observed(spark, sf):
    """Every later day on its own: stations complete on that day carry their businesses."""
    groups, _, days, fitted = _final(spark, sf, ["gam_poisson"])
    effects = ml.station_effects(fitted, groups, days, LATER, SCOPE)
    at_station = ml.members(fitted, groups, SCOPE).groupBy(*SCOPE, "model", "station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("factor").alias("factor"))
    return tidy(effects.join(at_station, [*SCOPE, "model", "station_id"]).groupBy("metro", "day").agg(
        F.sum("n").alias("businesses"), F.sum(F.col("factor") * F.col("effect")).alias("projected")))


def _observed(spark, sf):
    """Every calendar month after the training window, and the longest complete run of each station in it."""
    groups, _, days, fitted = _final(spark, sf, ["gam_poisson"])
    runs = checkpointed(ml.complete_runs(days, LATER))
    index = checkpointed(ml.day_index(ml.station_effects(fitted, groups, days, LATER, SCOPE), SCOPE))
    periods = runs.select("station_id", F.col("month").alias("period"), F.col("run_start").alias("start_day"),
                          F.date_add("run_start", (F.col("run_days") - 1).cast("int")).alias("end_day"))
    return groups, runs, index, ml.period_totals(index, ml.members(fitted, groups, SCOPE), periods, SCOPE)


def observed_period(spark, sf):
    """For every later month and fitted business the longest run of days that its station covers, whether that is
    the whole month, the calendar projection over the run, and whether the weather model's total, made of two
    look-ups, is the sum of its days."""
    groups, runs, index, totals = _observed(spark, sf)
    cells = F.transform(F.sequence("start_day", "end_day"), lambda d: ((F.month(d) - 1) * 7 + F.weekday(d) + 1).cast("int"))
    rates = groups.select("business_id", "parent", "station_id", "rates")
    rows = totals.join(rates, ["business_id", "parent"]).join(
        runs.withColumnRenamed("month", "period"), ["station_id", "period"])
    calendar = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.element_at("rates", c))
    by_days = index.join(rows.select(*SCOPE, "model", "station_id", "period", "start_day", "end_day").distinct(),
                         [*SCOPE, "model", "station_id"]).where("day BETWEEN start_day AND end_day").groupBy(
        *SCOPE, "model", "station_id", "period").agg(F.sum("effect").alias("by_days"), (
            F.max("through") - F.min("before")).alias("by_look_up"))
    joined = rows.join(by_days, [*SCOPE, "model", "station_id", "period"])
    return tidy(joined.select(
        *SCOPE, "business_id", F.col("period").alias("month"), "start_day", "run_days", "complete_days", "whole",
        calendar.alias("calendar"), (F.abs(F.col("by_days") - F.col("by_look_up")) < 1e-9).alias("adds_up")))


def observed_weather(spark, sf):
    """The weather model's projections over the same runs."""
    return tidy(_observed(spark, sf)[3].withColumnRenamed("period", "month"))


RECOMMENDED_DAY = date(2001, 7, 4)


def weather_recommend(spark, sf):
    """The top ten of one day for every source of weather: the observed day, one scenario for all, a table with
    a line for each business (its station's normals of the month), and none (the calendar models)."""
    groups, _, days, fitted = _final(spark, sf, ml.WEATHER_MODELS)
    who = checkpointed(ml.members(fitted, groups, SCOPE))
    key = [*SCOPE, "model", "station_id"]
    on_day = lambda rows: rows.select(*SCOPE, "station_id", *ml.WEATHER, F.lit(RECOMMENDED_DAY.month).alias("month"),
                                      F.lit(RECOMMENDED_DAY.weekday()).alias("weekday"))
    places = groups.where("station_id IS NOT NULL").select(*SCOPE, "station_id").distinct()
    sources = {
        "accepted_observed_weather_retrospective": places.join(wx.complete_days(days).where(
            F.col("day") == F.lit(RECOMMENDED_DAY)), "station_id"),
        "explicit_weather_scenario": ml.explicit_weather(
            places, SCOPE, RECOMMENDED_DAY, (18.0, 31.0, 0.0), "station_id"),
        "explicit_weather_table": places.join(ml.station_normals(days, FINAL).where(
            F.col("month") == RECOMMENDED_DAY.month), "station_id")}
    out = None
    for basis, rows in sources.items():
        part = who.join(ml.linear(fitted, on_day(rows), SCOPE, []), key).select(
            "business_id", "parent", "model", (F.col("factor") * F.col("effect")).alias("predicted"), F.lit(basis).alias("weather_basis"))
        out = part if out is None else out.unionByName(part)
    out = out.unionByName(_calendar_day(groups).select(*out.columns))
    return tidy(ml.top_of(out, ["weather_basis"], 10).join(groups.select(
        "business_id", "parent", "name", F.array_join("source_categories", ", ").alias("source_categories")),
        ["business_id", "parent"]).select(
        "weather_basis", "place", "business_id", "name", "source_categories", "model", "predicted"))


def _calendar_day(groups):
    cell = (RECOMMENDED_DAY.month - 1) * 7 + RECOMMENDED_DAY.weekday() + 1
    rows = groups.select("business_id", "parent", F.lit("calendar_only").alias("weather_basis"), F.explode(F.create_map(
        F.lit("overall_mean"), F.col("overall_rate"), F.lit("month_weekday_shrunk"), F.element_at("rates", cell))).alias("model", "predicted"))
    return rows


def calendar_recommend(spark, sf):
    """The same day without weather: the top ten of the calendar models."""
    groups = _supported(spark, sf, FINAL)
    return tidy(ml.top_of(_calendar_day(groups), ["weather_basis"], 10).select(
        "weather_basis", "place", "business_id", "model", "predicted"))


# ---- bundles and runs ---------------------------------------------------------------------


def _bundle(spark, sf, parent=None):
    """What a later projection needs: shared effects, own effects and normals, and the name of the training rows."""
    groups, daily, days, fitted = _final(spark, sf, ["poisson"])
    training = groups.select("business_id", "parent", "training_checkins", "active_days", "station_id")
    parts = {"effects": fitted.effects.select(*SCOPE, "model", "theta", "scaling", "observations"),
             "owns": fitted.owns, "normals": ml.station_normals(days, FINAL)}
    return vs.Bundle(parts, vs.table_revision(training), parent)


def model_bundles(spark, sf):
    """Five bundles of one fit: whole, cut off before its manifest, with a damaged part, without a part, and made
    from training rows that are not the newest; a sixth goes back to the damaged one. Which load, and why not."""
    root, fit = scratch_path(spark, "bundles"), _bundle(spark, sf)
    whole = vs.Bundle({name: checkpointed(part) for name, part in fit.parts.items()}, fit.revision)
    for name in ("whole", "damaged", "short"):
        vs.publish_bundle(spark, root, name, whole)
    vs.publish_bundle(spark, root, "old", vs.Bundle(whole.parts, "an earlier revision"))
    vs.publish_bundle(spark, root, "child", vs.Bundle(whole.parts, whole.revision, "damaged"))
    vs.write_parts(spark, root, "cut off", whole)
    whole.parts["owns"].withColumn("own", F.col("own") + F.lit(1e-9)).write.mode("overwrite").parquet(f"{root}/damaged/owns")
    vs.remove(spark, f"{root}/short/normals")
    rows = None
    for name in ("whole", "damaged", "short", "old", "child", "cut off"):
        problem = vs.bundle_problem(spark, root, name, whole.revision)
        parts = [p for p in fit.parts if vs.exists(spark, f"{root}/{name}/{p}")]
        for part in parts:
            one = spark.read.parquet(f"{root}/{name}/{part}").agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("bundle"), F.lit(part).alias("part"), "rows", F.lit(problem is None).alias("loads"),
                F.lit(problem or "").alias("problem"))
            rows = one if rows is None else rows.unionByName(one)
    return tidy(rows)


def bundle_projection(spark, sf):
    """Projections of a loaded bundle beside those of the fit that it was made from: they must not differ."""
    root, fit = scratch_path(spark, "bundle"), _bundle(spark, sf)
    vs.publish_bundle(spark, root, "whole", fit)
    parts = vs.load_bundle(spark, root, "whole", fit.revision)
    groups = _supported(spark, sf, FINAL)
    total = lambda p, name: ml.scenario_totals(ml.Fitted(p["effects"], p["owns"]), groups, p["normals"], fc.exposure(AHEAD),
                                               SCOPE).select(*SCOPE, "business_id", F.col("projected").alias(name))
    both = total(fit.parts, "fitted").join(total(parts, "loaded"), [*SCOPE, "business_id"], "full_outer")
    return tidy(both.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("businesses"), F.bool_and(F.abs(F.col("fitted") - F.col("loaded")) <= 1e-9 * F.col("fitted")).alias("same")))


def _run(spark, sf):
    """Validation, test and final stage; lost in the second, taken up again, its choice frozen on validation."""
    run, observations = vs.Run(spark, scratch_path(spark, "run")), _observations(spark, sf)
    final = lambda: _final_sums(spark, sf, observations)
    scored = lambda stage: lambda: _scored(spark, sf, stage, [], observations)

    def lost():
        raise InterruptedError("the executor of this stage is gone")

    try:
        run.resume({"validation": scored("validation"), "test": lost, "final": final})
    except InterruptedError:
        pass
    validation = run.resume({"validation": lost})["validation"]  # read, not worked out again
    chosen = validation.agg(F.min_by("model", F.struct("poisson_deviance", "model"))).first()[0]
    run.select("validation", chosen)
    tables = run.resume({"validation": lost, "test": scored("test"), "final": final})
    other = next(m for m in (*fc.MODELS, *ml.WEATHER_MODELS) if m != chosen)
    try:
        run.select("validation", other)
        refused = False
    except vs.StaleWrite:
        refused = True
    return run, tables, chosen, refused


def _final_sums(spark, sf, observations):
    groups, daily, days, fitted = _final(spark, sf, ml.WEATHER_MODELS, observations)
    return ml.training_sums(fitted, groups, daily, days, FINAL, SCOPE).groupBy("model").agg(
        *[F.sum(c).alias(c) for c in ("businesses", "observations", "recorded", "fitted")])


def experiment_run(spark, sf):
    """The scores of a run's stages, with the model that was chosen on validation and kept."""
    _, tables, chosen, _ = _run(spark, sf)
    scores = tables["validation"].withColumn("stage", F.lit("validation")).unionByName(
        tables["test"].withColumn("stage", F.lit("test")))
    return tidy(scores.select("stage", "model", F.lit(chosen).alias("selected"), "businesses", "observations",
                              "poisson_deviance", "mae"))


def experiment_stages(spark, sf):
    """How a run went: each stage's state and attempts, what it was worked out on, and that a changed choice was refused."""
    run, tables, chosen, refused = _run(spark, sf)
    sizes = None
    for stage, rows in tables.items():
        one = rows.agg(F.max("businesses").alias("businesses"), F.max("observations").alias("observations"),
                       F.count(F.lit(1)).alias("models")).withColumn("stage", F.lit(stage))
        sizes = one if sizes is None else sizes.unionByName(one)
    states = run.states().rows
    return tidy(states.join(sizes, "stage").select(
        "stage", "state", "attempts", "models", "businesses", "observations",
        F.col("selected").eqNullSafe(F.lit(chosen)).alias("has_choice"), F.lit(refused).alias("change_refused")))


# ---- county -------------------------------------------------------------------------------


def _county_files(spark, sf):
    """County climate CSV derived from order lines, read back with text columns."""
    li = table(spark, sf, "lineitem")
    year = F.col("l_partkey") % 124 + 1976
    variable = F.element_at(F.array(F.lit("tmax"), F.lit("tmin"), F.lit("pcpn")),
                            (F.col("l_linenumber") % 3 + 1).cast("int"))
    scenario = F.when(year <= 2005, "historical").when(
        F.col("l_returnflag") == "R", "rcp85").otherwise("rcp45")
    rows = li.groupBy(
        F.lpad((F.col("l_suppkey") % 25).cast("string"), 5, "0").alias("county_fips"),
        year.alias("period"), variable.alias("variable"), scenario.alias("scenario")).agg(
        F.max("l_quantity").alias("value"))
    text = rows.select(
        "county_fips", F.concat(F.lit("County "), "county_fips").alias("county_name"),
        F.lit("ST").alias("state"),
        F.when(F.col("period") <= 2005, "historical_modeled").otherwise("projections")
        .alias("dataset"), "scenario", F.lit("weighted_mean").alias("statistic"),
        F.lit("annual").alias("frequency"), F.col("period").cast("string").alias("period"),
        "variable", F.when(F.col("variable") == "pcpn", "inch").otherwise("degreeF").alias("unit"),
        F.lit("grid").alias("grid"), F.col("value").cast("string").alias("value"))
    path = scratch_path(spark, "county")
    text.write.option("header", True).csv(path)
    return files.csv_exact(spark, path, files.COUNTY_CSV)


def _county_businesses(spark, sf):
    return table(spark, sf, "customer").groupBy(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("county_fips")).agg(
        F.count(F.lit(1)).alias("businesses"))


def county_inventory(spark, sf):
    return tidy(lr.inventory(_county_files(spark, sf)))


def county_changes(spark, sf):
    years = lr.annual(_county_files(spark, sf))
    return tidy(lr.window_changes(lr.projections(years), _county_businesses(spark, sf)))


def county_median_change(spark, sf):
    years = lr.annual(_county_files(spark, sf))
    changes = checkpointed(lr.window_changes(lr.projections(years), _county_businesses(spark, sf)))
    return tidy(lr.median_change(changes))


def county_completeness(spark, sf):
    return tidy(lr.period_completeness(lr.annual(_county_files(spark, sf))))


def county_rolling(spark, sf):
    rows = lr.projections(lr.annual(_county_files(spark, sf)))
    smooth = lr.rolling_mean(rows, ["county_fips", "variable", "scenario"], "change")
    return tidy(smooth.select("county_fips", "variable", "scenario", "year", "change", "smooth"))


QUERIES = {
    "forecast_calendar_fit": calendar_fit,
    "forecast_business_errors": business_errors,
    "forecast_temporal_scores": temporal_scores,
    "forecast_selected_model": selected_model,
    "forecast_niche_agreement": niche_agreement,
    "forecast_rank_pairs": rank_pairs,
    "forecast_projection": projection,
    "forecast_daily": daily_projection,
    "forecast_scope_days": scope_projection,
    "forecast_tags": tag_projection,
    "forecast_map_table": map_table,
    "forecast_months": month_comparison,
    "business_headline": headline,
    "chart_rows": chart_rows,
    "forecast_model_comparison": model_comparison,
    "forecast_same_population": same_population,
    "forecast_sample": sampled,
    "forecast_panel": panel_summary,
    "forecast_label_keys": label_keys_match,
    "model_training_totals": training_totals,
    "model_fit_reports": fit_reports,
    "model_scores": weather_model_scores,
    "model_score_population": weather_score_population,
    "model_calendar_scores": weather_calendar_scores,
    "model_scope_comparison": weather_scope_comparison,
    "model_normals": weather_normals,
    "model_scenario": weather_scenario,
    "model_scenario_population": weather_scenario_population,
    "model_scenario_custom": custom_scenario,
    "model_scenario_and_calendar": scenario_against_calendar,
    "model_observed": weather_observed,
    "model_observed_period": observed_period,
    "model_observed_weather": observed_weather,
    "model_recommend": weather_recommend,
    "model_recommend_calendar": calendar_recommend,
    "model_bundles": model_bundles,
    "model_bundle_projection": bundle_projection,
    "model_run": experiment_run,
    "model_run_stages": experiment_stages,
    "county_inventory": county_inventory,
    "county_changes": county_changes,
    "county_median_change": county_median_change,
    "county_completeness": county_completeness,
    "county_rolling": county_rolling,
}


def _fit_sql(tag: str, train: Span) -> str:
    a, z = f"DATE '{train.start}'", f"DATE '{train.end}'"
    return f"""
exposed{tag} AS (SELECT CAST((month(d) - 1) * 7 + isodow(d) - 1 AS INTEGER) AS cell, count(*) AS e
  FROM (SELECT unnest(generate_series({a}, {z}, INTERVAL 1 day)) AS d) GROUP BY 1),
sup{tag} AS (SELECT business_id, metro, parent, categories, station_id, training_checkins,
  active_days, training_checkins * 1e0 / {train.days} AS overall_rate FROM (
    SELECT business_id, CAST(sum(checkins) AS BIGINT) AS training_checkins,
      count(*) AS active_days FROM daily WHERE day BETWEEN {a} AND {z} GROUP BY 1
    HAVING sum(checkins) >= 5)
  JOIN (SELECT business_id FROM daily GROUP BY 1 HAVING min(day) <= {a}) USING (business_id)
  JOIN business USING (business_id)),
cell{tag} AS (SELECT business_id, CAST((month(day) - 1) * 7 + isodow(day) - 1 AS INTEGER) AS cell,
  sum(checkins) AS n FROM daily WHERE day BETWEEN {a} AND {z} GROUP BY ALL),
pool{tag} AS (SELECT metro, parent, cell, sum(n) AS pn FROM sup{tag} JOIN cell{tag}
  USING (business_id) GROUP BY ALL),
size{tag} AS (SELECT metro, parent, count(*) AS members FROM sup{tag} GROUP BY ALL),
rate{tag} AS (SELECT business_id, metro, parent, training_checkins, active_days, overall_rate,
  cell, (coalesce(n, 0) + 30e0 * coalesce(pn, 0) / (members * e)) / (e + 30) AS rate
  FROM sup{tag} CROSS JOIN exposed{tag} JOIN size{tag} USING (metro, parent)
  LEFT JOIN cell{tag} USING (business_id, cell) LEFT JOIN pool{tag} USING (metro, parent, cell))"""


def _dense_sql(tag: str, assess: Span) -> str:
    a, z = f"DATE '{assess.start}'", f"DATE '{assess.end}'"
    return f"""
dense{tag} AS (SELECT business_id, metro, parent, day, coalesce(checkins, 0) AS y, model, mu
  FROM (SELECT CAST(d AS DATE) AS day, CAST((month(d) - 1) * 7 + isodow(d) - 1 AS INTEGER) AS cell
    FROM (SELECT unnest(generate_series({a}, {z}, INTERVAL 1 day)) AS d))
  JOIN (SELECT business_id, metro, parent, cell, 'overall_mean' AS model, overall_rate AS mu
      FROM rate{tag}
    UNION ALL SELECT business_id, metro, parent, cell, 'month_weekday_shrunk', rate FROM rate{tag})
    USING (cell)
  LEFT JOIN daily USING (business_id, day)),
err{tag} AS (SELECT business_id, metro, parent, model, CAST(sum(y) AS BIGINT) AS observed,
  sum(mu) AS predicted, 2 * sum(greatest(mu, 1e-12) - y + CASE WHEN y > 0
    THEN y * ln(y / greatest(mu, 1e-12)) ELSE 0 END) AS deviance_sum,
  sum(abs(y - mu)) AS error_sum, count(*) AS observations FROM dense{tag} GROUP BY ALL)"""


_DAILY = """daily AS (SELECT business_id, day, CAST(sum(n) AS BIGINT) AS checkins FROM activity
  WHERE day BETWEEN DATE '1995-06-01' AND DATE '2001-03-31' GROUP BY ALL)"""
_FINAL_FIT = _DAILY + "," + _fit_sql("f", FINAL)
_TEST = _DAILY + "," + _fit_sql("t", WINDOWS["test"][0]) + "," + _dense_sql("t", WINDOWS["test"][1])
_BOTH = _TEST + "," + _fit_sql("v", WINDOWS["validation"][0]) + "," + _dense_sql(
    "v", WINDOWS["validation"][1])
_METRICS = """greatest(0e0, sum(deviance_sum) / sum(observations)) AS poisson_deviance,
  greatest(0e0, sum(error_sum) / sum(observations)) AS mae, count(*) AS businesses,
  CAST(sum(observations) AS BIGINT) AS observations"""
_STAGES = " UNION ALL ".join(
    f"""SELECT {_METRICS}, CAST(sum(observed) AS BIGINT) AS recorded_checkins,
  sum(predicted) AS predicted_checkins, model, '{stage}' AS stage FROM err{t} GROUP BY model"""
    for stage, t in (("validation", "v"), ("test", "t")))
_AHEAD = f"""ahead AS (SELECT CAST(d AS DATE) AS day,
  CAST((month(d) - 1) * 7 + isodow(d) - 1 AS INTEGER) AS cell FROM (SELECT unnest(generate_series(
  DATE '{AHEAD.start}', DATE '{AHEAD.end}', INTERVAL 1 day)) AS d)),
proj AS (SELECT business_id, metro, parent, sum(rate) AS projected FROM ratef JOIN ahead USING (cell)
  GROUP BY ALL)"""
_TRAINED = f"""comp AS (SELECT station_id, day FROM station_day WHERE tmin IS NOT NULL AND tmax IS NOT NULL
  AND pcpn IS NOT NULL AND day BETWEEN DATE '{FINAL.start}' AND DATE '{FINAL.end}'),
tot AS (SELECT s.metro, s.parent, s.business_id, s.station_id, sum(a.n) AS total FROM supf s
  JOIN (SELECT business_id, day, sum(n) AS n FROM activity GROUP BY ALL) a USING (business_id)
  JOIN comp USING (station_id, day) GROUP BY ALL HAVING sum(a.n) > 0),
held AS (SELECT station_id, count(*) AS d FROM comp GROUP BY 1),
kinds(model) AS (VALUES ('poisson'), ('gam_poisson'))"""


def _assessed(stage: str, tag: str = "") -> str:
    """Businesses that the weather models fit on a stage's window, and the complete days that they are scored on."""
    train, assess = WINDOWS[stage]
    whole = "tmin IS NOT NULL AND tmax IS NOT NULL AND pcpn IS NOT NULL AND day BETWEEN DATE '{}' AND DATE '{}'"
    sup = "sup" + {"test": "t", "validation": "v"}[stage]
    return f"""asses{tag} AS (SELECT station_id, day FROM station_day WHERE {whole.format(assess.start, assess.end)}),
fitted{tag} AS (SELECT s.metro, s.parent, s.business_id, s.station_id FROM {sup} s
  JOIN (SELECT business_id, day, sum(n) AS n FROM activity GROUP BY ALL) USING (business_id)
  JOIN (SELECT station_id, day FROM station_day WHERE {whole.format(train.start, train.end)}) USING (station_id, day)
  GROUP BY ALL HAVING sum(n) > 0),
held{tag} AS (SELECT station_id, count(*) AS d FROM asses{tag} GROUP BY 1),
visited{tag} AS (SELECT business_id, parent, sum(checkins) AS seen FROM fitted{tag} JOIN daily USING (business_id)
  JOIN asses{tag} USING (station_id, day) GROUP BY ALL)"""


_SHRUNK = "errt WHERE model = 'month_weekday_shrunk'"
_COUNTY = """county AS (SELECT lpad(CAST(l_suppkey % 25 AS VARCHAR), 5, '0') AS county_fips,
  l_partkey % 124 + 1976 AS year, ['tmax', 'tmin', 'pcpn'][CAST(l_linenumber % 3 + 1 AS INTEGER)]
    AS variable, CASE WHEN l_partkey % 124 + 1976 <= 2005 THEN 'historical'
    WHEN l_returnflag = 'R' THEN 'rcp85' ELSE 'rcp45' END AS scenario, max(l_quantity) AS v
  FROM lineitem GROUP BY ALL),
yearly AS (SELECT *, CASE WHEN variable = 'pcpn' THEN v * 254e-1 ELSE (v - 32e0) * 5e0 / 9e0 END
  AS metric FROM county),
base AS (SELECT county_fips, variable, avg(metric) AS baseline_metric FROM yearly
  WHERE year BETWEEN 1976 AND 2005 GROUP BY ALL),
pro AS (SELECT y.*, baseline_metric FROM yearly y JOIN base USING (county_fips, variable)
  WHERE year > 2005),
win AS (SELECT county_fips, variable, scenario, CASE WHEN year BETWEEN 2030 AND 2059
    THEN '2030–2059' ELSE '2070–2099' END AS window, avg(metric) AS future_metric,
  any_value(baseline_metric) AS baseline_metric, count(*) AS years FROM pro
  WHERE year BETWEEN 2030 AND 2059 OR year BETWEEN 2070 AND 2099 GROUP BY ALL),
changes AS (SELECT *, CASE WHEN variable = 'pcpn' THEN (future_metric / baseline_metric - 1) * 100
  ELSE future_metric - baseline_metric END AS change FROM win)"""


def _fsql(body: str, doubles: str, ctes: str) -> str:
    return sql("business activity", body, doubles, ctes)


ORACLES = {
    "forecast_calendar_fit": _fsql("""SELECT business_id, metro, parent, training_checkins,
  active_days, overall_rate, cell, rate FROM ratef""", "overall_rate rate", _FINAL_FIT),
    "forecast_business_errors": _fsql(f"""SELECT business_id, observed, predicted, deviance_sum,
  error_sum FROM {_SHRUNK}""", "predicted deviance_sum error_sum", _TEST),
    "forecast_temporal_scores": _fsql(_STAGES, "poisson_deviance mae predicted_checkins", _BOTH),
    "forecast_selected_model": _fsql("""SELECT model AS selected FROM errv GROUP BY model
  ORDER BY sum(deviance_sum) / sum(observations), model DESC LIMIT 1""", "", _BOTH),
    "forecast_niche_agreement": _fsql(f"""SELECT *, observed_leader = predicted_leader AS agrees
FROM (SELECT metro, parent, source, count(*) AS members,
    arg_min(business_id, (-observed, business_id)) AS observed_leader,
    arg_min(business_id, (-round(predicted, 9), business_id)) AS predicted_leader
  FROM (SELECT e.*, unnest(list_filter(categories, lambda c: c <> e.parent)) AS source
    FROM errt e JOIN supt USING (business_id) WHERE model = 'month_weekday_shrunk')
  GROUP BY ALL HAVING count(*) >= 2)""", "", _TEST),
    "forecast_rank_pairs": _fsql(f"""SELECT metro, parent, business_id,
  row_number() OVER (PARTITION BY metro, parent ORDER BY observed DESC, business_id)
    AS observed_rank,
  row_number() OVER (PARTITION BY metro, parent ORDER BY round(predicted, 9) DESC, business_id)
    AS predicted_rank FROM {_SHRUNK}""", "", _TEST),
    "forecast_projection": _fsql(f"""SELECT business_id, projected, projected / {AHEAD.days}
  AS daily_rate FROM proj""", "projected daily_rate", _FINAL_FIT + ", " + _AHEAD),
    "forecast_daily": _fsql("""SELECT business_id, day, rate AS projected FROM ratef
  JOIN ahead USING (cell)""", "projected",
        _FINAL_FIT + ", " + _AHEAD),
    "forecast_scope_days": _fsql("""SELECT metro, parent, count(*) AS members, day,
  sum(rate) AS projected FROM ratef JOIN ahead USING (cell) GROUP BY ALL""", "projected",
        _FINAL_FIT + ", " + _AHEAD),
    "forecast_tags": _fsql("""SELECT metro, tag, catalog_businesses,
  coalesce(m, 0) AS modeled_businesses, projected
FROM (SELECT metro, tag, count(*) AS catalog_businesses FROM (SELECT metro, unnest(categories)
  AS tag FROM business) GROUP BY ALL)
LEFT JOIN (SELECT metro, tag, count(*) AS m, sum(projected) AS projected FROM (
  SELECT p.metro, unnest(list_filter(categories, lambda c: c <> p.parent)) AS tag, projected
  FROM proj p JOIN supf USING (business_id)) GROUP BY ALL) USING (metro, tag)""", "projected",
        _FINAL_FIT + ", " + _AHEAD),
    "forecast_map_table": _fsql("""SELECT metro, parent, CASE WHEN combined IS NOT NULL THEN
  row_number() OVER (PARTITION BY metro, parent ORDER BY combined DESC NULLS LAST, name,
    business_id) END AS rank, business_id, name, latitude, longitude, checkins, projected, combined
FROM (SELECT s.*, projected, round(checkins + projected, 9) AS combined FROM summary s
  LEFT JOIN (SELECT business_id, projected FROM proj) USING (business_id))""",
        "latitude longitude projected combined",
        summary_sql("months") + ", " + _FINAL_FIT + ", " + _AHEAD),
    "business_headline": _fsql("""SELECT * REPLACE (coalesce(projected_businesses, 0) AS projected_businesses) FROM (
  SELECT metro, parent, count(*) AS businesses,
  CAST(sum(checkins) AS BIGINT) AS checkins, count(stars) AS rated, avg(stars) AS mean_rating,
  avg(checkins) AS mean_checkins, median(checkins) AS median_checkins FROM summary GROUP BY ALL)
  LEFT JOIN (SELECT metro, parent, count(*) AS projected_businesses, sum(projected) AS projected FROM proj GROUP BY ALL)
  USING (metro, parent)""", "mean_rating mean_checkins median_checkins projected",
        summary_sql("months") + ", " + _FINAL_FIT + ", " + _AHEAD),
    "chart_rows": sql("business activity station review", weather.CHART_SQL + """
UNION ALL SELECT metro, strftime(day, '%B %Y'), 'Projected check-ins', sum(rate), NULL FROM ratef JOIN ahead USING (cell)
GROUP BY ALL""", "value", weather.SAMPLES_SQL + ", " + _FINAL_FIT + ", " + _AHEAD),
    "forecast_months": _fsql("""SELECT CAST(date_trunc('month', day) AS DATE) AS month,
  sum(mu) AS checkins, model AS series FROM denset GROUP BY ALL
UNION ALL SELECT CAST(date_trunc('month', day) AS DATE), CAST(sum(y) AS DOUBLE),
  'Recorded check-ins' FROM denset WHERE model = 'overall_mean' GROUP BY ALL
  HAVING sum(y) > 0""", "checkins", _TEST),
    "forecast_model_comparison": _fsql("""SELECT *, CASE WHEN base_deviance > 0 THEN
  100 * (base_deviance - other_deviance) / base_deviance END AS error_reduction_pct,
  other_deviance < base_deviance AS other_is_lower FROM (
  SELECT metro, parent, max(d) FILTER (model = 'overall_mean') AS base_deviance,
    max(d) FILTER (model <> 'overall_mean') AS other_deviance, max(businesses) AS businesses,
    max(observations) AS observations FROM (
    SELECT metro, parent, model, greatest(0e0, sum(deviance_sum) / sum(observations)) AS d,
      count(*) AS businesses, CAST(sum(observations) AS BIGINT) AS observations
    FROM errt GROUP BY ALL) GROUP BY ALL)""",
        "base_deviance other_deviance error_reduction_pct", _TEST),
    "forecast_same_population": _fsql(f"""SELECT stage, count(DISTINCT model) AS models, count(DISTINCT observations) AS populations,
  bool_and(poisson_deviance >= 0 AND mae >= 0) AS finite, count(DISTINCT model) = 2 AND count(DISTINCT observations) = 1
    AND bool_and(poisson_deviance >= 0 AND mae >= 0) AS valid FROM ({_STAGES}) GROUP BY stage""", "", _BOTH),
    "forecast_sample": _fsql("""SELECT business_id FROM supf
  """, "", _FINAL_FIT).replace("SELECT business_id FROM supf", """SELECT business_id, row_number() OVER (
  ORDER BY sha256('42/' || CAST(business_id AS VARCHAR)), business_id) AS position FROM supf"""),
    "forecast_panel": sql("business activity station", """
SELECT business_id, month(day) AS month, count(*) AS days,
  CAST(sum(coalesce(n, 0)) AS BIGINT) AS checkins,
  count(*) FILTER (tmin IS NOT NULL AND tmax IS NOT NULL AND pcpn IS NOT NULL) AS weather_days
FROM (SELECT business_id, station_id, CAST(unnest(generate_series(DATE '1995-06-01',
  DATE '2001-03-31', INTERVAL 1 day)) AS DATE) AS day FROM business)
LEFT JOIN (SELECT business_id, day, sum(n) AS n FROM activity GROUP BY ALL)
  USING (business_id, day)
LEFT JOIN station_day USING (station_id, day) GROUP BY ALL"""),
    "forecast_label_keys": _fsql("""SELECT count(*) AS differences FROM (
  (SELECT business_id, day FROM denset WHERE model = 'overall_mean' AND y > 0
   EXCEPT ALL SELECT business_id, day FROM denset WHERE model = 'month_weekday_shrunk' AND y > 0)
  UNION ALL (SELECT business_id, day FROM denset WHERE model = 'month_weekday_shrunk' AND y > 0
   EXCEPT ALL SELECT business_id, day FROM denset WHERE model = 'overall_mean' AND y > 0))""", "", _TEST),
    "model_observed_period": sql("business activity station", f"""SELECT s.metro, s.parent, s.business_id, month,
  start_day, run_days, complete_days, run_days = day(last_day(month)) AS whole, (SELECT sum(rate) FROM ratef r,
    (SELECT unnest(generate_series(start_day, start_day + CAST(run_days - 1 AS INTEGER), INTERVAL 1 day)) AS d)
    WHERE r.business_id = s.business_id AND r.parent = s.parent AND cell = (month(d) - 1) * 7 + isodow(d) - 1) AS calendar,
  true AS adds_up FROM tot s JOIN longest USING (station_id)""", "calendar", _FINAL_FIT + "," + _TRAINED + f""",
later AS (SELECT station_id, day, CAST(date_trunc('month', day) AS DATE) AS month FROM station_day WHERE tmin IS NOT NULL
  AND tmax IS NOT NULL AND pcpn IS NOT NULL AND day BETWEEN DATE '{LATER.start}' AND DATE '{LATER.end}'),
run AS (SELECT station_id, month, min(day) AS start_day, count(*) AS run_days FROM (SELECT *, day - CAST(row_number() OVER (
  PARTITION BY station_id, month ORDER BY day) AS INTEGER) AS g FROM later) GROUP BY station_id, month, g),
longest AS (SELECT station_id, month, arg_max(start_day, (run_days, DATE '2100-01-01' - start_day)) AS start_day,
  max(run_days) AS run_days, CAST(sum(run_days) AS BIGINT) AS complete_days FROM run GROUP BY ALL)"""),
    "model_score_population": sql("business activity station", f"""SELECT metro, parent, model, count(*) AS businesses,
  CAST(sum(d) AS BIGINT) AS observations, CAST(sum(coalesce(seen, 0)) AS BIGINT) AS recorded_checkins
FROM fitted JOIN held USING (station_id) LEFT JOIN visited USING (business_id, parent), kinds GROUP BY ALL""", "",
        _TEST + "," + _assessed("test") + """, kinds(model) AS (VALUES ('poisson'), ('gam_poisson'), ('overall_mean'), ('month_weekday_shrunk'))"""),
    "model_calendar_scores": sql("business activity station", f"""SELECT metro, parent, model, count(*) AS observations,
  greatest(0e0, 2 * avg(greatest(mu, 1e-12) - y + CASE WHEN y > 0 THEN y * ln(y / greatest(mu, 1e-12)) ELSE 0 END)) AS poisson_deviance, avg(abs(y - mu)) AS mae,
  CAST(sum(y) AS BIGINT) AS recorded_checkins, sum(mu) AS predicted_checkins
FROM denset JOIN fitted USING (business_id, metro, parent) JOIN asses USING (station_id, day) GROUP BY ALL""",
        "poisson_deviance mae predicted_checkins", _TEST + "," + _assessed("test")),
    "model_scenario_population": sql("business activity station", f"""SELECT t.metro, t.parent, t.business_id, 'gam_poisson' AS model,
  {AHEAD.days} AS days, true AS projected FROM tot t JOIN (SELECT station_id FROM comp WHERE month(day) IN (
    SELECT DISTINCT month(day) FROM ahead) GROUP BY 1
    HAVING count(DISTINCT month(day)) = (SELECT count(DISTINCT month(day)) FROM ahead)) USING (station_id)""", "",
        _FINAL_FIT + "," + _TRAINED + "," + _AHEAD),
    "model_recommend_calendar": _fsql(f"""SELECT 'calendar_only' AS weather_basis, place, business_id, model, predicted FROM (
  SELECT *, row_number() OVER (ORDER BY round(predicted, 9) DESC, business_id, model) AS place FROM (
    SELECT business_id, 'overall_mean' AS model, overall_rate AS predicted FROM supf
    UNION ALL SELECT business_id, 'month_weekday_shrunk', rate FROM ratef
    WHERE cell = {(RECOMMENDED_DAY.month - 1) * 7 + RECOMMENDED_DAY.weekday()})) WHERE place <= 10""", "predicted", _FINAL_FIT),
    "model_bundles": sql("business activity station", """SELECT bundle, part, rows, problem = '' AS loads, problem FROM (VALUES
    ('whole', ''), ('damaged', 'changed part: owns'), ('short', 'missing part: normals'), ('old', 'stale revision'),
    ('child', 'parent: changed part: owns'), ('cut off', 'no manifest')) AS b(bundle, problem), (
  SELECT 'effects' AS part, count(*) AS rows FROM (SELECT DISTINCT metro, parent FROM tot)
  UNION ALL SELECT 'owns', count(*) FROM tot
  UNION ALL SELECT 'normals', count(*) FROM (SELECT DISTINCT station_id, month(day) FROM comp))
WHERE NOT (bundle = 'short' AND part = 'normals')""", "", _FINAL_FIT + "," + _TRAINED),
    "model_bundle_projection": sql("business activity station", """SELECT t.metro, t.parent, count(*) AS businesses, true AS same
FROM tot t JOIN (SELECT station_id FROM comp WHERE month(day) IN (SELECT DISTINCT month(day) FROM ahead) GROUP BY 1
    HAVING count(DISTINCT month(day)) = (SELECT count(DISTINCT month(day)) FROM ahead)) USING (station_id) GROUP BY ALL""", "",
        _FINAL_FIT + "," + _TRAINED + "," + _AHEAD),
    "model_run_stages": sql("business activity station", f"""SELECT stage, 'complete' AS state, CASE stage WHEN 'test' THEN 2 ELSE 1 END AS attempts,
  CASE stage WHEN 'final' THEN 2 ELSE 4 END AS models, businesses, observations, stage = 'validation' AS has_choice, true AS change_refused
FROM (SELECT 'validation' AS stage, count(*) AS businesses, CAST(sum(d) AS BIGINT) AS observations FROM fittedv JOIN heldv USING (station_id)
  UNION ALL SELECT 'test', count(*), CAST(sum(d) AS BIGINT) FROM fitted JOIN held USING (station_id)
  UNION ALL SELECT 'final', count(*), CAST(sum(d) AS BIGINT) FROM tot JOIN heldf USING (station_id))""", "",
        _BOTH + "," + _assessed("test") + "," + _assessed("validation", "v") + "," + _fit_sql("f", FINAL)
        + "," + _TRAINED.replace("held AS", "heldf AS")),
    "model_training_totals": sql("business activity station", """SELECT metro, parent, model, count(*) AS businesses,
  CAST(sum(d) AS BIGINT) AS observations, CAST(sum(total) AS DOUBLE) AS recorded,
  CAST(sum(total) AS DOUBLE) AS fitted FROM tot JOIN held USING (station_id), kinds GROUP BY ALL""", "",
        _FINAL_FIT + "," + _TRAINED),
    "model_fit_reports": sql("business activity station", """SELECT metro, parent, model,
  CAST(sum(d) AS BIGINT) AS observations, true AS converged
FROM tot JOIN held USING (station_id), kinds GROUP BY ALL""", "", _FINAL_FIT + "," + _TRAINED),
    "model_normals": sql("business activity station", f"""SELECT business_id, parent,
  month(day) AS month, avg(tmin) AS tmin, avg(tmax) AS tmax, avg(pcpn) AS pcpn
FROM supf JOIN station_day USING (station_id) WHERE tmin IS NOT NULL AND tmax IS NOT NULL
  AND pcpn IS NOT NULL AND day BETWEEN DATE '{FINAL.start}' AND DATE '{FINAL.end}'
GROUP BY ALL""", "tmin tmax pcpn", _FINAL_FIT),
    "county_inventory": sql("", """SELECT 'annual' AS frequency, CASE WHEN year <= 2005
  THEN 'historical_modeled' ELSE 'projections' END AS dataset, scenario,
  'weighted_mean' AS statistic, count(DISTINCT county_fips) AS counties, count(*) AS rows,
  min(CAST(year AS VARCHAR)) AS first_period, max(CAST(year AS VARCHAR)) AS last_period
  FROM county GROUP BY ALL""", ctes=_COUNTY),
    "county_changes": sql("", """SELECT changes.*, businesses FROM changes LEFT JOIN (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county_fips, count(*) AS businesses
  FROM customer GROUP BY 1) USING (county_fips)""",
        "future_metric baseline_metric change", _COUNTY),
    "county_median_change": sql("", """SELECT variable, scenario, "window", median(change)
  AS median_change FROM changes GROUP BY ALL""", "median_change", _COUNTY),
    "county_completeness": sql("", """SELECT *, years = expected_years AS complete FROM (
  SELECT county_fips, CASE WHEN year <= 2005 THEN 'historical_modeled' ELSE 'projections' END
    AS dataset, scenario, variable, count(*) AS years, count(*) AS rows,
    max(year) - min(year) + 1 AS expected_years FROM county GROUP BY ALL)""", ctes=_COUNTY),
    "county_rolling": sql("", """SELECT county_fips, variable, scenario, year, change,
  CASE WHEN count(change) OVER w = 10 THEN avg(change) OVER w END AS smooth FROM (
  SELECT *, CASE WHEN variable = 'pcpn' THEN (metric / baseline_metric - 1) * 100
    ELSE metric - baseline_metric END AS change FROM pro)
WINDOW w AS (PARTITION BY county_fips, variable, scenario ORDER BY year
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "change smooth", _COUNTY),
}
