"""Weather-aware Poisson models: one effect per business, shared calendar and weather effects per scope.

The expected count of a business on a day is exp(b + x.t): b is the business's own effect, x holds month,
weekday and weather of its station's day, t the effects shared by its scope. Given t, the best b is
closed-form (the recorded total over the sum of exp(x.t)), so that training totals are met exactly, and
what is left to maximise in t needs counts per scope, station and day only: the fit does not grow with
the number of businesses. Each Newton step is two small aggregations; a task sees the days of one
station, or one fixed-size summary per station of a scope.

Predictions keep to that: exp(x.t) is worked out once for a scope, model, station and day, and a business
joins a number. Sums over days without visits follow from its station's sums, so no row is made for them, and
any period is the difference of two running sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footmark.functions.dates import Span
from footmark.operators import weather as wx
from footmark.session import checkpointed

WEATHER = ("tmin", "tmax", "pcpn")
FLOOR = 1e-12
# Penalty, tolerance and most steps of the fit; knots and degree of the splines.
LINEAR = {"alpha": 0.01, "tol": 1e-6, "steps": 40}
SPLINE = {"knots": 5, "degree": 3}
WEATHER_MODELS = ("poisson", "gam_poisson")


@dataclass(frozen=True)
class Fitted:
    """Shared effects (scope, model, theta, scaling, steps, gradient, converged) and own effects (business, model, own)."""

    effects: DataFrame
    owns: DataFrame


def panel(
    groups: DataFrame, daily: DataFrame, days: DataFrame, span: Span, coverage: Span,
    keys: Sequence[str],
) -> DataFrame:
    """One row per business and day with complete weather, zero activity included."""
    if not coverage.contains(span):
        raise ValueError("Cannot zero-fill outside declared imported activity coverage.")
    rows = wx.business_weather_days(
        daily, groups.select("business_id", "station_id"), days, span, coverage)
    return rows.where("weather_available").join(
        groups.select("business_id", *keys), "business_id"
    ).select(*keys, "business_id", "day", "checkins", *WEATHER,
             F.month("day").alias("month"), F.weekday("day").alias("weekday"))


# ---- numeric kernels ----------------------------------------------------------------------


def _basis(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Cubic B-splines on uniform knots, continued linearly, first column dropped."""
    k, gaps = SPLINE["degree"], SPLINE["knots"] - 1
    step = (high - low) / gaps if high > low else 1.0
    t = low + step * np.arange(-k, gaps + k + 1)

    def order(v: np.ndarray, p: int) -> np.ndarray:
        last = (v[:, None] >= t[gaps + k]) & (np.arange(len(t) - 1) == gaps + k - 1)
        b = (((v[:, None] >= t[:-1]) & (v[:, None] < t[1:])) | last).astype(float)
        b[v >= t[gaps + k], gaps + k] = 0.0
        for q in range(1, p + 1):
            left = (v[:, None] - t[:-q - 1]) / (q * step) * b[:, :-1]
            b = left + (t[q + 1:] - v[:, None]) / (q * step) * b[:, 1:]
        return b

    inside = np.clip(x, low, low + gaps * step)
    lower = order(inside, k - 1)
    slope = (lower[:, :-1] - lower[:, 1:]) / step
    return (order(inside, k) + slope * (x - inside)[:, None])[:, 1:]


def _design(frame: pd.DataFrame, kind: str, scaling: np.ndarray) -> np.ndarray:
    """Month and weekday indicators, then the weather; ``scaling`` has mean, deviation, least and most of each."""
    mean, scale, low, high = np.asarray(scaling, float).reshape(4, len(WEATHER))
    w = frame[list(WEATHER)].to_numpy(float)
    blocks = [np.eye(12)[frame["month"].to_numpy(int) - 1], np.eye(7)[frame["weekday"].to_numpy(int)]]
    if kind == "poisson":
        blocks.append((w - mean) / np.where(scale > 0, scale, 1.0))
    else:
        blocks += [_basis(w[:, j], low[j], high[j]) for j in range(len(WEATHER))]
    return np.hstack(blocks)


def _width(kind: str) -> int:
    return 19 + (3 if kind == "poisson" else 3 * (SPLINE["knots"] + SPLINE["degree"] - 2))


def station_part(frame: pd.DataFrame, kind: str, theta: np.ndarray, scaling: np.ndarray) -> dict:
    """Loss, gradient and curvature that one station's days add, its businesses' own effects solved for."""
    x, y = _design(frame, kind, scaling), frame["checkins"].to_numpy(float)
    eta = x @ theta
    top = eta.max()
    weight = np.exp(eta - top)
    p, log_sum = weight / weight.sum(), top + np.log(weight.sum())
    mean = p @ x
    return {"loss": y.sum() * log_sum - y @ eta, "gradient": y.sum() * mean - y @ x,
            "curvature": y.sum() * ((x * p[:, None]).T @ x - np.outer(mean, mean)), "log_sum": log_sum}


def next_state(parts: pd.DataFrame, state: dict) -> dict:
    """A Newton step of one scope and model, or half the last step back if the loss has grown."""
    theta, n = np.array(state["theta"]), state["observations"]
    ridge = LINEAR["alpha"] * n
    loss = parts["loss"].sum() + 0.5 * ridge * theta @ theta
    gradient = np.sum([np.asarray(g) for g in parts["gradient"]], axis=0) + ridge * theta
    steepest = float(np.abs(gradient).max() / n)
    before = np.array(state["before"])
    if loss > state["loss"] + 1e-9 * abs(state["loss"]) and state["steps"] > 0:
        return {**state, "theta": (before + (theta - before) / 2).tolist(), "steps": state["steps"] + 1}
    done = steepest < LINEAR["tol"]
    curvature = np.sum([np.asarray(c).reshape(len(theta), -1) for c in parts["curvature"]], axis=0)
    moved = theta if done else theta - np.linalg.solve(curvature + ridge * np.eye(len(theta)), gradient)
    return {**state, "theta": moved.tolist(), "before": theta.tolist(), "loss": float(loss), "gradient": steepest,
            "steps": state["steps"] + (not done), "converged": bool(done)}


# ---- Spark operators ----------------------------------------------------------------------


def fit(
    groups: DataFrame, daily: DataFrame, days: DataFrame, span: Span, coverage: Span,
    keys: Sequence[str], kinds: Sequence[str] = WEATHER_MODELS,
) -> Fitted:
    """Fit every scope and model at once on days of complete weather, zero activity included.

    Businesses without a check-in on such a day have no effect of their own and are not fitted. A fit that
    has not converged within the allowed steps says so in ``converged``.
    """
    for kind in kinds:
        if kind not in WEATHER_MODELS:
            raise ValueError("Unknown research model.")
    if not coverage.contains(span):
        raise ValueError("Cannot zero-fill outside declared imported activity coverage.")
    keys = list(keys)
    complete = checkpointed(wx.complete_days(days.where(span.holds(F.col("day")))))
    matched = daily.where(span.holds(F.col("day"))).join(
        groups.select("business_id", *keys, "station_id"), "business_id").join(
        complete.select("station_id", "day"), ["station_id", "day"], "left_semi")
    totals = checkpointed(matched.groupBy(*keys, "station_id", "business_id").agg(
        F.sum("checkins").alias("total")).where("total > 0"))
    counts = matched.groupBy(*keys, "station_id", "day").agg(F.sum("checkins").alias("checkins"))
    members = totals.groupBy(*keys, "station_id").agg(F.count(F.lit(1)).alias("members"))
    rows = checkpointed(members.join(complete, "station_id").join(counts, [*keys, "station_id", "day"], "left").select(
        *keys, "station_id", "day", "members", *WEATHER, F.month("day").alias("month"),
        F.weekday("day").alias("weekday"), F.coalesce("checkins", F.lit(0)).alias("checkins")))

    n = F.sum("members")
    mean = [F.sum(F.col(c) * F.col("members")) / n for c in WEATHER]
    spread_ = [F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(c) * F.col(c) * F.col("members")) / n - m * m))
               for c, m in zip(WEATHER, mean)]
    scopes = rows.groupBy(*keys).agg(
        F.array(*mean, *spread_, *[F.min(c) for c in WEATHER], *[F.max(c) for c in WEATHER]).alias("scaling"),
        n.alias("observations"))
    start = None
    for kind in kinds:
        zero = F.array_repeat(F.lit(0.0), _width(kind))
        part = scopes.select(*keys, F.lit(kind).alias("model"), "scaling", "observations", zero.alias("theta"),
                             zero.alias("before"), F.lit(0.0).alias("loss"), F.lit(0.0).alias("gradient"),
                             F.lit(0).alias("steps"), F.lit(False).alias("converged"))
        start = part if start is None else start.unionByName(part)
    state = checkpointed(start)
    for _ in range(LINEAR["steps"]):
        moving = state.where("not converged")
        if moving.isEmpty():
            break
        state = checkpointed(_step(rows, moving, keys).unionByName(state.where("converged")))

    sums = _parts(rows, state, keys).select(*keys, "model", "station_id", "log_sum")
    owns = totals.join(sums, [*keys, "station_id"]).select(
        *keys, "business_id", "model", (F.log("total") - F.col("log_sum")).alias("own"))
    return Fitted(state.drop("before", "loss"), checkpointed(owns))


def _parts(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    group = [*keys, "model", "station_id"]
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("model", T.StringType()), rows.schema["station_id"],
                           T.StructField("loss", T.DoubleType()), T.StructField("gradient", T.ArrayType(T.DoubleType())),
                           T.StructField("curvature", T.ArrayType(T.DoubleType())), T.StructField("log_sum", T.DoubleType())])

    def run(frame: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        state_ = shared.iloc[0]
        part = station_part(frame, state_["model"], np.array(state_["theta"]), state_["scaling"])
        return shared[group].assign(loss=part["loss"], gradient=[part["gradient"].tolist()],
                                    curvature=[part["curvature"].ravel().tolist()], log_sum=part["log_sum"])

    return _beside(rows, state.select(*keys, "model", "scaling", "theta"), keys, ["station_id"], run, schema)


def _beside(rows: DataFrame, shared: DataFrame, keys: list[str], by: list[str], run, schema: T.StructType) -> DataFrame:
    """``run`` on the rows of every (keys, model, by) and on the one row of effects that they share."""
    group = [*keys, "model", *by]
    each = rows.join(shared.select(*keys, "model"), keys)
    once = rows.select(*keys, *by).distinct().join(shared, keys).toDF(*keys, *by, *[c for c in shared.columns if c not in keys])
    return each.groupBy(*group).cogroup(once.groupBy(*group)).applyInPandas(run, schema)


def _step(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    group, columns = [*keys, "model"], state.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        moved = next_state(frame, {c: first[f"s_{c}"] for c in columns if c not in group})
        return pd.DataFrame([{**{k: first[k] for k in group}, **moved}])[columns]

    held = state.select(*group, *[F.col(c).alias(f"s_{c}") for c in columns if c not in group])
    parts = _parts(rows, state, keys).drop("log_sum", "station_id").join(held, group)
    return parts.groupBy(*group).applyInPandas(run, state.schema)


def linear(fitted: Fitted, cells: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``cells`` once for every model of their scope, with ``effect``: exp of what calendar and weather say.

    Cells need month, weekday and the weather columns; ``by`` names columns that split a scope's cells into
    groups of bounded size, such as a station's days. Scopes without a fit are left out.
    """
    keys, by = list(keys), list(by)
    schema = T.StructType([*cells.schema.fields, T.StructField("model", T.StringType()), T.StructField("effect", T.DoubleType())])

    def run(frame: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        state = shared.iloc[0]
        eta = _design(frame, state["model"], state["scaling"]) @ np.array(state["theta"])
        return frame.assign(effect=np.exp(np.clip(eta, -50.0, 50.0)))[schema.names]

    return _beside(cells, fitted.effects.select(*keys, "model", "scaling", "theta"), keys, by, run, schema)


def predict(fitted: Fitted, rows: DataFrame, keys: Sequence[str], parts: int = 16) -> DataFrame:
    """Expected counts for complete-weather rows of fitted businesses, per model.

    ``rows`` need business_id, month, weekday and the weather columns of their own; where businesses share a
    station's weather, ``station_effects`` is the cheaper way. Businesses unknown to their scope's model are
    left out, never guessed.
    """
    columns = rows.columns
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("business_id"), F.lit(parts)))
    effects = linear(fitted, dealt, keys, ["_part"])
    return effects.join(fitted.owns.toDF(*fitted.owns.columns), [*keys, "business_id", "model"]).select(
        *columns, "model", F.greatest(F.col("effect") * F.exp("own"), F.lit(FLOOR)).alias("predicted"))


def members(fitted: Fitted, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, model, station_id, business_id, factor): every fitted business, factor being exp of its own effect."""
    owns = fitted.owns.toDF(*fitted.owns.columns).select(*keys, "business_id", "model", F.exp("own").alias("factor"))
    return groups.select("business_id", *keys, "station_id").join(owns, [*keys, "business_id"])


def station_effects(fitted: Fitted, groups: DataFrame, days: DataFrame, span: Span, keys: Sequence[str]) -> DataFrame:
    """(keys, model, station_id, day, effect) for the complete days of the stations of each scope's businesses."""
    complete = wx.complete_days(days.where(span.holds(F.col("day"))))
    cells = groups.where(F.col("station_id").isNotNull()).select(*keys, "station_id").distinct().join(complete, "station_id").select(
        *keys, "station_id", "day", *WEATHER, F.month("day").alias("month"), F.weekday("day").alias("weekday"))
    return linear(fitted, cells, keys, ["station_id"]).select(*keys, "model", "station_id", "day", "effect")


def training_sums(fitted: Fitted, groups: DataFrame, daily: DataFrame, days: DataFrame, span: Span,
                  keys: Sequence[str]) -> DataFrame:
    """Recorded and fitted totals of every scope and model over its businesses' days of complete weather."""
    effects = checkpointed(station_effects(fitted, groups, days, span, keys))
    sums = effects.groupBy(*keys, "model", "station_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("effect").alias("sum_effect"))
    who = members(fitted, groups, keys)
    expected = who.join(sums, [*keys, "model", "station_id"]).groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("businesses"), F.sum("days").alias("observations"),
        F.sum(F.col("factor") * F.col("sum_effect")).alias("fitted"))
    recorded = daily.join(who.select(*keys, "model", "station_id", "business_id"), "business_id").join(
        effects.select(*keys, "model", "station_id", "day"), [*keys, "model", "station_id", "day"], "left_semi").groupBy(
        *keys, "model").agg(F.sum("checkins").cast("double").alias("recorded"))
    return expected.join(recorded, [*keys, "model"])


def _daily_rates(groups: DataFrame, keys: Sequence[str], counts: DataFrame, model: str) -> DataFrame:
    """A calendar model's rates in the members' form: what is expected over a station's counted days, and of each cell."""
    rates = F.array_repeat("overall_rate", 84) if model == "overall_mean" else F.col("rates")
    floored = F.transform(rates, lambda r: F.greatest(r, F.lit(FLOOR)))
    return groups.select("business_id", *keys, "station_id", floored.alias("rates")).join(counts, "station_id").select(
        *keys, "business_id", "station_id", "rates", F.lit(model).alias("model"), "days", F.aggregate(
            F.zip_with("rates", "cells", lambda r, n: r * n), F.lit(0.0), lambda s, x: s + x).alias("expected"))


def model_scores(
    fitted: Fitted, groups: DataFrame, daily: DataFrame, days: DataFrame, span: Span, keys: Sequence[str],
    calendars: Sequence[str], by: Sequence[str],
) -> DataFrame:
    """Deviance, MAE, counts and totals of all models over the same businesses and complete-weather days, by ``by``.

    A day without a visit adds its expectation to every sum, so these days follow from the stations' sums;
    only days with visits are joined, to take back what they add and put in what they should.
    """
    keys, cell = list(keys), (F.month("day") - 1) * 7 + F.weekday("day")
    effects = checkpointed(station_effects(fitted, groups, days, span, keys))
    who = members(fitted, groups, keys)
    sums = effects.groupBy(*keys, "model", "station_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("effect").alias("sum_effect"))
    weather = who.join(sums, [*keys, "model", "station_id"]).select(
        *keys, "business_id", "model", "days", (F.col("factor") * F.col("sum_effect")).alias("expected"))
    fits = weather.select(*keys, "business_id").distinct()
    active = checkpointed(daily.where(span.holds(F.col("day"))).join(
        groups.join(fits, [*keys, "business_id"], "left_semi").select("business_id", *keys, "station_id"), "business_id").join(
        wx.complete_days(days).select("station_id", "day"), ["station_id", "day"], "left_semi"))
    visits = active.join(who.select(*keys, "business_id", "model", "factor"), [*keys, "business_id"]).join(
        effects, [*keys, "model", "station_id", "day"]).select(
        *keys, "business_id", "model", "checkins", F.greatest(F.col("factor") * F.col("effect"), F.lit(FLOOR)).alias("mu"))
    # The complete days of a station by calendar cell: 84 numbers.
    per_cell = wx.complete_days(days.where(span.holds(F.col("day")))).groupBy("station_id").agg(F.count(F.lit(1)).alias("days"), F.array(
        *[F.count_if(cell == c).cast("double") for c in range(84)]).alias("cells"))
    for name in calendars:
        rates = _daily_rates(groups.join(fits, [*keys, "business_id"], "left_semi"), keys, per_cell, name)
        weather = weather.unionByName(rates.select(*keys, "business_id", "model", "days", "expected"))
        visits = visits.unionByName(active.join(rates.select(*keys, "business_id", "model", "rates"), [*keys, "business_id"]).select(
            *keys, "business_id", "model", "checkins", F.element_at("rates", (cell + 1).cast("int")).alias("mu")))
    y, mu, none = F.col("checkins"), F.col("mu"), F.lit(0.0)
    expected = weather.select(*keys, "model", F.lit(1).alias("one"), "days", F.lit(0).cast("long").alias("y"), "expected",
                              F.col("expected").alias("deviance"), F.col("expected").alias("error"))
    seen = visits.select(*keys, "model", F.lit(0).alias("one"), F.lit(0).cast("long").alias("days"), y.alias("y"), none.alias("expected"),
                         (y * F.log(y / mu) - y).alias("deviance"), (F.abs(y - mu) - mu).alias("error"))
    every = expected.unionByName(seen).groupBy(*by, "model")
    return every.agg(
        F.sum("one").alias("businesses"), F.sum("days").alias("observations"),
        F.greatest(none, F.lit(2.0) * F.sum("deviance") / F.sum("days")).alias("poisson_deviance"),
        (F.greatest(none, F.sum("error")) / F.sum("days")).alias("mae"), F.sum("y").alias("recorded_checkins"),
        F.sum("expected").alias("predicted_checkins"))


def day_index(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Station-day effects with their running sum and the first day of the gapless run that each day is in.

    A station's days are at most those of the calendar, so a window orders them. A period wholly inside a run
    sums to ``through`` of its last day less ``before`` of its first: two look-ups, whatever its length.
    """
    order = Window.partitionBy(*keys, "model", "station_id").orderBy("day")
    numbered = effects.withColumns({
        "through": F.sum("effect").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_run": F.date_sub("day", F.row_number().over(order))})
    run = Window.partitionBy(*keys, "model", "station_id", "_run")
    return numbered.withColumn("run_start", F.min("day").over(run)).withColumn(
        "before", F.col("through") - F.col("effect")).drop("_run")


def complete_runs(days: DataFrame, span: Span) -> DataFrame:
    """(station_id, month, run_start, run_days, complete_days, whole): the longest gapless run of complete days
    of every station and calendar month of the span that has one, the earliest of equals."""
    order = Window.partitionBy("station_id", "month").orderBy("day")
    inside = wx.complete_days(days.where(span.holds(F.col("day")))).select(
        "station_id", "day", F.trunc("day", "month").alias("month"))
    runs = inside.withColumn("_run", F.date_sub("day", F.row_number().over(order))).groupBy("station_id", "month", "_run").agg(
        F.min("day").alias("run_start"), F.count(F.lit(1)).alias("run_days"))
    longest = F.max_by(F.struct("run_start", "run_days"), F.struct("run_days", -F.unix_date("run_start")))
    return runs.groupBy("station_id", "month").agg(longest.alias("r"), F.sum("run_days").alias("complete_days")).select(
        "station_id", "month", "r.run_start", "r.run_days", "complete_days",
        (F.col("r.run_days") == F.dayofmonth(F.last_day("month"))).alias("whole"))


def period_totals(index: DataFrame, who: DataFrame, periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Projections of every business over periods (station_id, period, start_day, end_day) that its station covers.

    A period with a missing day has no total, as a part of one would be ranked against whole ones.
    """
    group = [*keys, "model", "station_id"]
    last = index.select(*group, F.col("day").alias("end_day"), "through", "run_start")
    first = index.select(*group, F.col("day").alias("start_day"), "before")
    covered = periods.join(last, ["station_id", "end_day"]).where(F.col("run_start") <= F.col("start_day")).join(
        first, [*group, "start_day"])
    days = F.datediff("end_day", "start_day") + 1
    total = F.col("factor") * (F.col("through") - F.col("before"))
    return covered.join(who, group).select(
        *keys, "business_id", "model", "period", "start_day", "end_day", total.alias("projected"),
        (total / days).alias("daily_rate"))


def station_normals(days: DataFrame, span: Span) -> DataFrame:
    """Mean weather per station and calendar month over complete days; months never observed are absent."""
    complete = wx.complete_days(days.where(span.holds(F.col("day"))))
    return complete.groupBy("station_id", F.month("day").alias("month")).agg(*[F.avg(c).alias(c) for c in WEATHER])


def coherent(weather: DataFrame) -> DataFrame:
    """Given weather as it is; a line that no day can have fails the job."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in WEATHER]
    good = finite[0] & finite[1] & finite[2] & (F.col("tmin") <= F.col("tmax")) & (F.col("pcpn") >= 0)
    return weather.where(F.when(good, F.lit(True)).otherwise(F.raise_error(
        F.lit("Choose coherent low/high temperatures and nonnegative daily rain.")).cast("boolean")))


def scenario_totals(fitted: Fitted, groups: DataFrame, weather: DataFrame, exposure: Sequence[int],
                    keys: Sequence[str]) -> DataFrame:
    """Projection and daily rate per business and model under monthly weather (station_id, month, WEATHER).

    ``exposure`` counts the days ahead in each of the 84 calendar cells. A station without weather for one of
    their months leaves out its businesses. Cells are summed per station before any business is joined.
    """
    cells = [(c // 7 + 1, c % 7, float(n)) for c, n in enumerate(exposure) if n]
    months = sorted({m for m, _, _ in cells})
    counted = F.array(*[F.struct(F.lit(m).alias("month"), F.lit(d).alias("weekday"), F.lit(n).alias("days")) for m, d, n in cells])
    wanted = weather.where(F.col("month").isin(months))
    whole = wanted.groupBy("station_id").agg(F.countDistinct("month").alias("_m")).where(F.col("_m") == len(months)).select("station_id")
    spread_ = wanted.join(whole, "station_id").withColumn("_cell", F.explode(counted)).where(
        F.col("_cell.month") == F.col("month")).select("station_id", "month", "_cell.weekday", "_cell.days", *WEATHER)
    places = groups.where(F.col("station_id").isNotNull()).select(*keys, "station_id").distinct()
    sums = linear(fitted, places.join(spread_, "station_id"), keys, ["station_id"]).groupBy(*keys, "model", "station_id").agg(
        F.sum(F.col("days") * F.col("effect")).alias("ahead"))
    total = F.col("factor") * F.col("ahead")
    return members(fitted, groups, keys).join(sums, [*keys, "model", "station_id"]).select(
        *keys, "business_id", "model", total.alias("projected"), (total / F.lit(float(sum(exposure)))).alias("daily_rate"))


def top_of(rows: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """The ``n`` highest predictions of every group with their ``place``; ties go to smaller ids, then models."""
    order = Window.partitionBy(*group).orderBy(F.round("predicted", 9).desc(), "business_id", "model")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def scenario_cells(groups: DataFrame, normals: DataFrame, keys: Sequence[str],
                   months: Sequence[int]) -> DataFrame:
    """Calendar cells of businesses that have normals for every requested month."""
    wanted = normals.where(F.col("month").isin(list(months)))
    whole = wanted.groupBy("business_id", "parent").agg(F.count(F.lit(1)).alias("_m")).where(
        F.col("_m") == len(set(months))).drop("_m")
    return groups.select("business_id", *keys).join(
        whole, ["business_id", "parent"]).join(wanted, ["business_id", "parent"]).select(
        *keys, "business_id", "month",
        F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"), *WEATHER)


def observed_days(groups: DataFrame, days: DataFrame, span: Span, keys: Sequence[str]) -> DataFrame:
    """Rows of businesses whose station has every day of the span complete."""
    complete = wx.complete_days(days.where(span.holds(F.col("day"))))
    whole = complete.groupBy("station_id").agg(F.count(F.lit(1)).alias("_d")).where(
        F.col("_d") == span.days).drop("_d")
    return groups.select("business_id", *keys, "station_id").join(
        whole, "station_id").join(complete, "station_id").select(
        *keys, "business_id", "day", F.month("day").alias("month"),
        F.weekday("day").alias("weekday"), *WEATHER)


def explicit_weather(groups: DataFrame, keys: Sequence[str], day, weather: Sequence[float],
                     unit: str = "business_id") -> DataFrame:
    """Every business (or station) on one day under one coherent scenario."""
    tmin, tmax, rain = weather
    if not all(np.isfinite(weather)) or tmin > tmax or rain < 0:
        raise ValueError("Choose coherent low/high temperatures and nonnegative daily rain.")
    at = F.lit(day)
    return groups.select(
        *keys, unit, at.alias("day"), F.month(at).alias("month"),
        F.weekday(at).alias("weekday"), *[F.lit(float(v)).alias(c) for c, v in zip(WEATHER, weather)])
