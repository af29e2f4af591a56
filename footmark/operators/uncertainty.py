"""Area demand estimator and bootstrap intervals.

The estimator needs sums alone: one Gram matrix a scope, and each area's own row to take itself out of it.
Nothing compares areas with areas, so the work grows with their number.

Draws are counter-based: the pick of a slot in a draw is a digest of seed, area, stream, draw and slot, so it
needs no generator, no order of work and no state, and any engine with MD5 can replay it. A key's picks are
dealt out with its members, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.config import ScoringConfig
from footmark.operators import sites
from footmark.operators.ordering import running_totals

FEATURES = ("f0", "f1", "f2", "f3")
MISSING = 1  # the feature that may be unknown
# The extended row: one, the features (an unknown one as 0), whether it is unknown, the target.
ROWS, COLUMNS = np.triu_indices(len(FEATURES) + 3)
PICKS = 4  # 32-bit numbers of a digest
CHUNK = 1024  # slots that are dealt out together


# ---- estimator ----------------------------------------------------------------------------


def estimator_rows(
    inputs: DataFrame, rivals: DataFrame, scope: Sequence[str], days: int, config: ScoringConfig
) -> DataFrame:
    """Four features and the target per area; only areas with enough members train."""
    near = rivals.groupBy(*scope, "area_id").agg(F.sum("n").alias("near"))
    trains = F.col("members") >= config.min_observed_businesses
    rate = F.col("niche_checkins") / (F.col("members") * F.lit(days))
    return inputs.join(near, [*scope, "area_id"], "left").select(
        *scope, "area_id", F.log1p("parents").alias("f0"), F.col("parent_stars").alias("f1"),
        F.log1p("parent_reviews").alias("f2"),
        F.log1p(F.coalesce("near", F.lit(0))).alias("f3"),
        F.when(trains, F.log1p(F.lit(1000.0) * rate)).alias("y"))


def gram_sums(train: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, gram, n_train): the upper triangle of the sum of outer products of the extended rows."""
    known = [F.coalesce(F.col(f), F.lit(0.0)) if i == MISSING else F.col(f) for i, f in enumerate(FEATURES)]
    row = [F.lit(1.0), *known, F.col(FEATURES[MISSING]).isNull().cast("double"), F.col("y")]
    return train.groupBy(*scope).agg(
        F.array(*[F.sum(row[i] * row[j]) for i, j in zip(ROWS.tolist(), COLUMNS.tolist())]).alias("gram"),
        F.count(F.lit(1)).alias("n_train"))


def _extended(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    unknown = np.isnan(x[:, MISSING])
    return np.column_stack([np.ones(len(x)), np.where(np.isnan(x), 0.0, x), unknown, y])


class Ridge:
    """Ridge regressions on standardized features, one for each Gram matrix of a stack.

    An unknown value takes the mean of the known ones. With the fill value the filled row is a linear map of
    the extended row, so its sums are the mapped Gram matrix.
    """

    def __init__(self, gram: np.ndarray):
        k, n = len(FEATURES), len(gram)
        column = MISSING + 1
        known = gram[:, 0, 0] - gram[:, 0, k + 1]
        self.fill = np.divide(gram[:, 0, column], known, out=np.zeros(n), where=known > 0.5)
        fill = np.zeros((n, k + 3, k + 2))
        fill[:, range(k + 1), range(k + 1)] = 1.0
        fill[:, k + 1, column] = self.fill
        fill[:, k + 2, k + 1] = 1.0
        sums = fill.transpose(0, 2, 1) @ gram @ fill
        self.count = sums[:, 0, 0]
        mean = sums[:, 0, 1:] / self.count[:, None]
        self.mean, self.centre = mean[:, :k], mean[:, k]
        spread = sums[:, 1:, 1:] - self.count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        variance = np.maximum(spread[:, range(k), range(k)], 0.0) / self.count[:, None]
        varies = variance > 1e-12 * (1.0 + self.mean**2)
        self.scale = np.where(varies, np.sqrt(variance), 1.0)
        both = varies[:, :, None] & varies[:, None, :]
        self.gram = np.where(both, spread[:, :k, :k] / (self.scale[:, :, None] * self.scale[:, None, :]), 0.0)
        self.moment = np.where(varies, spread[:, :k, k] / self.scale, 0.0)

    def standardized(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill[:, None], x) - self.mean) / self.scale

    def inverse(self, alpha: np.ndarray) -> np.ndarray:
        return np.linalg.inv(self.gram + alpha[:, None, None] * np.eye(len(FEATURES)))

    def predict(self, x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        coefficients = np.einsum("nij,nj->ni", self.inverse(alpha), self.moment)
        return np.einsum("ni,ni->n", self.standardized(x), coefficients) + self.centre

    def left_out_errors(self, x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
        """Each training row's squared error by the fit without it, from its leverage."""
        inverse = self.inverse(np.full(len(x), alpha))
        z = self.standardized(x)
        fitted = np.einsum("ni,nij,nj->n", z, inverse, self.moment) + self.centre
        leverage = np.einsum("ni,nij,nj->n", z, inverse, z) + 1.0 / self.count
        return ((y - fitted) / (1.0 - leverage)) ** 2


def _rowwise(rows: DataFrame, keep: Sequence[str], outputs: str, run) -> DataFrame:
    """Columns computed in Arrow batches from features, target and Gram matrix of every row on its own."""
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), outputs])
    number = lambda batch, c: batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            x = np.column_stack([number(batch, f) for f in FEATURES])
            gram = np.zeros((len(x), len(FEATURES) + 3, len(FEATURES) + 3))
            gram[:, ROWS, COLUMNS] = batch["gram"].flatten().to_numpy().reshape(len(x), -1)
            gram[:, COLUMNS, ROWS] = gram[:, ROWS, COLUMNS]
            alpha = number(batch, "alpha") if "alpha" in batch.schema.names else None
            found = run(x, number(batch, "y"), gram, alpha)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *map(pa.array, found.values())],
                                             names=[*keep, *found])

    return rows.mapInArrow(batches, schema)


def ridge_state(rows: DataFrame, scope: Sequence[str], config: ScoringConfig) -> DataFrame:
    """(scope, gram, n_train, alpha) of scopes with enough training areas.

    The penalty is the first one of least mean squared leave-one-out error over the scope's areas.
    """
    train = rows.where(F.col("y").isNotNull())
    sums = gram_sums(train, scope).where(F.col("n_train") >= config.min_estimator_train_areas)
    names = [f"e{i}" for i in range(len(config.ridge_alphas))]

    def errors(x, y, gram, _):
        model = Ridge(gram)
        return {n: model.left_out_errors(x, y, a) for n, a in zip(names, config.ridge_alphas)}

    judged = _rowwise(train.join(sums, list(scope)), scope, ", ".join(f"{n} double" for n in names), errors)
    mean = F.array(*[F.round(F.avg(n), 12) for n in names])
    best = judged.groupBy(*scope).agg(mean.alias("mean")).select(*scope, F.element_at(
        F.array(*map(F.lit, config.ridge_alphas)),
        F.array_position("mean", F.array_min("mean")).cast("int")).alias("alpha"))
    return sums.join(best, list(scope))


def leave_one_out(rows: DataFrame, scope: Sequence[str], config: ScoringConfig,
                  state: DataFrame | None = None) -> DataFrame:
    """Held-out and baseline residual of every training area.

    An area takes its own outer product out of its scope's Gram matrix; what is left fits the fill value, the
    scaling and the coefficients that predict it.
    """
    state = ridge_state(rows, scope, config) if state is None else state
    train = rows.where(F.col("y").isNotNull()).join(state, list(scope))

    def held_out(x, y, gram, alpha):
        own = _extended(x, y)
        rest = gram - own[:, :, None] * own[:, None, :]
        return {"residual": y - Ridge(rest).predict(x, alpha), "baseline": y - rest[:, 0, -1] / rest[:, 0, 0]}

    return _rowwise(train, [*scope, "area_id", "y"], "residual double, baseline double", held_out)


def estimator_report(rows: DataFrame, folds: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Training size, errors, skill and whether the estimator may be used."""
    trained = rows.groupBy(*scope).agg(F.count("y").alias("n_train"))
    cv = folds.groupBy(*scope).agg(
        F.avg(F.abs("residual")).alias("mae_model"), F.avg(F.abs("baseline")).alias("mae_baseline"),
        F.stddev_samp("residual").alias("residual_sd"))
    skill = F.when(F.col("mae_baseline") < 1e-12, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.col("mae_model") / F.col("mae_baseline"))
    joined = trained.join(cv, list(scope), "left").withColumn(
        "skill", F.when(F.col("mae_model").isNotNull(), skill))
    return joined.withColumn("reason", F.when(
        F.col("skill").isNull(), "insufficient_training_areas").when(
        F.col("skill") <= 1e-9, "no_skill").otherwise("ok"))


def model_rates(
    rows: DataFrame, report: DataFrame, rates: DataFrame, scope: Sequence[str],
    config: ScoringConfig, state: DataFrame | None = None,
) -> DataFrame:
    """Demand rate per area from the fit on all training areas, or the metro mean where it is disabled."""
    state = ridge_state(rows, scope, config) if state is None else state
    usable = report.where(F.col("reason") == "ok").select(*scope, "residual_sd")
    fitted = _rowwise(
        rows.join(state.join(usable, list(scope)), list(scope)), [*scope, "area_id", "residual_sd"], "value double",
        lambda x, y, gram, alpha: {"value": Ridge(gram).predict(x, alpha)})
    estimate = F.when(F.col("value").isNotNull(), F.greatest(F.lit(0.0), F.expm1("value") / F.lit(1000.0)))
    return (
        rows.select(*scope, "area_id").join(fitted, [*scope, "area_id"], "left").join(rates, list(scope))
        .select(*scope, "area_id", F.coalesce(estimate, F.col("metro_rate")).alias("model_rate"),
                F.col("value").isNull().alias("model_fallback"), "residual_sd")
    )


# ---- bootstrap ----------------------------------------------------------------------------


def _digest(seed: str, stream: int, draw: Column, block: Column) -> Column:
    """The digest of a seed, area, stream, draw and block."""
    return F.md5(F.concat_ws(":", F.col(seed).cast("string"), F.col("area_id").cast("string"), F.lit(str(stream)),
                             draw.cast("string"), block.cast("string")))


def _numbers(digest: Column) -> list[Column]:
    """Four independent 32-bit numbers of a digest."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(PICKS)]


def slots(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: str) -> DataFrame:
    """Every row once for each of the members it stands for, with ``slot`` (from 0) and the key's ``_n`` members.

    ``order`` may leave rows tied that are alike in all that is drawn. Few rows may stand for many members, and
    few bytes make many draws, so members are dealt out in chunks to a fixed number of tasks.
    """
    placed = running_totals(rows, keys, order, weight, "_through", "_n").where(F.col(weight) > 0)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.col("_through") - 1
    chunks = placed.withColumn("_first", F.explode(F.sequence(
        F.col("_through") - F.col(weight), last, F.lit(CHUNK).cast("long")))).repartition(tasks, *keys, "_first")
    return chunks.withColumn("slot", F.explode(F.sequence(
        F.col("_first"), F.least(F.col("_first") + (CHUNK - 1), last)))).drop("_first", "_through")


def picks(placed: DataFrame, keys: Sequence[str], seed: str, stream: int, draws: int) -> DataFrame:
    """(keys, draw, slot): as many slots as a key has, picked with replacement and equal chance, in every draw.

    Every fourth slot's row makes the picks of four, from one digest: the work is spread as the members are.
    """
    block = F.col("slot") / PICKS
    rows = placed.where(F.col("slot") % PICKS == 0).select(
        *keys, seed, "_n", "slot", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    digests = rows.withColumn("_digest", _digest(seed, stream, F.col("draw"), block.cast("long")))
    picked = F.array(*[F.when(F.col("slot") + i < F.col("_n"), F.shiftright(number * F.col("_n"), 32))
                       for i, number in enumerate(_numbers(F.col("_digest")))])
    return digests.select(*keys, "draw", F.explode(picked).alias("slot")).where(F.col("slot").isNotNull())


def resample(
    rows: DataFrame, keys: Sequence[str], stable: str | Sequence[Column], weight: str, values: Sequence[str],
    seed: str, stream: int, draws: int,
) -> DataFrame:
    """Sums of ``values`` over a multinomial draw of a key's members, per key and draw.

    A row stands for ``weight`` equal members; a key has as many picks as members. ``stable`` orders them.
    """
    placed = slots(rows, keys, [stable] if isinstance(stable, str) else stable, weight)
    picked = picks(placed, keys, seed, stream, draws)
    return picked.join(placed.select(*keys, "slot", *values), [*keys, "slot"]).groupBy(*keys, "draw").agg(
        *[F.sum(v).alias(v) for v in values])


def noise(seed: str, stream: int, draw: str, sd: str) -> Column:
    """A normal draw of mean 0, from two numbers by Box and Muller."""
    first, second, *_ = _numbers(_digest(seed, stream, F.col(draw), F.lit(0)))
    unit = lambda number: (number + F.lit(0.5)) / F.lit(2.0**32)
    return F.col(sd) * F.sqrt(F.lit(-2.0) * F.ln(unit(first))) * F.cos(F.lit(2 * math.pi) * unit(second))


def draw_metrics(
    metrics: DataFrame, members: DataFrame, rivals: DataFrame, scope: Sequence[str], days: int,
    months: Sequence[str], config: ScoringConfig,
) -> DataFrame:
    """Metric values per area and draw (wide).

    ``members``: keys, business_id, seed, checkins and one column per covered month.
    ``rivals``: keys, seed, stars, review_count, n. Competition and weather keep their point value.
    """
    keys, draws = [*scope, "area_id"], config.n_bootstrap
    one = members.withColumn("_one", F.lit(1).cast("long"))
    mine = resample(one, keys, "business_id", "_one", ["checkins", *months], "seed", 0, draws)
    w = F.log1p(F.greatest("review_count", F.lit(0)))
    rated = F.col("stars").isNotNull()
    near = rivals.withColumns({
        "ws": F.when(rated, w * F.col("stars")).otherwise(0.0), "w": F.when(rated, w).otherwise(0.0),
        "s": F.coalesce("stars", F.lit(0.0)), "c": F.when(rated, 1.0).otherwise(0.0)})
    order = [F.col("stars").asc_nulls_first(), F.col("review_count").asc_nulls_first()]
    gaps = resample(near, keys, order, "n", ["ws", "w", "s", "c"], "seed", 1, draws).select(
        *keys, "draw", (F.lit(5.0) - F.when(F.col("w") > 0, F.col("ws") / F.col("w")).otherwise(
            F.try_divide("s", "c"))).alias("_gap"))
    base = metrics.select(
        *keys, "postal_code", "members", "metro_rate", "model_rate", "model_fallback", "seed",
        "residual_sd", "competition", "weather_resilience", F.col("quality_gap").alias("_point_gap"),
        F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    noisy = (F.col("members") < config.min_observed_businesses) & ~F.col("model_fallback") & F.col(
        "residual_sd").isNotNull()
    rows = base.join(mine, [*keys, "draw"], "left").join(gaps, [*keys, "draw"], "left").withColumn(
        "_noise", F.when(noisy, noise("seed", 2, "draw", "residual_sd")))
    n, k = F.col("members"), F.lit(config.shrinkage_k)
    model = F.when(F.col("_noise").isNotNull(), F.greatest(F.lit(0.0), F.expm1(
        F.log1p(F.lit(1000.0) * F.col("model_rate")) + F.col("_noise")) / F.lit(1000.0))).otherwise(
        F.col("model_rate"))
    checkins = F.coalesce("checkins", F.lit(0.0))
    shrunk = (checkins / F.lit(days) + k * F.col("metro_rate")) / (n + k)
    share = n / F.lit(config.min_observed_businesses)
    demand = F.when(n >= config.min_observed_businesses, shrunk).otherwise(
        share * shrunk + (F.lit(1.0) - share) * model)
    momentum, stability = F.lit(None).cast("double"), F.lit(None).cast("double")
    span, count = config.momentum_window_months, len(months)
    values = [F.coalesce(m, F.lit(0.0)) for m in months]
    if count >= max(config.min_months_momentum, 2 * span):
        last, prior = reduce(add, values[-span:]), reduce(add, values[-2 * span:-span])
        momentum = F.when(last + prior > 0, (last - prior) / (last + prior))
    if count:
        mean = reduce(add, values) / F.lit(count)
        square = reduce(add, [v * v for v in values]) / F.lit(count)
        active = reduce(add, [(v > 0).cast("int") for v in values])
        spread_ = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
        stability = F.when((active >= config.min_months_stability) & (mean > 0),
                           F.lit(1.0) - F.least(F.lit(1.0), spread_ / mean))
    return rows.select(
        *keys, "postal_code", "draw", F.greatest(F.lit(0.0), demand).alias("demand_rate"),
        "competition", F.when(F.col("_point_gap").isNotNull(), F.col("_gap")).alias("quality_gap"),
        momentum.alias("momentum"), stability.alias("stability"), "weather_resilience")


def draw_scores(draws: DataFrame, scope: Sequence[str], weights: Column) -> DataFrame:
    """Score of every area in every draw; percentiles are taken inside each draw.

    The weights of an area are normalised over its available metrics without an array per area.
    """
    keys = [*scope, "area_id", "draw"]
    rows = sites.percentiles(sites.metric_rows(draws, keys), [*scope, "draw"]).withColumn(
        "w", F.element_at(weights, (F.col("position") + 1).cast("int")))
    usable = F.col("p").isNotNull()
    w = F.sum(F.when(usable, F.col("w")))
    weighted = F.sum(F.when(usable, F.col("w") * F.col("p")))
    return rows.groupBy(*keys).agg(F.round(F.least(F.lit(100.0), F.greatest(
        F.lit(0.0), F.lit(100.0) * F.when(w > 0, weighted / w).otherwise(F.avg("p")))), 9)
        .alias("draw_score"))


def intervals(
    points: DataFrame, drawn: DataFrame, scope: Sequence[str], config: ScoringConfig
) -> DataFrame:
    """Score and rank bounds, clamped to the point; "tied with above" by overlapping ranks.

    Each area has one row per draw (200), so its sorted arrays are bounded.
    """
    keys = [*scope, "area_id"]
    # The areas of a scope in one draw: a number set by geography.
    ranks = drawn.withColumn("draw_rank", F.rank().over(
        Window.partitionBy(*scope, "draw").orderBy(F.col("draw_score").desc())).cast("long"))
    low, high = config.interval_low, config.interval_high
    packed = ranks.groupBy(*keys).agg(
        F.percentile("draw_score", F.array(F.lit(low), F.lit(high))).alias("_s"),
        F.array_sort(F.collect_list("draw_rank")).alias("_r"))
    last = F.size("_r") - 1
    at = lambda i: F.element_at("_r", (i + 1).cast("int"))
    bounds = packed.select(
        *keys, F.col("_s")[0].alias("_sl"), F.col("_s")[1].alias("_sh"),
        at(F.floor(F.round(last * F.lit(low), 9))).alias("_rl"),
        at(F.ceil(F.round(last * F.lit(high), 9))).alias("_rh"))
    joined = points.join(bounds, keys).withColumns({
        "score_low": F.least("_sl", "score"), "score_high": F.greatest("_sh", "score"),
        "rank_low": F.least("_rl", "rank"), "rank_high": F.greatest("_rh", "rank"),
    }).drop("_sl", "_sh", "_rl", "_rh")
    above = F.lag("rank_high").over(Window.partitionBy(*scope).orderBy("rank"))
    return joined.withColumn("tied_with_above", F.coalesce(F.col("rank_low") <= above, F.lit(False)))
