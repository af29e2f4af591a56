"""Calendar projection: fit, evaluation with all zero days, projection and model comparison.

A business is one row with an array of 84 rates (month x weekday), so fitting shuffles sparse
counts only and projecting needs no day table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.config import ForecastConfig
from footmark.functions import dates
from footmark.functions.dates import Span
from footmark.operators.ordering import rank_rows

CELLS = 84
MODELS = ("overall_mean", "month_weekday_shrunk")
FLOOR = 1e-12


def exposure(span: Span) -> list[int]:
    """Days of the span per calendar cell, month by month: whole weeks, then the days left over."""
    out = [0] * CELLS
    first = span.start
    while first <= span.end:
        following = (first.replace(day=1) + timedelta(days=32)).replace(day=1)
        days = min((following - first).days, (span.end - first).days + 1)
        for weekday in range(7):
            extra = (weekday - first.weekday()) % 7 < days % 7
            out[(first.month - 1) * 7 + weekday] += days // 7 + extra
        first += timedelta(days=days)
    return out


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def first_activity(daily: DataFrame) -> DataFrame:
    return daily.groupBy("business_id").agg(F.min("day").alias("first_activity"))


def _cells(found: str) -> Column:
    """84 counts from a map of at most 84 cells. Without a lambda, in which the map would be made anew for every cell."""
    return F.array(*[F.coalesce(F.try_element_at(found, F.lit(c)), F.lit(0)).cast("double") for c in range(CELLS)])


def fit(
    daily: DataFrame, businesses: DataFrame, scope: Sequence[str], span: Span, coverage: Span,
    config: ForecastConfig,
) -> DataFrame:
    """Fixed cohort, support threshold and pooled prior, all from the fit window.

    ``daily``: business_id, day, checkins. ``businesses`` has scope columns, ``parent`` and
    ``categories``. The cohort had activity on or before the window start.
    """
    if not coverage.contains(span):
        raise ValueError("The training interval must have complete imported activity coverage.")
    days = exposure(span)
    if min(days) < 1:
        raise ValueError("Every month/weekday cell requires training calendar coverage.")
    cohort = first_activity(daily).where(F.col("first_activity") <= F.lit(span.start))
    window = daily.where(span.holds(F.col("day")))
    per_cell = window.groupBy("business_id", dates.calendar_cell(F.col("day")).alias("cell")).agg(
        F.sum("checkins").alias("n"), F.count_if(F.col("checkins") > 0).alias("active"))
    per_business = per_cell.groupBy("business_id").agg(
        F.sum("n").alias("training_checkins"), F.sum("active").alias("active_days"),
        F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("_found"),
    ).withColumn("counts", _cells("_found")).drop("_found")
    keys = [*scope, "parent"]
    supported = (
        per_business.where(F.col("training_checkins") >= config.min_training_checkins)
        .join(cohort, "business_id")
        .join(businesses.select("business_id", "name", *keys, "categories", "station_id"),
              "business_id")
    )
    pool = supported.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_members"),
        F.array(*[F.sum(F.col("counts")[i]) for i in range(CELLS)]).alias("_pooled"))
    prior = F.lit(float(config.prior_business_days))
    triples = F.arrays_zip(F.col("counts"), F.col("_pooled"), _array(days).alias("exposed"))
    rates = F.transform(triples, lambda t: (
        t["counts"] + prior * t["_pooled"] / (F.col("_members") * t["exposed"])
    ) / (t["exposed"] + prior))
    return supported.join(pool, keys).select(
        "business_id", "name", *keys,
        F.array_sort(F.array_distinct(F.array_remove("categories", F.col("parent"))))
        .alias("source_categories"), "station_id", "training_checkins", "active_days",
        (F.col("training_checkins") / F.lit(span.days)).alias("overall_rate"),
        rates.alias("rates"))


def with_model(groups: DataFrame, model: str) -> DataFrame:
    if model not in MODELS:
        raise ValueError("Unknown calendar projection model.")
    if model == "overall_mean":
        return groups.withColumn("rates", F.array_repeat("overall_rate", CELLS))
    return groups


def expected(groups: DataFrame, span: Span) -> DataFrame:
    """Expected check-ins of every business over the span."""
    return groups.withColumn("predicted", _dot(F.col("rates"), _array(exposure(span))))


def business_errors(groups: DataFrame, daily: DataFrame, span: Span) -> DataFrame:
    """Deviance and absolute-error sums per business over every day of the span.

    Zero days are scored through exposure x rate; observed days then replace their share. The
    join carries active days only, yet equals the dense daily score.
    """
    base = expected(groups, span).withColumn("_floor", _dot(
        F.transform("rates", lambda r: F.greatest(r, F.lit(FLOOR))), _array(exposure(span))))
    y = F.col("checkins")
    rate = F.element_at("rates", (dates.calendar_cell(F.col("day")) + 1).cast("int"))
    mu = F.greatest(rate, F.lit(FLOOR))
    active = daily.where(span.holds(F.col("day")) & (y > 0)).join(
        groups.select("business_id", "parent", "rates"), "business_id")
    corrections = active.groupBy("business_id", "parent").agg(
        F.sum(F.lit(2.0) * (y * F.log(y / mu) - y)).alias("_dev"),
        F.sum(F.abs(y - rate) - rate).alias("_abs"), F.sum(y).alias("observed"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return base.join(corrections, ["business_id", "parent"], "left").select(
        *[c for c in groups.columns if c != "rates"], "predicted",
        F.coalesce("observed", F.lit(0)).alias("observed"),
        (F.lit(2.0) * F.col("_floor") + z("_dev")).alias("deviance_sum"),
        (F.col("predicted") + z("_abs")).alias("error_sum"),
        F.lit(span.days).alias("observations"))


def scores(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.sum("observations")
    return errors.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), F.sum("deviance_sum") / n).alias("poisson_deviance"),
        F.greatest(F.lit(0.0), F.sum("error_sum") / n).alias("mae"),
        F.count(F.lit(1)).alias("businesses"), n.alias("observations"),
        F.sum("observed").alias("recorded_checkins"),
        F.sum("predicted").alias("predicted_checkins"))


def niche_agreement(errors: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Per overlapping niche with two or more businesses: do observed and predicted leaders agree."""
    niche = [*scope, "parent", "source"]
    rows = errors.select("business_id", *scope, "parent", F.explode("source_categories").alias("source"),
                         "observed", F.round("predicted", 9).alias("predicted"))
    led = lambda c: F.min_by("business_id", F.struct(-F.col(c), F.col("business_id")))
    return rows.groupBy(*niche).agg(
        F.count(F.lit(1)).alias("members"), led("observed").alias("observed_leader"),
        led("predicted").alias("predicted_leader"),
    ).where("members >= 2").withColumn(
        "agrees", F.col("observed_leader") == F.col("predicted_leader"))


def observed_and_predicted_ranks(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    one = rank_rows(errors.withColumn("_p", F.round("predicted", 9)), keys,
                    [F.col("observed").desc(), F.col("business_id").asc()], "observed_rank")
    return rank_rows(one, keys, [F.col("_p").desc(), F.col("business_id").asc()],
                     "predicted_rank").drop("_p")


def evaluate_models(
    groups: DataFrame, daily: DataFrame, span: Span, keys: Sequence[str] = ()
) -> DataFrame:
    """Both calendar models on the same businesses and days."""
    out = None
    for i, model in enumerate(MODELS):
        rows = scores(business_errors(with_model(groups, model), daily, span), keys).withColumns(
            {"model": F.lit(model), "model_order": F.lit(i)})
        out = rows if out is None else out.unionByName(rows)
    return out


def select_model(metrics: DataFrame) -> DataFrame:
    """Least deviance wins, model order breaks ties."""
    best = metrics.groupBy().agg(F.min_by("model", F.struct("poisson_deviance", "model_order")))
    return best.toDF("selected")


def temporal_selection(
    daily: DataFrame, businesses: DataFrame, scope: Sequence[str], coverage: Span,
    config: ForecastConfig, windows: dict[str, tuple[Span, Span]],
) -> DataFrame:
    """Fit and score each (fit window, score window); a fixed handful of stages."""
    out = None
    for stage, (train, assess) in windows.items():
        if train.end >= assess.start or not coverage.contains(assess):
            raise ValueError("Assessment needs a fully covered year after the training cutoff.")
        groups = fit(daily, businesses, scope, train, coverage, config)
        rows = evaluate_models(groups, daily, assess).withColumn("stage", F.lit(stage))
        out = rows if out is None else out.unionByName(rows)
    return out


def project(
    groups: DataFrame, span: Span, training_end, config: ForecastConfig
) -> DataFrame:
    """Total and daily expected check-ins after the training period."""
    if span.start <= training_end:
        raise ValueError("Projection dates must follow the archived training period.")
    return expected(groups, span).withColumnRenamed("predicted", "projected").withColumn(
        "daily_rate", F.col("projected") / F.lit(span.days)).drop("rates")


def daily_projection(groups: DataFrame, span: Span) -> DataFrame:
    day = F.col("day")
    return groups.select("*", F.explode(dates.day_array(span)).alias("day")).withColumn(
        "projected", F.element_at("rates", (dates.calendar_cell(day) + 1).cast("int"))).drop("rates")


def scope_projection(groups: DataFrame, scope: Sequence[str], span: Span) -> DataFrame:
    """Supported members' sum per day: rates add up per scope before days are laid out."""
    totals = groups.groupBy(*scope).agg(
        F.array(*[F.sum(F.col("rates")[i]) for i in range(CELLS)]).alias("rates"),
        F.count(F.lit(1)).alias("members"))
    return daily_projection(totals, span)


def tag_projection(projected: DataFrame, businesses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Projected total per source tag over supported members beside the catalog count."""
    catalog = businesses.select(*scope, F.explode("categories").alias("tag")).groupBy(
        *scope, "tag").agg(F.count(F.lit(1)).alias("catalog_businesses"))
    modelled = projected.select(*scope, F.explode("source_categories").alias("tag"), "projected")
    sums = modelled.groupBy(*scope, "tag").agg(
        F.count(F.lit(1)).alias("modeled_businesses"), F.sum("projected").alias("projected"))
    return catalog.join(sums, [*scope, "tag"], "left").withColumn(
        "modeled_businesses", F.coalesce("modeled_businesses", F.lit(0)))


def month_comparison(groups: DataFrame, daily: DataFrame, span: Span) -> DataFrame:
    """Recorded and predicted totals per month for both models, recorded shown once."""
    months = daily.where(span.holds(F.col("day"))).join(
        groups.select("business_id", "parent"), "business_id").groupBy(
        dates.month_start(F.col("day")).alias("month")).agg(
        F.sum("checkins").cast("double").alias("checkins")).withColumn(
        "series", F.lit("Recorded check-ins"))
    for model in MODELS:
        rates = with_model(groups, model)
        part = scope_projection(rates, ["parent"], span).groupBy(
            dates.month_start(F.col("day")).alias("month")).agg(
            F.sum("projected").alias("checkins")).withColumn("series", F.lit(model))
        months = months.unionByName(part)
    return months


def error_reduction(reference: Column, candidate: Column) -> Column:
    """Positive means a smaller error."""
    return F.when(reference > 0, F.lit(100.0) * (reference - candidate) / reference)


def compare_models(metrics: DataFrame, keys: Sequence[str], base: str, other: str) -> DataFrame:
    """Base and other deviance side by side with the error reduction."""
    wide = metrics.groupBy(*keys).agg(
        F.max(F.when(F.col("model") == base, F.col("poisson_deviance"))).alias("base_deviance"),
        F.max(F.when(F.col("model") == other, F.col("poisson_deviance"))).alias("other_deviance"),
        F.max("businesses").alias("businesses"), F.max("observations").alias("observations"))
    return wide.withColumns({
        "error_reduction_pct": error_reduction(F.col("base_deviance"), F.col("other_deviance")),
        "other_is_lower": F.col("other_deviance") < F.col("base_deviance")})


def digest_order(groups: DataFrame, seed: int) -> DataFrame:
    """All groups with their ``position`` in the order of the digests of seed/id.

    A sample of n is ``position <= n``; the order itself is whole and repeatable.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}/"), F.col("business_id").cast("string")), 256)
    placed = rank_rows(groups.withColumn("_digest", digest), [], ["_digest", "business_id"], "position")
    return placed.drop("_digest")


def batches(groups: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Bounded identity batches in business order."""
    return rank_rows(groups, keys, [F.col("business_id").asc()], "_place").withColumn(
        "batch", F.floor((F.col("_place") - 1) / F.lit(size)).cast("int")).drop("_place")
