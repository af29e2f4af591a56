"""Area scoring: inputs, six metrics, percentiles, weights, factors and rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.config import METRIC_KEYS, METRIC_LABELS, PRESETS, ScoringConfig
from footmark.functions import dates
from footmark.functions.dates import Span
from footmark.operators import spatial
from footmark.operators import weather as wx
from footmark.operators.ordering import rank_rows


def scope_seed(*fields: Column) -> Column:
    """Stable 32-bit seed: low half of the first eight digest bytes of the joined fields."""
    digest = F.sha2(F.concat_ws("|", *fields), 256)
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")


def area_inputs(
    businesses: DataFrame, activity: DataFrame, scope: Sequence[str], covered: Span
) -> DataFrame:
    """Parent and niche aggregates per scored area. ``in_niche`` marks niche listings."""
    totals = activity.where(covered.holds(F.col("day"))).groupBy("business_id").agg(
        F.sum("n").alias("checkins"))
    n = F.coalesce("checkins", F.lit(0))
    niche = F.col("in_niche")
    rows = businesses.where(F.col("area_id").isNotNull()).join(totals, "business_id", "left")
    return rows.groupBy(*scope, "area_id", "postal_code").agg(
        F.count(F.lit(1)).alias("parents"), F.sum(n).alias("parent_checkins"),
        F.avg("stars").alias("parent_stars"), F.avg("review_count").alias("parent_reviews"),
        F.count_if(niche).alias("members"), F.count_if(niche & F.col("is_open")).alias("open_members"),
        F.coalesce(F.sum(F.when(niche, n)), F.lit(0)).alias("niche_checkins"))


def unscored_areas(areas: DataFrame, inputs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Areas without a parent business, with the reason."""
    return areas.join(inputs.select(*scope, "area_id"), [*scope, "area_id"], "left_anti").withColumn(
        "reason", F.lit("no_parent_businesses"))


def metro_rate(inputs: DataFrame, scope: Sequence[str], days: int) -> DataFrame:
    """Check-ins per member and day: a ratio of sums, 0 without members."""
    return inputs.groupBy(*scope).agg(F.coalesce(F.try_divide(
        F.sum("niche_checkins"), F.sum("members") * F.lit(days)), F.lit(0.0)).alias("metro_rate"))


def competitors(
    businesses: DataFrame, centres: DataFrame, scope: Sequence[str], radius_km: float
) -> DataFrame:
    """Open niche listings near each area centre, as a histogram over (stars, review_count)."""
    rivals = businesses.where(F.col("in_niche") & F.col("is_open"))
    return spatial.within_radius(
        centres, rivals, [*scope, "area_id"], scope, radius_km, ["stars", "review_count"])


def competition(histogram: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Competitor count and quality gap: 5 minus the log-review-weighted mean of stars."""
    rated = F.col("stars").isNotNull()
    w = F.log1p(F.greatest(F.col("review_count"), F.lit(0))) * F.col("n")
    total = F.sum(F.when(rated, w))
    weighted = F.sum(F.when(rated, w * F.col("stars"))) / total
    plain = F.sum(F.col("stars") * F.col("n")) / F.sum(F.when(rated, F.col("n")))
    return histogram.groupBy(*scope, "area_id").agg(
        F.sum("n").alias("rivals"),
        F.when(total > 0, weighted).otherwise(F.when(total.isNotNull(), plain)).alias("mean_stars"))


def trend(
    activity: DataFrame, businesses: DataFrame, scope: Sequence[str], covered: Span,
    config: ScoringConfig,
) -> DataFrame:
    """Momentum and stability from fully covered months; months without activity are zero.

    Zero months enter the population deviation through the month count, so only active months
    are stored.
    """
    months = dates.full_months(covered)
    w, count = config.momentum_window_months, len(months)
    rows = (
        activity.where(covered.holds(F.col("day")))
        .groupBy("business_id", dates.month_start(F.col("day")).alias("month"))
        .agg(F.sum("n").alias("v"))
        .join(businesses.where(F.col("in_niche") & F.col("area_id").isNotNull()).select(
            "business_id", *scope, "area_id"), "business_id")
    )
    if not months:
        rows = rows.where(F.lit(False))
    else:
        rows = rows.where(F.col("month").between(F.lit(months[0]), F.lit(months[-1])))
    monthly = rows.groupBy(*scope, "area_id", "month").agg(F.sum("v").alias("v"))
    enough = count >= max(config.min_months_momentum, 2 * w)

    def window(a: int, z: int) -> Column:
        if not enough:
            return F.lit(None).cast("long")
        hit = F.col("month").between(F.lit(months[a]), F.lit(months[z]))
        return F.coalesce(F.sum(F.when(hit, F.col("v"))), F.lit(0))

    sums = monthly.groupBy(*scope, "area_id").agg(
        window(-w, -1).alias("c1"), window(-2 * w, -w - 1).alias("c0"),
        F.count_if(F.col("v") > 0).alias("active_months"), F.sum("v").alias("s"),
        F.sum(F.col("v") * F.col("v")).alias("ss"))
    mean = F.col("s") / F.lit(max(count, 1))
    deviation = F.sqrt(F.greatest(
        F.lit(0.0), F.col("ss") / F.lit(max(count, 1)) - mean * mean))
    return sums.select(
        *scope, "area_id", F.try_divide(
            F.col("c1") - F.col("c0"), F.col("c1") + F.col("c0")).alias("momentum"),
        F.when((F.col("active_months") >= config.min_months_stability) & (mean > 0),
               F.lit(1.0) - F.least(F.lit(1.0), deviation / mean)).alias("stability"))


def weather_effects(
    reports: DataFrame, activity: DataFrame, businesses: DataFrame, scope: Sequence[str],
    covered: Span, config: ScoringConfig,
) -> DataFrame:
    """Rain and heat effects per area, stratified by month of year.

    Day counts per stratum are facts of the dominant station; only days with check-ins are
    joined for the sums, so no area x day table is built.
    """
    keys = [*scope, "area_id"]
    niche = businesses.where(F.col("in_niche") & F.col("area_id").isNotNull())
    station = wx.dominant_station(niche, keys).where(F.col("station_id").isNotNull()).select(
        *keys, "station_id")
    observed = wx.accepted(reports.where(
        covered.holds(F.col("day")) & F.col("variable").isin("tmax", "pcpn")))
    flags = observed.select(
        "station_id", "day", F.month("day").alias("month"), "variable",
        F.when(F.col("variable") == "pcpn", F.col("value") >= config.wet_day_mm)
        .otherwise(F.col("value") >= config.hot_day_c).alias("a_side"))
    strata = flags.groupBy("station_id", "variable", "month").agg(
        F.count_if("a_side").alias("n_a"), F.count_if(~F.col("a_side")).alias("n_b"))
    seen_days = observed.groupBy("station_id").agg(F.countDistinct("day").alias("observed_days"))
    daily = (
        activity.where(covered.holds(F.col("day")))
        .groupBy("business_id", "day").agg(F.sum("n").alias("v"))
        .join(niche.select("business_id", *keys), "business_id")
        .groupBy(*keys, "day").agg(F.sum("v").alias("v"))
        .join(station, keys)
    )
    sums = daily.join(flags, ["station_id", "day"]).groupBy(*keys, "variable", "month").agg(
        F.sum(F.when(F.col("a_side"), F.col("v")).otherwise(0)).alias("s_a"),
        F.sum(F.when(~F.col("a_side"), F.col("v")).otherwise(0)).alias("s_b"))
    rows = station.join(strata, "station_id").join(sums, [*keys, "variable", "month"], "left")
    s = lambda c: F.coalesce(c, F.lit(0))
    mean_b = F.try_divide(s("s_b"), F.col("n_b"))
    usable = (
        (F.col("n_a") >= config.min_stratum_days) & (F.col("n_b") >= config.min_stratum_days)
        & (mean_b > 0)
    )
    relative = F.col("n_a") * (s("s_a") / F.col("n_a") - mean_b) / mean_b

    def side(variable: str, c: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("variable") == variable, c)), F.lit(0))

    def effect(variable: str) -> Column:
        hit = usable & (F.col("variable") == variable)
        return F.try_divide(F.sum(F.when(hit, relative)), F.sum(F.when(hit, F.col("n_a"))))

    out = rows.groupBy(*keys, "station_id").agg(
        side("pcpn", F.col("n_a")).alias("wet_days"), side("pcpn", F.col("n_b")).alias("dry_days"),
        side("tmax", F.col("n_a")).alias("hot_days"),
        side("tmax", F.col("n_b")).alias("nonhot_days"),
        effect("pcpn").alias("_rain"), effect("tmax").alias("_heat"))
    rain = F.when((F.col("wet_days") >= config.min_weather_days)
                  & (F.col("dry_days") >= config.min_weather_days), F.col("_rain"))
    heat = F.when(F.col("hot_days") >= config.min_weather_days, F.col("_heat"))
    return out.join(seen_days, "station_id").select(
        *keys, "station_id", "observed_days", "wet_days", "dry_days", "hot_days", "nonhot_days",
        rain.alias("rain_effect"), heat.alias("heat_effect"),
        F.when(rain.isNotNull() & heat.isNotNull(), F.lit(1.0) - F.least(
            F.lit(1.0), (F.abs(rain) + F.abs(heat)) / F.lit(2.0))).alias("weather_resilience"))


def area_metrics(
    inputs: DataFrame, rates: DataFrame, centres: DataFrame, rivals: DataFrame, trends: DataFrame,
    effects: DataFrame, scope: Sequence[str], days: int, config: ScoringConfig,
    model: DataFrame | None = None,
) -> DataFrame:
    """All six metrics per area. ``model`` may bring ``model_rate`` and ``model_fallback``.

    Without a centre competition is unknown; with one and nobody near, it is zero.
    """
    if days <= 0:
        raise ValueError("Covered days must be positive.")
    keys = [*scope, "area_id"]
    rows = (
        inputs.join(rates, list(scope))
        .join(centres.select("area_id", F.col("latitude").alias("_lat")), "area_id", "left")
        .join(competition(rivals, scope), keys, "left").join(trends, keys, "left")
        .join(effects, keys, "left")
    )
    if model is None:
        rows = rows.withColumns({"model_rate": F.col("metro_rate"), "model_fallback": F.lit(True)})
    else:
        rows = rows.join(model, keys, "left")
    n, k = F.col("members"), F.lit(config.shrinkage_k)
    least = config.min_observed_businesses
    shrunk = (F.col("niche_checkins") / F.lit(days) + k * F.col("metro_rate")) / (n + k)
    share = n / F.lit(least)
    blend = F.when(n >= least, shrunk).otherwise(
        share * shrunk + (F.lit(1.0) - share) * F.col("model_rate"))
    source = F.when(n >= least, "observed").when(n <= 0, "model").otherwise("blended")
    rivals_n = F.when(F.col("_lat").isNotNull(), F.coalesce("rivals", F.lit(0)).cast("double"))
    out = rows.withColumns({
        "raw_demand_rate": F.when(n > 0, F.col("niche_checkins") / (n * F.lit(days))),
        "demand_rate": F.greatest(F.lit(0.0), blend), "demand_source": source,
        "competition": rivals_n, "quality_gap": F.lit(5.0) - F.col("mean_stars"),
        "observed_days": F.coalesce("observed_days", F.lit(0)),
    })
    confidence = (
        F.when((n >= config.high_min_businesses)
               & (F.col("niche_checkins") >= config.high_min_checkins)
               & F.lit(days >= config.high_min_days), "high")
        .when((n < config.low_max_businesses) | (F.col("niche_checkins") < config.low_checkins)
              | (F.col("demand_source") == "model"), "low").otherwise("medium")
    )
    missing = F.array_compact(F.array(*[
        F.when(F.col(m).isNull(), F.lit(m)) for m in METRIC_KEYS]))
    return out.withColumns({"confidence": confidence, "unavailable": missing}).drop("_lat", "rivals")


def metric_rows(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long rows (keys, metric, position, value) rounded for ranking."""
    return metrics.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(i).alias("position"),
                 F.col(m).cast("double").alias("value")) for i, m in enumerate(METRIC_KEYS)
    ]))).withColumn("value12", F.round("value", 12))


def percentiles(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Average-tie percentile per metric; fewer competitors is better.

    (average ascending rank - 1) / (n - 1); one value gives 0.5, nulls and NaN none. A group holds one row an
    area of a scope, a number set by geography, so a window ranks it; larger groups are for ``ordering``.
    """
    known = F.when(~F.isnan("value12"), F.col("value12"))
    same = Window.partitionBy(*group, "metric", known)
    every = Window.partitionBy(*group, "metric")
    rank = F.rank().over(every.orderBy(known.asc_nulls_last()))
    n = F.count(known).over(every)
    ranked = F.when(n > 1, (rank - 1 + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)) / (n - 1)).otherwise(F.lit(0.5))
    return rows.withColumn("p", F.when(known.isNotNull(), F.when(
        F.col("metric") == "competition", F.lit(1.0) - ranked).otherwise(ranked)))


def preset_weights() -> Column:
    """Array of (preset, weights in metric order): four literal rows."""
    return F.array(*[
        F.struct(F.lit(name).alias("preset"), F.array(*map(F.lit, w)).alias("weights"))
        for name, w in PRESETS.items()])


def factors(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Six factors per area with effective weight, contribution and delta.

    ``rows`` carry ``weights``. The six metrics of an area are one bounded array, so no window
    or join is needed for the weight sums.
    """
    packed = rows.groupBy(*keys, "weights").agg(F.array_sort(F.collect_list(
        F.struct("position", "metric", "value", "p"))).alias("f"))
    weight = lambda x: F.element_at("weights", (x["position"] + 1).cast("int"))
    usable = lambda x: x["value"].isNotNull() & x["p"].isNotNull()
    total = F.aggregate("f", F.lit(0.0), lambda s, x: s + F.when(usable(x), weight(x)).otherwise(0.0))
    count = F.size(F.filter("f", usable))
    sized = packed.withColumns({"_total": total, "_count": count})

    def build(x: Column) -> Column:
        w = F.when(~usable(x), F.lit(0.0)).when(
            F.col("_total") > 0, weight(x) / F.col("_total")).otherwise(
            F.lit(1.0) / F.col("_count"))
        p = F.coalesce(x["p"], F.lit(0.5))
        return F.struct(
            x["position"].alias("position"), x["metric"].alias("metric"),
            x["value"].alias("value"), F.when(usable(x), x["p"]).alias("percentile"),
            weight(x).alias("base_weight"), w.alias("effective_weight"),
            F.when(usable(x), F.lit(100.0) * w * p).otherwise(0.0).alias("contribution"),
            F.when(usable(x), F.lit(100.0) * w * (p - F.lit(0.5))).otherwise(0.0).alias("delta"),
            usable(x).alias("available"))

    return sized.select(
        *keys, F.transform("f", build).alias("factors"),
        (F.col("_total") <= 0).alias("equal_weight_fallback"))


def scores(rows: DataFrame, keys: Sequence[str], config: ScoringConfig) -> DataFrame:
    """Score, top factors, key strength and risk from the factor arrays."""
    total = F.aggregate("factors", F.lit(0.0), lambda s, x: s + x["contribution"])
    usable = F.filter("factors", lambda x: x["available"])
    order = lambda sign, magnitude: F.array_sort(F.transform(usable, lambda x: F.struct(
        (F.round(magnitude(x), 9) * sign).alias("v"), x["position"].alias("position"),
        x["metric"].alias("metric"))))
    top = F.transform(F.slice(order(F.lit(-1.0), lambda x: F.abs(x["delta"])), 1,
                              config.n_top_factors), lambda x: x["metric"])
    best = order(F.lit(-1.0), lambda x: x["delta"])
    worst = order(F.lit(1.0), lambda x: x["delta"])
    return rows.select(
        *keys, "factors", "equal_weight_fallback",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)).alias("score"),
        top.alias("top_factors"), F.try_element_at(best, F.lit(1))["metric"].alias("key_strength"),
        F.try_element_at(worst, F.lit(1))["metric"].alias("key_risk"))


def rank_scores(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rank of every area of a scope, a number set by geography."""
    order = Window.partitionBy(*group).orderBy(F.round("score", 9).desc(), "postal_code")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def score_areas(
    metrics: DataFrame, scope: Sequence[str], config: ScoringConfig
) -> DataFrame:
    """Point scores and ranks for every preset."""
    keys = [*scope, "area_id", "postal_code"]
    rows = percentiles(metric_rows(metrics, keys), scope)
    weighted = rows.select("*", F.inline(preset_weights()))
    scored = scores(factors(weighted, [*keys, "preset"]), [*keys, "preset"], config)
    return rank_scores(scored, [*scope, "preset"])


def keep_confident(
    rows: DataFrame, group: Sequence[str], minimum: str, top_n: int
) -> DataFrame:
    """Confidence at least the minimum, ranks unchanged, first n of each group."""
    if top_n < 1:
        raise ValueError("top_n must be at least 1.")
    level = F.when(F.col("confidence") == "high", 2).when(
        F.col("confidence") == "medium", 1).otherwise(0)
    kept = rows.where(level >= {"low": 0, "medium": 1, "high": 2}[minimum])
    return rank_rows(kept, group, [F.col("rank").asc()], "_place").where(
        F.col("_place") <= top_n).drop("_place")


def labels(metric: Column) -> Column:
    out = F.lit("—")
    for key, label in METRIC_LABELS.items():
        out = F.when(metric == key, label).otherwise(out)
    return out
