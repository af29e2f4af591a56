"""Area questions: summaries, metrics, scores, and the full recommendation."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.config import METRIC_KEYS, METRIC_LABELS, PRESETS, ScoringConfig
from footmark.functions import dates
from footmark.functions.dates import Span
from footmark.functions.geo import haversine_km
from footmark.operators import activity as act
from footmark.operators import site_tables as out
from footmark.operators import sites, spatial, uncertainty
from footmark.plans.activity import BETWEEN, COVERED_MONTHS
from footmark.plans.domain import (
    CO_TAG, COVERAGE, RADIUS_KM, SCOPE, activity, businesses, sql, station_reports, table, tidy,
)
from footmark.session import checkpointed, scratch_path
from footmark.sources import files

CONFIG = ScoringConfig(high_min_checkins=40, low_checkins=10)  # the tables are thin
REQUEST = Span(date(1997, 1, 15), date(2001, 6, 30))
COVERED = REQUEST.intersect(COVERAGE)
MONTHS = dates.full_months(COVERED)
NICHE = ["parent"]


@dataclass
class Assembled:
    """The tables of one assembly; all of them are keyed by scope and area."""

    businesses: DataFrame
    activity: DataFrame
    inputs: DataFrame
    centres: DataFrame
    rivals: DataFrame
    rates: DataFrame
    trends: DataFrame
    effects: DataFrame

    def metrics(self, model: DataFrame | None = None) -> DataFrame:
        return sites.area_metrics(
            self.inputs, self.rates, self.centres.select("area_id", "latitude").distinct(),
            self.rivals, self.trends, self.effects, NICHE, COVERED.days, CONFIG, model)


def centres(spark, sf) -> DataFrame:
    return spatial.area_centres(businesses(spark, sf), ["area_id"])


def assemble(spark, sf) -> Assembled:
    b = businesses(spark, sf).withColumn("in_niche", act.has_tag(CO_TAG))
    # One count per business and day serves the totals, the months, the weather effects and the draws.
    a = checkpointed(activity(spark, sf, COVERED).groupBy("business_id", "day").agg(F.sum("n").alias("n")))
    inputs = checkpointed(sites.area_inputs(b, a, NICHE, COVERED))  # one row per area
    placed = inputs.select(*NICHE, "area_id").join(centres(spark, sf), "area_id")
    rivals = checkpointed(sites.competitors(b, placed, NICHE, RADIUS_KM))
    return Assembled(
        b, a, inputs, placed, rivals, sites.metro_rate(inputs, NICHE, COVERED.days),
        sites.trend(a, b, NICHE, COVERED, CONFIG),
        sites.weather_effects(station_reports(spark, sf, COVERED), a, b, NICHE, COVERED, CONFIG))


METRIC_COLUMNS = [
    "parent", "area_id", "postal_code", "members", "open_members", "niche_checkins", "parents",
    "parent_checkins", "raw_demand_rate", *METRIC_KEYS, "mean_stars", "rain_effect", "heat_effect",
    "observed_days", "wet_days", "dry_days", "hot_days", "demand_source", "confidence",
]


def area_summaries(spark, sf):
    """Area summary per scope with year over year inside the covered window."""
    span, back = COVERED_MONTHS, COVERED_MONTHS.previous_year()
    day = F.col("day")
    b = businesses(spark, sf)
    counts = act.by_area_hour(activity(spark, sf), b, SCOPE, span, True).groupBy(
        *SCOPE, "area_id").agg(
        F.sum(F.when(span.holds(day), F.col("checkins")).otherwise(0)).alias("current"),
        F.sum(F.when(back.holds(day), F.col("checkins")).otherwise(0)).alias("previous"))
    return tidy(spatial.area_summaries(
        b, counts, centres(spark, sf), SCOPE, span, COVERAGE, RADIUS_KM, 5))


def area_centres(spark, sf):
    rows = centres(spark, sf).join(businesses(spark, sf).where("area_id IS NOT NULL").select(
        "area_id", "metro", "postal_code").distinct(), "area_id")
    return tidy(rows.withColumn("display_name", spatial.area_name("metro", "postal_code")))


def radius_counts(spark, sf):
    """Listings within the radius of every area centre, whatever their tags."""
    b = businesses(spark, sf)
    rows = spatial.within_radius(centres(spark, sf), b, ["area_id"], [], RADIUS_KM)
    return tidy(rows.withColumnRenamed("n", "nearby"))


def centre_distances(spark, sf):
    """Distance of every listing to the centre of its area."""
    c = centres(spark, sf).select("area_id", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    rows = businesses(spark, sf).join(c, "area_id").where(F.col("latitude").isNotNull())
    return tidy(rows.select("business_id", haversine_km(
        F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude")).alias("km")))


def competitor_gaps(spark, sf):
    a = assemble(spark, sf)
    return tidy(sites.competition(a.rivals, NICHE))


def site_metrics(spark, sf):
    """Metrics with the metro mean as model rate (estimator off)."""
    return tidy(assemble(spark, sf).metrics().select(*METRIC_COLUMNS, F.array_join(
        "unavailable", ";").alias("unavailable")))


def weather_effects(spark, sf):
    return tidy(assemble(spark, sf).effects)


def metric_percentiles(spark, sf):
    m = checkpointed(assemble(spark, sf).metrics())
    rows = sites.percentiles(sites.metric_rows(m, [*NICHE, "area_id"]), NICHE)
    return tidy(rows.select("parent", "area_id", "metric", "p"))


def site_scores(spark, sf):
    rows = sites.score_areas(checkpointed(assemble(spark, sf).metrics()), NICHE, CONFIG)
    return tidy(rows.select("parent", "preset", "area_id", "rank", "score", "key_strength",
                            "key_risk", F.array_join("top_factors", ";").alias("top_factors"),
                            "equal_weight_fallback"))


def score_factors(spark, sf):
    rows = sites.score_areas(checkpointed(assemble(spark, sf).metrics()), NICHE, CONFIG)
    return tidy(rows.select("parent", "preset", "area_id", F.inline("factors")).select(
        "parent", "preset", "area_id", "metric", "effective_weight", "contribution", "delta"))


def confident_scores(spark, sf):
    m = checkpointed(assemble(spark, sf).metrics())
    rows = sites.score_areas(m, NICHE, CONFIG).join(
        m.select("parent", "area_id", "confidence"), ["parent", "area_id"])
    kept = sites.keep_confident(rows, [*NICHE, "preset"], "medium", 3)
    return tidy(kept.select("parent", "preset", "area_id", "rank", "confidence"))


def unscored(spark, sf):
    """Scope areas without a (well reviewed) parent business, with the reason."""
    b = businesses(spark, sf).where(F.col("area_id").isNotNull())
    areas = b.select(*NICHE, "area_id").distinct()
    return tidy(sites.unscored_areas(areas, b.where(F.col("review_count") > 450), NICHE))


def demand_model(spark, sf):
    """The estimator's rows, its sums and penalties, its report, and what they were made of."""
    a = assemble(spark, sf)
    rows = checkpointed(
        uncertainty.estimator_rows(a.inputs, a.rivals, NICHE, COVERED.days, CONFIG))
    state = checkpointed(uncertainty.ridge_state(rows, NICHE, CONFIG))
    folds = uncertainty.leave_one_out(rows, NICHE, CONFIG, state)
    return rows, state, checkpointed(uncertainty.estimator_report(rows, folds, NICHE)), a


def estimator_report(spark, sf):
    return tidy(demand_model(spark, sf)[2])


def recommend(spark, sf) -> DataFrame:
    """Everything at once: estimator, metrics, draws, scores, intervals and ties."""
    rows, state, report, a = demand_model(spark, sf)
    model = uncertainty.model_rates(rows, report, a.rates, NICHE, CONFIG, state)
    seed = sites.scope_seed(
        F.lit("all"), F.lit(""), F.col("parent"), F.lit(CO_TAG), F.lit(str(REQUEST.start)),
        F.lit(str(REQUEST.end)), F.lit(f"{RADIUS_KM:.3f}"), F.lit("r1"))
    metrics = checkpointed(a.metrics(model).withColumn("seed", seed))
    months = [f"m{i}" for i in range(len(MONTHS))]
    niche = a.businesses.where(F.col("in_niche") & F.col("area_id").isNotNull())
    monthly = a.activity.where(COVERED.holds(F.col("day"))).groupBy("business_id").agg(
        F.sum("n").alias("checkins"), *[
            F.sum(F.when(F.trunc("day", "month") == F.lit(m), F.col("n")).otherwise(0)).alias(name)
            for name, m in zip(months, MONTHS)])
    members = niche.select("business_id", *NICHE, "area_id").join(
        monthly, "business_id", "left").na.fill(0, ["checkins", *months]).withColumn("seed", seed)
    draws = checkpointed(uncertainty.draw_metrics(
        metrics, members, a.rivals.withColumn("seed", seed), NICHE, COVERED.days, months, CONFIG))
    points = sites.score_areas(metrics, NICHE, CONFIG)
    weights = PRESETS["Balanced"]
    drawn = uncertainty.draw_scores(draws, NICHE, F.array(*map(F.lit, weights)))
    ranked = uncertainty.intervals(
        points.where(F.col("preset") == "Balanced"), drawn, NICHE, CONFIG)
    return ranked.join(metrics.drop("postal_code"), [*NICHE, "area_id"]).withColumn(
        "display_name", F.concat(F.lit("ZIP "), "postal_code"))


def recommendation(spark, sf):
    return tidy(recommend(spark, sf).select(
        "parent", "area_id", "rank", "rank_low", "rank_high", "tied_with_above", "score",
        "score_low", "score_high", "confidence", "demand_source"))


def recommendation_table(spark, sf):
    return tidy(out.ranked_table(recommend(spark, sf), NICHE))


def recommendation_details(spark, sf):
    return tidy(out.metric_table(recommend(spark, sf), NICHE, RADIUS_KM, len(MONTHS), CONFIG))


def recommendation_compare(spark, sf):
    return tidy(out.compare_table(recommend(spark, sf), NICHE))


def recommendation_csv(spark, sf):
    """The 24-column CSV, written and read back."""
    rows = out.csv_rows(recommend(spark, sf), NICHE)
    path = scratch_path(spark, "scores")
    rows.write.partitionBy(*NICHE).option("header", True).option("emptyValue", "").csv(path)
    return files.csv_with(spark, path, ["rank", "notes"])


def recommendation_facts(spark, sf):
    return tidy(out.facts(recommend(spark, sf), NICHE))


def recommendation_warnings(spark, sf):
    return tidy(out.warnings(recommend(spark, sf), NICHE, COVERED.days, REQUEST.days, CONFIG))


def coverage_header(spark, sf):
    m = assemble(spark, sf).metrics()
    return tidy(out.coverage_header(
        m, unscored(spark, sf), NICHE, REQUEST, COVERED, len(MONTHS)))


def clean_questions(spark, sf):
    """Text clean-up over every conversation turn."""
    rows = table(spark, sf, "conversations")
    return tidy(rows.select("conv_id", "turn", "role", out.clean_question(F.col("text")).alias("q")).withColumn(
        "q_length", F.length("q")))


QUERIES = {
    "area_summaries": area_summaries,
    "area_centres": area_centres,
    "area_radius_counts": radius_counts,
    "area_centre_distances": centre_distances,
    "site_competition": competitor_gaps,
    "site_weather_effects": weather_effects,
    "site_metrics": site_metrics,
    "site_percentiles": metric_percentiles,
    "site_scores": site_scores,
    "site_factors": score_factors,
    "site_confident": confident_scores,
    "site_unscored": unscored,
    "site_coverage_header": coverage_header,
    "site_estimator_report": estimator_report,
    "site_recommendation": recommendation,
    "site_ranked_table": recommendation_table,
    "site_metric_table": recommendation_details,
    "site_compare_table": recommendation_compare,
    "site_csv": recommendation_csv,
    "site_facts": recommendation_facts,
    "site_warnings": recommendation_warnings,
    "text_clean_questions": clean_questions,
}

_HAVERSINE = """2e0 * 63710088e-4 * asin(sqrt(least(1e0, greatest(0e0,
  sin(radians({b} - {a}) / 2e0) * sin(radians({b} - {a}) / 2e0) + cos(radians({a}))
  * cos(radians({b})) * sin(radians({d} - {c}) / 2e0) * sin(radians({d} - {c}) / 2e0)))))"""
_KM = _HAVERSINE.format(a="c.latitude", b="b.latitude", c="c.longitude", d="b.longitude")
_CENTRES = """centre AS (SELECT area_id, avg(latitude) AS latitude, avg(longitude) AS longitude
  FROM business WHERE area_id IS NOT NULL GROUP BY 1)"""
_A, _Z = COVERED.start, COVERED.end
_M0, _M1 = MONTHS[0], MONTHS[-1]
_LAST12, _PRIOR12 = MONTHS[-12], MONTHS[-24]
_SITE = _CENTRES + f""",
niche AS (SELECT *, list_contains(categories, '{CO_TAG}') AS in_niche FROM business),
tot AS (SELECT business_id, sum(n) AS c FROM activity WHERE day BETWEEN DATE '{_A}'
  AND DATE '{_Z}' GROUP BY 1),
inp AS (SELECT parent, area_id, postal_code, count(*) AS parents,
  CAST(coalesce(sum(c), 0) AS BIGINT) AS parent_checkins, avg(stars) AS parent_stars,
  avg(review_count) AS parent_reviews, count(*) FILTER (in_niche) AS members,
  count(*) FILTER (in_niche AND is_open) AS open_members,
  CAST(coalesce(sum(c) FILTER (in_niche), 0) AS BIGINT) AS niche_checkins
  FROM niche LEFT JOIN tot USING (business_id) WHERE area_id IS NOT NULL GROUP BY ALL),
rate AS (SELECT parent, sum(niche_checkins) * 1e0 / (sum(members) * {COVERED.days}) AS metro_rate
  FROM inp GROUP BY 1),
comp AS (SELECT i.parent, i.area_id, count(*) AS rivals,
  sum(ln(1 + review_count) * stars) AS ws, sum(ln(1 + review_count)) FILTER (stars IS NOT NULL) AS w,
  avg(stars) AS plain
  FROM inp i JOIN centre c USING (area_id) JOIN niche b ON b.parent = i.parent AND b.in_niche
    AND b.is_open AND b.latitude IS NOT NULL AND {_KM} <= {RADIUS_KM:.0f} GROUP BY ALL),
gap AS (SELECT parent, area_id, rivals, CASE WHEN w > 0 THEN ws / w ELSE plain END AS mean_stars
  FROM comp),
mon AS (SELECT parent, area_id, CAST(date_trunc('month', day) AS DATE) AS m, sum(n) AS v
  FROM activity JOIN niche USING (business_id) WHERE in_niche AND area_id IS NOT NULL
  AND day BETWEEN DATE '{_M0}' AND last_day(DATE '{_M1}') GROUP BY ALL),
trend AS (SELECT parent, area_id,
  coalesce(sum(v) FILTER (m >= DATE '{_LAST12}'), 0) AS c1,
  coalesce(sum(v) FILTER (m >= DATE '{_PRIOR12}' AND m < DATE '{_LAST12}'), 0) AS c0,
  count(*) AS active, sum(v) * 1e0 / {len(MONTHS)} AS mean,
  sqrt(greatest(0e0, sum(v * v) * 1e0 / {len(MONTHS)} - (sum(v) * 1e0 / {len(MONTHS)}) ^ 2)) AS sd
  FROM mon GROUP BY ALL),
dom AS (SELECT parent, area_id, arg_min(station_id, (-n, station_id)) AS station_id FROM (
  SELECT parent, area_id, station_id, count(*) AS n FROM niche WHERE in_niche
  AND area_id IS NOT NULL AND station_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
obs AS (SELECT station_id, day, max(value) FILTER (variable = 'tmax') AS tmax,
  max(value) FILTER (variable = 'pcpn') AS pcpn FROM accepted WHERE variable <> 'tmin'
  AND day BETWEEN DATE '{_A}' AND DATE '{_Z}' GROUP BY ALL),
aday AS (SELECT parent, area_id, day, sum(n) AS v FROM activity JOIN niche USING (business_id)
  WHERE in_niche AND area_id IS NOT NULL GROUP BY ALL),
wday AS (SELECT parent, area_id, station_id, day, tmax, pcpn, coalesce(v, 0) AS v
  FROM dom JOIN obs USING (station_id) LEFT JOIN aday USING (parent, area_id, day)),
gate AS (SELECT parent, area_id, station_id, count(*) AS observed_days,
  count(*) FILTER (pcpn >= 25e-1) AS wet_days, count(*) FILTER (pcpn < 25e-1) AS dry_days,
  count(*) FILTER (tmax >= 32e0) AS hot_days, count(*) FILTER (tmax < 32e0) AS nonhot_days
  FROM wday GROUP BY ALL),
stratum AS (SELECT parent, area_id, month(day) AS mo,
  count(*) FILTER (pcpn >= 25e-1) AS ra, count(*) FILTER (pcpn < 25e-1) AS rb,
  sum(v) FILTER (pcpn >= 25e-1) AS rsa, sum(v) FILTER (pcpn < 25e-1) AS rsb,
  count(*) FILTER (tmax >= 32e0) AS ha, count(*) FILTER (tmax < 32e0) AS hb,
  sum(v) FILTER (tmax >= 32e0) AS hsa, sum(v) FILTER (tmax < 32e0) AS hsb
  FROM wday GROUP BY ALL),
eff AS (SELECT parent, area_id,
  sum(ra * (rsa * 1e0 / ra - rsb * 1e0 / rb) / (rsb * 1e0 / rb)) FILTER (ra >= 3 AND rb >= 3
    AND rsb > 0) / sum(ra) FILTER (ra >= 3 AND rb >= 3 AND rsb > 0) AS rain,
  sum(ha * (hsa * 1e0 / ha - hsb * 1e0 / hb) / (hsb * 1e0 / hb)) FILTER (ha >= 3 AND hb >= 3
    AND hsb > 0) / sum(ha) FILTER (ha >= 3 AND hb >= 3 AND hsb > 0) AS heat
  FROM stratum GROUP BY ALL),
effect AS (SELECT *, CASE WHEN rain_effect IS NOT NULL AND heat_effect IS NOT NULL THEN
    1 - least(1e0, (abs(rain_effect) + abs(heat_effect)) / 2) END AS weather_resilience FROM (
  SELECT gate.*, CASE WHEN wet_days >= 20 AND dry_days >= 20 THEN rain END AS rain_effect,
    CASE WHEN hot_days >= 20 THEN heat END AS heat_effect FROM gate JOIN eff USING (parent, area_id))),
base AS (SELECT inp.*, metro_rate, mean_stars, rain_effect, heat_effect, weather_resilience,
  coalesce(observed_days, 0) AS observed_days, wet_days, dry_days, hot_days,
  CASE WHEN members > 0 THEN niche_checkins * 1e0 / (members * {COVERED.days}) END
    AS raw_demand_rate,
  (niche_checkins * 1e0 / {COVERED.days} + 3 * metro_rate) / (members + 3) AS shrunk,
  CAST(coalesce(rivals, 0) AS DOUBLE) AS competition, 5 - mean_stars AS quality_gap,
  CASE WHEN c1 + c0 > 0 THEN (c1 - c0) * 1e0 / (c1 + c0) END AS momentum,
  CASE WHEN active >= 12 AND mean > 0 THEN 1 - least(1e0, sd / mean) END AS stability,
  CASE WHEN members >= 3 THEN 'observed' WHEN members = 0 THEN 'model' ELSE 'blended' END
    AS demand_source
  FROM inp JOIN rate USING (parent) LEFT JOIN gap USING (parent, area_id)
  LEFT JOIN trend USING (parent, area_id) LEFT JOIN effect USING (parent, area_id)),
/* modelled */ modelled AS (SELECT *, metro_rate AS model_rate, true AS model_fallback FROM base),
met AS (SELECT *, greatest(0e0, CASE WHEN members >= 3 THEN shrunk
    ELSE members / 3e0 * shrunk + (1 - members / 3e0) * model_rate END) AS demand_rate,
  CASE WHEN members >= 5 AND niche_checkins >= 40 THEN 'high'
    WHEN members < 2 OR niche_checkins < 10 OR demand_source = 'model' THEN 'low'
    ELSE 'medium' END AS confidence FROM modelled),
long AS (SELECT parent, area_id, postal_code, metric, position, round(value, 12) AS value FROM (
  """ + " UNION ALL ".join(
    f"SELECT parent, area_id, postal_code, '{m}' AS metric, {i} AS position, {m} AS value FROM met"
    for i, m in enumerate(METRIC_KEYS)) + """)),
ranked AS (SELECT *, count(value) OVER (PARTITION BY parent, metric) AS cnt,
  rank() OVER (PARTITION BY parent, metric ORDER BY value NULLS LAST) AS lo,
  count(*) OVER (PARTITION BY parent, metric, value) AS eq FROM long),
pct AS (SELECT parent, area_id, postal_code, metric, position, CASE WHEN value IS NULL THEN NULL
    WHEN metric = 'competition' THEN 1 - p0 ELSE p0 END AS p FROM (SELECT *,
    CASE WHEN cnt > 1 THEN (lo + (eq - 1) / 2e0 - 1) / (cnt - 1) ELSE 5e-1 END AS p0 FROM ranked)),
preset AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{n}', {i}, {int(round(w * 100))}e-2)"
    for n, ws in PRESETS.items() for i, w in enumerate(ws)) + """) AS t(preset, position, w)),
fac AS (SELECT parent, area_id, postal_code, preset, metric, position,
  CASE WHEN p IS NULL THEN 0e0 ELSE w / sum(w) FILTER (p IS NOT NULL) OVER (
    PARTITION BY parent, area_id, preset) END AS effective_weight, p
  FROM pct JOIN preset USING (position)),
factor AS (SELECT *, coalesce(100 * effective_weight * p, 0e0) AS contribution,
  coalesce(100 * effective_weight * (p - 5e-1), 0e0) AS delta FROM fac),
total AS (SELECT parent, preset, area_id, postal_code,
  least(1e2, greatest(0e0, sum(contribution))) AS score,
  list(metric ORDER BY round(abs(delta), 9) DESC, position) FILTER (p IS NOT NULL) AS byabs,
  list(metric ORDER BY round(delta, 9) DESC, position) FILTER (p IS NOT NULL) AS best,
  list(metric ORDER BY round(delta, 9), position) FILTER (p IS NOT NULL) AS worst
  FROM factor GROUP BY ALL),
place AS (SELECT *, row_number() OVER (PARTITION BY parent, preset
  ORDER BY round(score, 9) DESC, postal_code) AS rank FROM total)"""


def _inverse_sql() -> dict[str, str]:
    """The inverse of a symmetric 4 x 4 matrix a00..a33 by cofactors, as SQL: b00..b33 over ``det``."""
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"

    def minor(i: int, j: int) -> str:
        rows, columns = [r for r in range(4) if r != i], [c for c in range(4) if c != j]
        terms = []
        for sign, (p, q, r) in (("+", (0, 1, 2)), ("+", (1, 2, 0)), ("+", (2, 0, 1)), ("-", (2, 1, 0)), ("-", (1, 0, 2)), ("-", (0, 2, 1))):
            terms.append(sign + "*".join(a(rows[k], columns[x]) for k, x in enumerate((p, q, r))))
        return "(" + " ".join(terms) + ")"

    cofactors = {f"{i}{j}": ("" if (i + j) % 2 == 0 else "-") + minor(i, j) for i in range(4) for j in range(i, 4)}
    cofactors["det"] = "(" + " + ".join(f"{a(0, j)} * ({'-' if j % 2 else ''}{minor(0, j)})" for j in range(4)) + ")"
    return cofactors


def _estimator_sql() -> str:
    """Every fold refitted from its own rows (``held`` is the area left out, -1 none), as the definition says."""
    features = range(4)
    pairs = [(i, j) for i in features for j in features if i <= j]
    cofactors = _inverse_sql()
    lambda_ = ", ".join(f"{c}{' + alpha' if c[1] == c[2] else ''} AS {c}" for c in (f"a{i}{j}" for i, j in pairs))
    inverse = ", ".join(f"{text} / {cofactors['det']} AS b{name}" for name, text in cofactors.items() if name != "det")
    b = lambda i, j: f"b{min(i, j)}{max(i, j)}"
    coefficients = ", ".join(" + ".join(f"{b(i, j)} * c{j}" for j in features) + f" AS t{i}" for i in features)
    leverage = " + ".join(f"z{i} * z{j} * {b(i, j)}" for i in features for j in features)
    guess = lambda x: "centre + " + " + ".join(
        f"t{i} * (" + (f"coalesce({x}.f1, fill)" if i == 1 else f"{x}.f{i}") + f" - m{i}) / s{i}" for i in features)
    return f"""
feat AS (SELECT parent, area_id, ln(1 + parents) AS f0, parent_stars AS f1, ln(1 + parent_reviews) AS f2,
  ln(1 + coalesce(rivals, 0)) AS f3, CASE WHEN members >= 3 THEN ln(1 + 1e3 * niche_checkins / (members * {COVERED.days})) END AS y
  FROM inp LEFT JOIN gap USING (parent, area_id)),
tr AS (SELECT *, count(*) OVER (PARTITION BY parent) AS n_train FROM feat WHERE y IS NOT NULL),
fold AS (SELECT a.parent, a.area_id AS held, b.area_id, b.f0, b.f1, b.f2, b.f3, b.y FROM tr a JOIN tr b
    ON a.parent = b.parent AND a.area_id <> b.area_id WHERE a.n_train >= 8
  UNION ALL SELECT parent, -1, area_id, f0, f1, f2, f3, y FROM tr WHERE n_train >= 8),
filled AS (SELECT * REPLACE (coalesce(f1, fill) AS f1) FROM (SELECT *, coalesce(avg(f1) OVER w, 0) AS fill,
  avg(y) OVER w AS centre, count(*) OVER w AS n FROM fold WINDOW w AS (PARTITION BY parent, held))),
mom AS (SELECT parent, held, any_value(fill) AS fill, any_value(centre) AS centre, any_value(n) AS n,
  {', '.join(f"avg(f{i}) AS m{i}, CASE WHEN stddev_pop(f{i}) > 1e-6 THEN stddev_pop(f{i}) ELSE 1 END AS s{i}" for i in features)}
  FROM filled GROUP BY ALL),
z AS (SELECT f.parent, f.held, f.area_id, f.y - f.centre AS y, f.n, {', '.join(f"(f{i} - m{i}) / s{i} AS z{i}" for i in features)}
  FROM filled f JOIN mom USING (parent, held)),
gram AS (SELECT parent, held, {', '.join(f"sum(z{i} * z{j}) AS a{i}{j}" for i, j in pairs)},
  {', '.join(f"sum(z{i} * y) AS c{i}" for i in features)} FROM z GROUP BY ALL),
lam AS (SELECT * REPLACE ({lambda_}) FROM gram, (SELECT unnest([{', '.join(str(x) + 'e0' for x in CONFIG.ridge_alphas)}]) AS alpha)),
inv AS (SELECT parent, held, alpha, c0, c1, c2, c3, {inverse} FROM lam),
coef AS (SELECT *, {coefficients} FROM inv),
chosen AS (SELECT parent, arg_min(alpha, (err, alpha)) AS alpha FROM (SELECT parent, alpha,
  round(avg(((y - ({' + '.join(f't{i} * z{i}' for i in features)})) / (1 - ({leverage} + 1e0 / n))) ^ 2), 12) AS err
  FROM z JOIN coef USING (parent, held) WHERE held = -1 GROUP BY ALL) GROUP BY parent),
fit AS (SELECT * FROM coef JOIN chosen USING (parent, alpha) JOIN mom USING (parent, held)),
res AS (SELECT t.parent, t.area_id, t.y - ({guess('t')}) AS residual, t.y - centre AS baseline
  FROM tr t JOIN fit f ON t.parent = f.parent AND t.area_id = f.held),
cv AS (SELECT parent, avg(abs(residual)) AS mae_model, avg(abs(baseline)) AS mae_baseline,
  stddev_samp(residual) AS residual_sd FROM res GROUP BY parent),
verdicts AS (SELECT *, CASE WHEN skill IS NULL THEN 'insufficient_training_areas' WHEN skill <= 1e-9 THEN 'no_skill'
    ELSE 'ok' END AS reason FROM (SELECT *, CASE WHEN mae_baseline < 1e-12 THEN 0e0 ELSE 1 - mae_model / mae_baseline END AS skill
  FROM (SELECT parent, count(y) AS n_train FROM feat GROUP BY parent) LEFT JOIN cv USING (parent))),
est AS (SELECT a.parent, a.area_id, residual_sd, greatest(0e0, (exp({guess('a')}) - 1) / 1e3) AS est
  FROM feat a JOIN fit f ON a.parent = f.parent AND f.held = -1 JOIN verdicts r ON a.parent = r.parent WHERE reason = 'ok'),
modelled AS (SELECT base.*, coalesce(est, metro_rate) AS model_rate, est IS NULL AS model_fallback, residual_sd
  FROM base LEFT JOIN est USING (parent, area_id)),"""


def _draws_sql() -> str:
    """All draws replayed from their digests, then scores and ranks inside each draw."""
    number = lambda stream, block, i: (
        f"CAST('0x' || substr(md5(seed || ':' || area_id || ':{stream}:' || draw || ':' || ({block})), 8 * ({i}) + 1, 8) AS BIGINT)")
    unit = lambda i: f"(({number(2, '0', i)}) + 5e-1) / 4294967296e0"
    n, w = len(MONTHS), PRESETS["Balanced"]
    return f"""
seeded AS (SELECT parent, CAST('0x' || substr(sha256('all||' || parent || '|{CO_TAG}|{REQUEST.start}|{REQUEST.end}|{RADIUS_KM:.3f}|r1'),
  9, 8) AS BIGINT) AS seed FROM (SELECT DISTINCT parent FROM inp)),
draw AS (SELECT unnest(range({CONFIG.n_bootstrap})) AS draw),
member AS (SELECT business_id, parent, area_id, row_number() OVER (PARTITION BY parent, area_id ORDER BY business_id) - 1 AS slot,
  count(*) OVER (PARTITION BY parent, area_id) AS n FROM niche WHERE in_niche AND area_id IS NOT NULL),
picked AS (SELECT parent, area_id, draw, business_id, count(*) AS k FROM (SELECT parent, area_id, draw,
    ({number(0, 'slot // 4', 'slot % 4')} * n) >> 32 AS slot FROM member JOIN seeded USING (parent), draw)
  JOIN member USING (parent, area_id, slot) GROUP BY ALL),
dtot AS (SELECT parent, area_id, draw, sum(k * c) AS c FROM picked JOIN tot USING (business_id) GROUP BY ALL),
bmon AS (SELECT business_id, CAST(date_trunc('month', day) AS DATE) AS m, sum(n) AS v FROM activity
  WHERE day BETWEEN DATE '{_M0}' AND last_day(DATE '{_M1}') GROUP BY ALL),
dtrend AS (SELECT parent, area_id, draw, coalesce(sum(v) FILTER (m >= DATE '{_LAST12}'), 0) AS c1,
    coalesce(sum(v) FILTER (m >= DATE '{_PRIOR12}' AND m < DATE '{_LAST12}'), 0) AS c0, count(*) AS active, sum(v) * 1e0 / {n} AS mean,
    sqrt(greatest(0e0, sum(v * v) * 1e0 / {n} - (sum(v) * 1e0 / {n}) ^ 2)) AS sd FROM (
  SELECT parent, area_id, draw, m, sum(k * v) AS v FROM picked JOIN bmon USING (business_id) GROUP BY ALL) GROUP BY ALL),
rival AS (SELECT i.parent, i.area_id, stars, ln(1 + review_count) AS lw,
  row_number() OVER (PARTITION BY i.parent, i.area_id ORDER BY stars NULLS FIRST, review_count NULLS FIRST) - 1 AS slot,
  count(*) OVER (PARTITION BY i.parent, i.area_id) AS n FROM inp i JOIN centre c USING (area_id)
  JOIN niche b ON b.parent = i.parent AND b.in_niche AND b.is_open AND b.latitude IS NOT NULL AND {_KM} <= {RADIUS_KM:.0f}),
dgap AS (SELECT parent, area_id, draw, 5 - CASE WHEN coalesce(sum(lw) FILTER (stars IS NOT NULL), 0) > 0
    THEN sum(lw * stars) / sum(lw) FILTER (stars IS NOT NULL) ELSE avg(stars) END AS gap FROM (SELECT parent, area_id, draw,
    ({number(1, 'slot // 4', 'slot % 4')} * n) >> 32 AS slot FROM rival JOIN seeded USING (parent), draw)
  JOIN rival USING (parent, area_id, slot) GROUP BY ALL),
dbase AS (SELECT *, (coalesce(c, 0) * 1e0 / {COVERED.days} + 3 * metro_rate) / (members + 3) AS dshrunk,
    CASE WHEN members < 3 AND NOT model_fallback AND residual_sd IS NOT NULL
      THEN greatest(0e0, (exp(ln(1 + 1e3 * model_rate) + residual_sd * sqrt(-2 * ln({unit(0)})) * cos(2 * pi() * {unit(1)})) - 1) / 1e3)
      ELSE model_rate END AS dmodel
  FROM met JOIN seeded USING (parent) CROSS JOIN draw LEFT JOIN dtot USING (parent, area_id, draw)
  LEFT JOIN dtrend USING (parent, area_id, draw) LEFT JOIN dgap USING (parent, area_id, draw)),
dmet AS (SELECT parent, area_id, draw, greatest(0e0, CASE WHEN members >= 3 THEN dshrunk
      ELSE members / 3e0 * dshrunk + (1 - members / 3e0) * dmodel END) AS demand_rate, competition,
    CASE WHEN quality_gap IS NOT NULL THEN gap END AS quality_gap,
    CASE WHEN c1 + c0 > 0 THEN (c1 - c0) * 1e0 / (c1 + c0) END AS momentum,
    CASE WHEN active >= 12 AND mean > 0 THEN 1 - least(1e0, sd / mean) END AS stability, weather_resilience FROM dbase),
dlong AS (""" + " UNION ALL ".join(
        f"SELECT parent, area_id, draw, {i} AS position, {w[i]}e0 AS w, round({m}, 12) AS value FROM dmet"
        for i, m in enumerate(METRIC_KEYS)) + """),
dpct AS (SELECT parent, area_id, draw, w, CASE WHEN value IS NULL THEN NULL WHEN position = 1 THEN 1 - p ELSE p END AS p FROM (
  SELECT *, CASE WHEN count(value) OVER g > 1 THEN (rank() OVER (g ORDER BY value NULLS LAST) - 1
    + (count(*) OVER (PARTITION BY parent, draw, position, value) - 1) / 2e0) / (count(value) OVER g - 1) ELSE 5e-1 END AS p
  FROM dlong WINDOW g AS (PARTITION BY parent, draw, position))),
dscore AS (SELECT parent, area_id, draw, round(least(1e2, greatest(0e0, 1e2 * CASE WHEN sum(w) FILTER (p IS NOT NULL) > 0
  THEN sum(w * p) / sum(w) FILTER (p IS NOT NULL) ELSE avg(p) END)), 9) AS score FROM dpct GROUP BY ALL),
drank AS (SELECT *, rank() OVER (PARTITION BY parent, draw ORDER BY score DESC) AS r FROM dscore),
bound AS (SELECT parent, area_id, quantile_cont(score, 5e-2) AS sl, quantile_cont(score, 95e-2) AS sh,
  list_sort(list(r))[1 + CAST(floor(round((count(*) - 1) * 5e-2, 9)) AS INTEGER)] AS rl,
  list_sort(list(r))[1 + CAST(ceil(round((count(*) - 1) * 95e-2, 9)) AS INTEGER)] AS rh FROM drank GROUP BY ALL),
rec AS (SELECT *, coalesce(rank_low <= lag(rank_high) OVER (PARTITION BY parent ORDER BY rank), false) AS tied_with_above FROM (
  SELECT p.parent, p.area_id, p.postal_code, p.rank, least(rl, rank) AS rank_low, greatest(rh, rank) AS rank_high, score,
    least(sl, score) AS score_low, greatest(sh, score) AS score_high, byabs, best, worst, m.* EXCLUDE (parent, area_id, postal_code)
  FROM place p JOIN bound USING (parent, area_id) JOIN met m USING (parent, area_id) WHERE preset = 'Balanced'))"""


def _fixed(value: str, digits: int) -> str:
    """So many decimals, half up on the shortest decimal form."""
    return (f"CAST(CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DECIMAL(38,{digits})) AS VARCHAR)")


def _signed(value: str) -> str:
    return f"CASE WHEN {value} < 0 THEN '-' ELSE '+' END || {_fixed(f'abs({value})', 0)} || '%'"


def _case(value: str, names: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in names.items()) + " END"


def _shown(metric: str, value: str) -> str:
    return f"""CASE WHEN {value} IS NULL THEN '{out.DASH}' WHEN {metric} = 'demand_rate' THEN {_fixed(f'{value} * 1e3', 2)}
  WHEN {metric} = 'competition' THEN CAST(CAST(round({value}) AS BIGINT) AS VARCHAR)
  WHEN {metric} = 'momentum' THEN {_signed(f'({value} * 1e2)')} ELSE {_fixed(value, 2)} END"""


_SHOWN_RANK = "CASE WHEN tied_with_above THEN rank_low || '–' || rank_high ELSE CAST(rank AS VARCHAR) END"
_RANGE = _fixed("score_low", 1) + " || '–' || " + _fixed("score_high", 1)
_FACTORS = """fac1 AS (SELECT f.parent, f.area_id, f.metric, f.position, f.effective_weight, f.p, f.contribution, f.delta, l.value,
  l.value IS NOT NULL AND f.p IS NOT NULL AS known FROM factor f JOIN long l USING (parent, area_id, metric) WHERE f.preset = 'Balanced')"""


def _remark_sql() -> str:
    """The remark of a row of fac1 joined to rec, from the table of remarks."""
    states = {f"{m}/{state}": text for (m, state), text in out.REMARKS.items()}
    shares = """array_to_string(list_filter([CASE WHEN rain_effect IS NOT NULL THEN 'rain ' || {r} END,
  CASE WHEN heat_effect IS NOT NULL THEN 'heat ' || {h} END], lambda x: x IS NOT NULL), ', ')""".format(
        r=_signed("(rain_effect * 1e2)"), h=_signed("(heat_effect * 1e2)"))
    short = len(MONTHS) < CONFIG.min_months_momentum
    filled = {"radius": f"'{RADIUS_KM:g}'", "stability_months": f"'{CONFIG.min_months_stability}'",
              "momentum": f"'needs {CONFIG.min_months_momentum} months'" if short else "'no activity in two years'",
              "fallback": "CASE WHEN model_fallback THEN ', the estimate being the metro''s mean' ELSE '' END",
              "effects": f"CASE WHEN rain_effect IS NULL AND heat_effect IS NULL THEN '' ELSE ': ' || {shares} END"}
    state = """metric || '/' || CASE WHEN NOT known THEN 'missing' WHEN metric <> 'demand_rate' THEN 'known'
  WHEN demand_source IN ('observed', 'blended') THEN demand_source ELSE 'estimated' END"""
    text = _case(f"({state})", states)
    for name, value in filled.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


def _compare_sql() -> str:
    lines = {
        "Score": _fixed("score", 1), "Score range": _RANGE, "Rank": _SHOWN_RANK, "Confidence": "confidence",
        "Demand source": "demand_source", "Businesses (niche)": "CAST(members AS VARCHAR)",
        **{label: _shown(f"'{m}'", m) for m, label in METRIC_LABELS.items()},
        "Top factors": f"array_to_string([{_case('x', METRIC_LABELS)} FOR x IN byabs[1:3]], ', ')"}
    rows = " UNION ALL ".join(f"SELECT parent, rank, {i} AS line, '{label}' AS label, {text} AS text FROM rec WHERE rank <= 5"
                              for i, (label, text) in enumerate(lines.items()))
    return "SELECT parent, line, label, " + ", ".join(
        f"max(text) FILTER (rank = {i}) AS rank_{i}" for i in range(1, 6)) + f" FROM ({rows}) GROUP BY ALL"


def _facts_sql() -> str:
    clean = lambda c, d: f"round({c}, {d}) + 0e0"
    factor = f"""{{'metric': metric, 'label': {_case('metric', METRIC_LABELS)},
  'display_value': CASE WHEN known THEN {_shown('metric', 'value')} END, 'unit': {_case('metric', out.UNITS)},
  'percentile': CASE WHEN known THEN {clean('p', 4)} END, 'contribution': {clean('contribution', 1)},
  'delta_vs_median': {clean('delta', 1)}, 'available': known}}"""
    missing = ", ".join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in METRIC_KEYS)
    return f"""SELECT parent, postal_code, rank, CAST(to_json({{'postal_code': postal_code, 'rank': rank,
  'rank_range': {{'best': rank_low, 'worst': rank_high}}, 'tied_with_above': tied_with_above, 'score': {clean('score', 1)},
  'score_range': [{clean('score_low', 1)}, {clean('score_high', 1)}], 'confidence': confidence, 'demand_source': demand_source,
  'niche_business_count': members, 'factors': factors, 'top_factors': byabs[1:3], 'key_strength': best[1], 'key_risk': worst[1],
  'unavailable_metrics': list_filter([{missing}], lambda x: x IS NOT NULL),
  'flags': list_filter([CASE WHEN model_fallback THEN 'model_fallback' END, CASE WHEN confidence = 'low' THEN 'low_confidence' END,
    CASE WHEN tied_with_above THEN 'tied_with_above' END], lambda x: x IS NOT NULL)}}) AS VARCHAR) AS facts
FROM rec JOIN (SELECT parent, area_id, list({factor} ORDER BY position) AS factors FROM fac1 GROUP BY ALL) USING (parent, area_id)"""


def _csv_sql() -> str:
    general = lambda c: f"CASE WHEN {c} IS NULL THEN '' ELSE printf('%.6g', {c}) END"
    missing = ", ".join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in METRIC_KEYS)
    numbers = ", ".join(f"{general(c)} AS {c}" for c in ("competition", "quality_gap", "momentum", "stability", "weather_resilience",
                                                         "rain_effect", "heat_effect"))
    return f"""SELECT CAST(rank AS VARCHAR) AS rank, CAST(rank_low AS VARCHAR) AS rank_low, CAST(rank_high AS VARCHAR) AS rank_high,
  CASE WHEN tied_with_above THEN 'True' ELSE 'False' END AS tied_with_above, postal_code, 'ZIP ' || postal_code AS display_name,
  {_fixed('score', 2)} AS score, {general('score_low')} AS score_low, {general('score_high')} AS score_high, confidence, demand_source,
  CAST(members AS VARCHAR) AS niche_business_count, {general('demand_rate * 1e3')} AS demand_rate_per_1000_business_days, {numbers},
  best[1] AS key_strength, worst[1] AS key_risk,
  array_to_string(list_filter([{missing}], lambda x: x IS NOT NULL), ';') AS unavailable_metrics,
  '{out.NOTE}' AS notes, parent FROM rec"""


def _warnings_sql() -> str:
    holds = {
        "few_areas": f"areas < {CONFIG.min_scored_areas}", "estimator_disabled": "all_fall_back",
        "short_coverage": str(COVERED.days < CONFIG.short_coverage_days), "partial_coverage": str(COVERED.days < REQUEST.days),
        "weather_sparse": "with_weather = 0", "equal_weight_fallback": "false"}
    rows = " UNION ALL ".join(
        "SELECT parent, {} AS position, '{}' AS code, replace(replace('{}', '{{areas}}', CAST(areas AS VARCHAR)), '{{covered}}', '{}') "
        "AS message FROM told WHERE {}".format(i, code, text.replace("'", "''"), COVERED.days, holds[code])
        for i, (code, text) in enumerate(out.WARNINGS.items()))
    return f"""SELECT * FROM (WITH told AS (SELECT parent, count(*) AS areas, bool_and(model_fallback) AS all_fall_back,
  count(weather_resilience) AS with_weather FROM rec GROUP BY parent) {rows})"""


_MODELLED = _SITE.index("/* modelled */"), _SITE.index("met AS (SELECT *, greatest")
_ESTIMATED = _SITE[:_MODELLED[0]] + _estimator_sql().lstrip() + _SITE[_MODELLED[1]:]
_RECOMMENDED = _ESTIMATED + "," + _draws_sql()
_MET_DOUBLES = "raw_demand_rate mean_stars rain_effect heat_effect " + " ".join(METRIC_KEYS)
_UNSCORED = """SELECT parent, area_id, 'no_parent_businesses' AS reason FROM business
  WHERE area_id IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (review_count > 450) = 0"""


def _site(body: str, doubles: str = "") -> str:
    return sql("business activity station", body, doubles, _SITE)


ORACLES = {
    "area_summaries": sql("business activity", f"""
SELECT m.metro, m.parent, m.area_id, businesses, coalesce(current, 0) AS checkins,
  coalesce(current, 0) * 7e0 / 387 AS weekly_checkins, mean_rating, rated_businesses,
  rated_reviews, coalesce(nearby, 0) AS nearby, weather_match_rate,
  CASE WHEN previous > 0 THEN ((current / 387e0) / (previous / 388e0) - 1) * 100 END AS yoy_percent
FROM (SELECT metro, parent, area_id, count(*) AS businesses, avg(stars) AS mean_rating,
    count(stars) AS rated_businesses,
    CAST(coalesce(sum(review_count) FILTER (stars IS NOT NULL), 0) AS BIGINT) AS rated_reviews,
    count(station_id) * 1e0 / count(*) AS weather_match_rate
  FROM business WHERE area_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) m
LEFT JOIN (SELECT metro, parent, area_id,
    CAST(coalesce(sum(n) FILTER (day BETWEEN {BETWEEN['months']}), 0) AS BIGINT) AS current,
    CAST(coalesce(sum(n) FILTER (day BETWEEN DATE '1999-03-10' AND DATE '2000-03-31'), 0)
      AS BIGINT) AS previous
  FROM activity JOIN business USING (business_id) GROUP BY ALL) a USING (metro, parent, area_id)
LEFT JOIN (SELECT m.metro, m.parent, m.area_id, count(*) AS nearby
  FROM (SELECT DISTINCT metro, parent, area_id FROM business WHERE area_id IS NOT NULL) m
  JOIN centre c ON c.area_id = m.area_id
  JOIN business b ON b.metro = m.metro AND b.parent = m.parent AND b.latitude IS NOT NULL
    AND {_KM} <= 3 GROUP BY ALL) x USING (metro, parent, area_id)""",
        "weekly_checkins mean_rating weather_match_rate yoy_percent", _CENTRES),
    "area_centres": sql("business", """SELECT area_id, latitude, longitude, metro, postal_code,
  'ZIP ' || postal_code AS display_name FROM centre JOIN (SELECT DISTINCT area_id, metro,
  postal_code FROM business WHERE area_id IS NOT NULL) USING (area_id)""",
        "latitude longitude", _CENTRES),
    "area_radius_counts": sql("business", f"""SELECT c.area_id, count(*) AS nearby FROM centre c
  JOIN business b ON b.latitude IS NOT NULL AND {_KM} <= 3 GROUP BY 1""", ctes=_CENTRES),
    "area_centre_distances": sql("business", f"""SELECT b.business_id, {_KM} AS km FROM business b
  JOIN centre c ON c.area_id = b.area_id WHERE b.latitude IS NOT NULL""", "km", _CENTRES),
    "site_competition": _site("SELECT * FROM gap", "mean_stars"),
    "site_weather_effects": _site("SELECT * FROM effect",
                                  "rain_effect heat_effect weather_resilience"),
    "site_metrics": _site(f"""SELECT {', '.join(METRIC_COLUMNS)}, array_to_string(list_filter([
  {', '.join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in METRIC_KEYS)}],
  lambda x: x IS NOT NULL), ';') AS unavailable FROM met""", _MET_DOUBLES),
    "site_percentiles": _site("SELECT parent, area_id, metric, p FROM pct", "p"),
    "site_scores": _site("""SELECT parent, preset, area_id, rank, score, best[1] AS key_strength,
  worst[1] AS key_risk, array_to_string(byabs[1:3], ';') AS top_factors,
  false AS equal_weight_fallback FROM place""", "score"),
    "site_factors": _site("""SELECT parent, preset, area_id, metric, effective_weight, contribution,
  delta FROM factor""", "effective_weight contribution delta"),
    "site_confident": _site("""SELECT parent, preset, area_id, rank, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY parent, preset ORDER BY rank) AS r FROM place
  JOIN (SELECT parent, area_id, confidence FROM met) USING (parent, area_id)
  WHERE confidence <> 'low') WHERE r <= 3"""),
    "site_unscored": sql("business", _UNSCORED),
    "site_coverage_header": _site(f"""SELECT parent, DATE '{REQUEST.start}' AS requested_start,
  DATE '{REQUEST.end}' AS requested_end, DATE '{_A}' AS covered_start, DATE '{_Z}' AS covered_end,
  {COVERED.days} AS covered_days, {len(MONTHS)} AS covered_months, count(*) AS areas_scored,
  any_value(coalesce(u, 0)) AS areas_unscored,
  count(*) FILTER (observed_days > 0) AS areas_with_weather FROM met
  LEFT JOIN (SELECT parent, count(*) AS u FROM ({_UNSCORED}) GROUP BY 1) USING (parent)
  GROUP BY parent"""),
    "site_estimator_report": sql("business activity station", """SELECT parent, n_train, mae_model, mae_baseline, residual_sd,
  skill, reason FROM verdicts""", "mae_model mae_baseline residual_sd skill", _ESTIMATED),
    "site_recommendation": sql("business activity station", """SELECT parent, area_id, rank, rank_low, rank_high,
  tied_with_above, score, score_low, score_high, confidence, demand_source FROM rec""", "score score_low score_high", _RECOMMENDED),
    "site_ranked_table": sql("business activity station", f"""SELECT parent, rank, {_SHOWN_RANK} AS shown_rank, postal_code,
  {_fixed('score', 1)} AS score, {_RANGE} AS score_range, confidence, demand_source,
  {_case('best[1]', METRIC_LABELS)} AS key_strength, {_case('worst[1]', METRIC_LABELS)} AS key_risk FROM rec""", "", _RECOMMENDED),
    "site_metric_table": sql("business activity station", f"""SELECT parent, rec.postal_code, position,
  {_case('metric', METRIC_LABELS)} AS metric_label, CASE WHEN known THEN {_shown('metric', 'value')} ELSE '{out.DASH}' END AS shown,
  CASE WHEN known THEN {_fixed('round(p, 9)', 2)} ELSE '{out.DASH}' END AS percentile,
  CASE WHEN known THEN {_fixed('round(effective_weight, 9)', 2)} ELSE '0.00' END AS weight,
  CASE WHEN known THEN {_fixed('round(contribution, 9)', 1)} ELSE '0.0' END AS contribution, {_remark_sql()} AS note
FROM fac1 JOIN rec USING (parent, area_id)""", "", _RECOMMENDED + "," + _FACTORS),
    "site_compare_table": sql("business activity station", _compare_sql(), "", _RECOMMENDED),
    "site_csv": sql("business activity station", _csv_sql(), "", _RECOMMENDED),
    "site_facts": sql("business activity station", _facts_sql(), "", _RECOMMENDED + "," + _FACTORS),
    "site_warnings": sql("business activity station", _warnings_sql(), "", _RECOMMENDED),
    "text_clean_questions": r"""SELECT conv_id, turn, role, CASE WHEN q <> '' THEN q END AS q,
  CASE WHEN q <> '' THEN length(q) END AS q_length FROM (
  SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(regexp_replace(
    text, '[\s\x{85}\x{1c}-\x{1f}]+', ' ', 'g'), '\p{C}', '', 'g'), ' +', ' ', 'g')) AS q
  FROM conversations)""",
}
