"""Weather and review questions over the whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from footmark.functions import weather_values as wv
from footmark.functions.dates import Span
from footmark.operators import activity as act
from footmark.operators import reviews as rev
from footmark.operators import weather as wx
from footmark.plans.activity import BETWEEN, COVERED_MONTHS
from footmark.plans.domain import (
    COVERAGE, MONTHS, SCOPE, WEATHER_COVERAGE, WEEKS, YEARS, activity, businesses, lcd_rows, registry,
    review_days, reviews, sql, station_reports, table, tidy,
)

HOURS = Span(date(2024, 1, 1), date(2024, 1, 30))


def _days(spark, sf, span=COVERED_MONTHS):
    return wx.station_days(station_reports(spark, sf, span), span)


def accepted_readings(spark, sf):
    return tidy(wx.accepted(station_reports(spark, sf)))


def station_days(spark, sf):
    return tidy(wx.station_days(station_reports(spark, sf)))


def complete_station_days(spark, sf):
    return tidy(wx.complete_days(wx.station_days(station_reports(spark, sf))))


def duplicate_readings(spark, sf):
    """Repeated readings when every line is a report, not one per key."""
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("station_id"),
        F.col("l_shipdate").cast("date").alias("day"), F.lit("tmax").alias("variable"),
        F.col("l_quantity").alias("value"), F.lit("degreeF").alias("unit"),
        F.lit("").alias("raw_value"), F.lit("").alias("flag"), F.lit(False).alias("is_trace"))
    return tidy(wx.duplicate_readings(li).select("station_id", "day", "count"))


def station_summary(spark, sf):
    return tidy(wx.station_summary(
        _days(spark, sf), wx.mapped_stations(businesses(spark, sf), []), COVERED_MONTHS))


def station_months(spark, sf):
    return tidy(wx.station_months(_days(spark, sf, MONTHS), MONTHS))


def mapped_stations(spark, sf):
    return tidy(wx.mapped_stations(businesses(spark, sf), SCOPE))


def box_station_months(spark, sf):
    samples = wx.long_samples(_days(spark, sf), ["station_id"])
    return tidy(wx.box_stats(samples, ["station_id"], COVERED_MONTHS))


def box_station_weeks_temperature(spark, sf):
    samples = wx.long_samples(_days(spark, sf, WEEKS), ["station_id"])
    return tidy(wx.box_stats(samples, ["station_id"], WEEKS, combine_temperature=True))


def box_pooled_years(spark, sf):
    samples = wx.pooled_samples(_days(spark, sf, YEARS), businesses(spark, sf), ["metro"])
    return tidy(wx.box_stats(samples, ["metro"], YEARS, pooled=True))


def box_hourly(spark, sf):
    hours = wx.latest_hourly(lcd_rows(spark, sf))
    samples = hours.select("station_id", F.to_date("observed_at").alias("day"),
                           F.lit("temperature").alias("series"),
                           F.col("temperature_c").alias("value"))
    return tidy(wx.box_stats(samples, ["station_id"], HOURS, hourly=True))


def box_display(spark, sf):
    samples = wx.long_samples(_days(spark, sf), ["station_id"])
    monthly = samples.withColumn("month", F.trunc("day", "month"))
    return tidy(wx.box_display_rows(monthly, ["station_id", "series", "month"]))


def pooled_samples(spark, sf, span=WEATHER_COVERAGE):
    rows = wx.pooled_samples(_days(spark, sf, span), businesses(spark, sf), ["metro"])
    return tidy(rows)


def pooled_samples_covered(spark, sf):
    return pooled_samples(spark, sf, WEATHER_COVERAGE)


def business_weather_days(spark, sf, span=COVERAGE):
    daily = act.business_days(activity(spark, sf, span), span)
    # Rounded once for a station and day, not for each of its businesses.
    rows = wx.business_weather_days(daily, businesses(spark, sf), tidy(_days(spark, sf, span)),
                                    span, COVERAGE)
    return tidy(rows.select("business_id", "day", "checkins", *wv.VARIABLES,
                            "weather_available"), rounded=wv.VARIABLES)


def business_weather_days_covered(spark, sf):
    return business_weather_days(spark, sf, COVERAGE)


def _bands(variable):
    def run(spark, sf):
        daily = act.business_days(activity(spark, sf, YEARS), YEARS)
        return tidy(wx.band_table(daily, businesses(spark, sf), _days(spark, sf, YEARS), YEARS,
                                  variable))
    return run


def correlation(spark, sf):
    daily = act.business_days(activity(spark, sf, YEARS), YEARS)
    return tidy(wx.correlation(daily, businesses(spark, sf), _days(spark, sf, YEARS), YEARS, "tmax"))


def _layer(spark, sf, measure):
    b = businesses(spark, sf)
    summary = wx.station_summary(_days(spark, sf), wx.mapped_stations(b, []), COVERED_MONTHS)
    return wx.business_layer(b, summary, measure, COVERED_MONTHS)


def business_layer(spark, sf):
    return tidy(_layer(spark, sf, "temp_max").select(
        "business_id", "station_id", "weather_value", "weather_days"))


def area_weather(spark, sf):
    return tidy(wx.area_weather(_layer(spark, sf, "precipitation"), [*SCOPE, "area_id"]))


def representative_station(spark, sf):
    return tidy(wx.dominant_station(businesses(spark, sf), ["metro"]))


def hourly_latest(spark, sf):
    return tidy(wx.latest_hourly(lcd_rows(spark, sf)))


def hourly_completed(spark, sf):
    """Hourly rows of one import's completed registry rows; a row's dataset is its source number."""
    rows = wx.latest_hourly(lcd_rows(spark, sf)).withColumn("dataset_id", F.col("source_code").cast("long"))
    done = wx.completed_hourly(rows, registry(spark, sf), "click")
    return tidy(done.select("station_id", "observed_at", "dataset_id", "temperature_c"))


def hourly_summary(spark, sf):
    return tidy(wx.hourly_summary(wx.latest_hourly(lcd_rows(spark, sf))))


def hourly_chart(spark, sf):
    rows = wx.latest_hourly(lcd_rows(spark, sf))
    return tidy(wx.hourly_chart_rows(rows, F.lit(-5), "temperature"))


def temperature_source(spark, sf, span=WEATHER_COVERAGE):
    """Hourly stations stand in for the first metros; the rest keep daily values."""
    hours = wx.latest_hourly(lcd_rows(spark, sf)).where(wv.finite(F.col("temperature_c"))).select(
        F.when(F.col("station_id") == "click", "ASIA").otherwise("EUROPE").alias("metro"),
        F.to_date("observed_at").alias("day"), F.col("temperature_c").alias("value"))
    daily = wx.pooled_samples(_days(spark, sf, span), businesses(spark, sf), ["metro"]).where(
        F.col("series") == "tmax").select("metro", "day", "value")
    rows = wx.choose_temperature(hours, daily, ["metro"])
    return tidy(rows.groupBy("metro", "frequency").agg(
        F.count(F.lit(1)).alias("readings"), F.avg("value").alias("mean")))


def temperature_source_covered(spark, sf):
    return temperature_source(spark, sf, WEATHER_COVERAGE)


def _completeness(keys):
    def run(spark, sf):
        rows = station_reports(spark, sf).withColumn("year", F.year("day"))
        return tidy(wx.completeness(rows, keys, WEATHER_COVERAGE))
    return run


def flag_counts(spark, sf):
    rows = station_reports(spark, sf).groupBy(
        "variable", F.when(F.trim("flag") == "", "(blank)").otherwise(F.upper(F.trim("flag")))
        .alias("flag_clean")).agg(F.count(F.lit(1)).alias("rows"))
    return tidy(rows)


def complete_months(spark, sf):
    return tidy(wx.complete_months(wx.station_days(station_reports(spark, sf))))


def long_run_seasonality(spark, sf):
    """Mean by month of year over station-months with at least half of their days usable."""
    months = wx.complete_months(wx.station_days(station_reports(spark, sf)), 0.5)
    return tidy(wx.long_run_seasonality(months, ["series"]))


def coherence_checks(spark, sf):
    """Native pair and sign checks per station."""
    pairs = station_reports(spark, sf).groupBy("station_id", "day").agg(
        F.max(F.when(F.col("variable") == "tmax", F.col("value"))).alias("tmax"),
        F.max(F.when(F.col("variable") == "tmin", F.col("value"))).alias("tmin"),
        F.max(F.when(F.col("variable") == "pcpn", F.col("value"))).alias("pcpn"))
    return tidy(pairs.groupBy("station_id").agg(
        F.count_if(F.col("tmax") < F.col("tmin")).alias("tmax_below_tmin"),
        F.count_if(F.col("pcpn") < 0).alias("negative_rain")))


def review_scope_history(spark, sf):
    return tidy(rev.scope_history(review_days(spark, sf), businesses(spark, sf), SCOPE, YEARS.end))


def review_business_days(spark, sf):
    return tidy(rev.daily_totals(reviews(spark, sf), ["business_id"]))


def _ratings(mode, span, keys):
    def run(spark, sf):
        history = review_days(spark, sf)
        if keys != ["business_id"]:
            history = rev.scope_history(history, businesses(spark, sf), keys, span.end)
        return tidy(rev.rating_periods(history, keys, span, COVERAGE, mode))
    return run


def observed_chart_rows(spark, sf):
    """Activity, weather and rating rows of every scope on shared calendar bins."""
    b = businesses(spark, sf)
    daily = act.scope_days(activity(spark, sf, MONTHS), b, ["metro"], MONTHS)
    bins = act.period_totals(daily, b, ["metro"], MONTHS, COVERAGE)
    recorded = bins.select("metro", "period", F.lit("Recorded check-ins").alias("series"),
                           F.col("checkins").cast("double").alias("value"))
    samples = wx.pooled_samples(_days(spark, sf, MONTHS), b, ["metro"])
    boxes = wx.box_stats(samples, ["metro"], MONTHS, pooled=True).select(
        "metro", "period", "series", F.col("median").alias("value"))
    history = rev.scope_history(review_days(spark, sf), b, ["metro"], MONTHS.end)
    ratings = rev.rating_periods(history, ["metro"], MONTHS, COVERAGE, "period").select(
        "metro", "period", F.lit("Rating").alias("series"), F.col("rating").alias("value"),
        F.col("review_count"))
    return recorded.unionByName(boxes).unionByName(ratings, allowMissingColumns=True)


def period_ratings(spark, sf):
    """Ratings attached to the activity periods of the same scope and bin."""
    b = businesses(spark, sf)
    daily = act.scope_days(activity(spark, sf, MONTHS), b, SCOPE, MONTHS)
    bins = act.period_totals(daily, b, SCOPE, MONTHS, COVERAGE)
    history = rev.scope_history(review_days(spark, sf), b, SCOPE, MONTHS.end)
    ratings = rev.rating_periods(history, SCOPE, MONTHS, COVERAGE, "period").select(
        *SCOPE, "period", "rating", "review_count")
    return tidy(bins.join(ratings, [*SCOPE, "period"], "left").select(
        *SCOPE, "period", "period_start", "checkins", "rating",
        F.coalesce("review_count", F.lit(0)).alias("review_count")))


QUERIES = {
    "weather_accepted_readings": accepted_readings,
    "weather_station_days": station_days,
    "weather_complete_days": complete_station_days,
    "weather_duplicate_readings": duplicate_readings,
    "weather_station_summary": station_summary,
    "weather_station_months": station_months,
    "weather_mapped_stations": mapped_stations,
    "weather_box_station_months": box_station_months,
    "weather_box_station_weeks": box_station_weeks_temperature,
    "weather_box_pooled_years": box_pooled_years,
    "weather_box_hourly": box_hourly,
    "weather_box_display": box_display,
    "weather_pooled_samples": pooled_samples,
    "weather_pooled_samples_covered": pooled_samples_covered,
    "weather_business_days": business_weather_days,
    "weather_business_days_covered": business_weather_days_covered,
    "weather_bands_tmax": _bands("tmax"),
    "weather_bands_rain": _bands("pcpn"),
    "weather_correlation": correlation,
    "weather_business_layer": business_layer,
    "weather_area_layer": area_weather,
    "weather_representative_station": representative_station,
    "weather_hourly_completed": hourly_completed,
    "weather_hourly_latest": hourly_latest,
    "weather_hourly_summary": hourly_summary,
    "weather_hourly_chart": hourly_chart,
    "weather_temperature_source": temperature_source,
    "weather_temperature_source_covered": temperature_source_covered,
    "weather_quality_variable": _completeness(["variable"]),
    "weather_quality_station_year": _completeness(["station_id", "year", "variable"]),
    "weather_flag_counts": flag_counts,
    "weather_complete_months": complete_months,
    "weather_long_run_seasonality": long_run_seasonality,
    "weather_coherence_checks": coherence_checks,
    "review_scope_history": review_scope_history,
    "review_business_days": review_business_days,
    "review_rating_period": _ratings("period", MONTHS, SCOPE),
    "review_rating_cumulative": _ratings("cumulative", MONTHS, SCOPE),
    "review_rating_business": _ratings("cumulative", YEARS, ["business_id"]),
    "chart_period_ratings": period_ratings,
}

_M = BETWEEN["months"]
SAMPLES_SQL = _SAMPLES = """sample AS (
  SELECT station_id, day, 'tmin' AS series, tmin AS value FROM station_day WHERE tmin IS NOT NULL
  UNION ALL SELECT station_id, day, 'tmax', tmax FROM station_day WHERE tmax IS NOT NULL
  UNION ALL SELECT station_id, day, 'pcpn', pcpn FROM station_day WHERE pcpn IS NOT NULL),
pooled AS (SELECT metro, s.* FROM sample s
  JOIN (SELECT DISTINCT metro, station_id FROM business WHERE station_id IS NOT NULL)
  USING (station_id))"""
_SUMMARY = """count(tmin) AS tmin_days, count(tmax) AS tmax_days, count(pcpn) AS pcpn_days,
  avg(tmin) AS mean_tmin, avg(tmax) AS mean_tmax, sum(pcpn) AS pcpn_sum, max(day) AS latest_day"""
_STATION_SUMMARY = f"""stations AS (SELECT DISTINCT station_id FROM business
  WHERE station_id IS NOT NULL),
station_sum AS (SELECT station_id, coalesce(tmin_days, 0) AS tmin_days,
  coalesce(tmax_days, 0) AS tmax_days, coalesce(pcpn_days, 0) AS pcpn_days, mean_tmin, mean_tmax,
  pcpn_sum, latest_day, 387 AS selected_days FROM stations LEFT JOIN (
    SELECT station_id, {_SUMMARY} FROM station_day WHERE day BETWEEN {_M} GROUP BY 1)
  USING (station_id))"""
_LAST = {"week": "first + 6", "month": "last_day(first)",
         "year": "CAST(first + INTERVAL 1 year AS DATE) - 1"}
_LABEL = {"week": "'Week of ' || strftime(first, '%Y-%m-%d')",
          "month": "strftime(first, '%B %Y')", "year": "strftime(first, '%Y')"}
_BOX_DOUBLES = "minimum q1 median q3 maximum mean"


def _box(source: str, keys: str, kind: str, a: str, z: str, series: str = "series",
         extra: str = "") -> str:
    lower, upper = f"greatest(first, DATE '{a}')", f"least({_LAST[kind]}, DATE '{z}')"
    return f"""SELECT {keys}, series, {_LABEL[kind]} AS period, {lower} AS period_start,
  {upper} AS period_end,
  CAST({lower} AS TIMESTAMP) + to_seconds(43200 * ({upper} - {lower})) AS midpoint,
  CAST(greatest({lower}, fr) AS TIMESTAMP) + to_seconds(43200 * (least({upper}, lr)
    - greatest({lower}, fr))) AS observed_midpoint,
  readings, observed_days, minimum, q1, median, q3, maximum, mean, first_report, last_report{extra}
FROM (SELECT {keys}, {series} AS series, CAST(date_trunc('{kind}', day) AS DATE) AS first,
  count(value) AS readings, count(DISTINCT day) FILTER (value IS NOT NULL) AS observed_days,
  min(value) AS minimum, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3, max(value) AS maximum, avg(value) AS mean,
  min(day) FILTER (value IS NOT NULL) AS first_report,
  max(day) FILTER (value IS NOT NULL) AS last_report,
  coalesce(min(day) FILTER (value IS NOT NULL), min(day)) AS fr,
  coalesce(max(day) FILTER (value IS NOT NULL), max(day)) AS lr
  FROM {source} WHERE day BETWEEN DATE '{a}' AND DATE '{z}' GROUP BY ALL)"""


_HOURLY = """hourly AS (SELECT station, date_trunc('hour', ts) AS hour, ts, temperature_c,
  precipitation_mm, is_trace, event_id FROM (SELECT *, row_number() OVER (PARTITION BY station,
  date_trunc('hour', ts) ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM lcd_value
  WHERE report_type = 'FM-15') WHERE r = 1)"""


def _band_case(variable: str) -> str:
    first, *rest = wv.bands(variable)
    op = "<=" if variable == "pcpn" else "<"
    whens = [f"WHEN {variable} {op} {first[1]:.0f}e0 THEN 0"]
    whens += [f"WHEN {variable} < {u:.0f}e0 THEN {i}" for i, (_, u) in enumerate(rest, 1)
              if u is not None]
    return f"CASE WHEN {variable} IS NULL THEN NULL {' '.join(whens)} ELSE {len(rest)} END"


def _band_sql(variable: str) -> str:
    labels = ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(wv.bands(variable)))
    return sql("business activity station", f"""
SELECT business_id, '{variable}' AS variable, band_index, band, count(n) AS day_count,
  count(n) FILTER (n = 0) AS zero_days, quantile_cont(n, 0.5) AS median,
  quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, min(n) AS minimum, max(n) AS maximum
FROM (SELECT business_id, station_id, band_index, band FROM business
  CROSS JOIN (VALUES {labels}) AS b(band_index, band))
LEFT JOIN (SELECT business_id, {_band_case(variable)} AS band_index, coalesce(n, 0) AS n
  FROM business JOIN station_day USING (station_id)
  LEFT JOIN (SELECT business_id, day, CAST(sum(n) AS BIGINT) AS n FROM activity GROUP BY ALL)
    USING (business_id, day)
  WHERE day BETWEEN {BETWEEN['years']}) USING (business_id, band_index)
GROUP BY ALL""", "median q1 q3")


def _quality(keys: str) -> str:
    return sql("station", f"""SELECT {keys}, count(*) AS requested, count(r.value) AS numeric,
  count(a.value) AS usable, max(r.day) FILTER (r.value IS NOT NULL) AS latest_numeric,
  max(r.day) FILTER (a.value IS NOT NULL) AS latest_usable,
  (1 - count(r.value) * 1e0 / count(*)) * 100 AS missing_pct,
  (1 - count(a.value) * 1e0 / count(*)) * 100 AS not_usable_pct,
  DATE '2001-11-04' - max(r.day) FILTER (r.value IS NOT NULL) AS lag_days
FROM (SELECT *, year(day) AS year FROM report) r
LEFT JOIN accepted a USING (station_id, day, variable)
WHERE day BETWEEN DATE '1995-01-02' AND DATE '2001-11-04' GROUP BY ALL""",
               "missing_pct not_usable_pct")


def _rating_sql(mode: str, kind: str, a: str, z: str, keys: str, join: str) -> str:
    last = f"least({_LAST[kind]}, DATE '{z}')"
    through = f"OVER (PARTITION BY {keys} ORDER BY first)"
    stars, n = ("stars", "n") if mode == "period" else (
        f"sum(stars) {through} + prior_stars", f"sum(n) {through} + prior_n")
    return sql("business review", f"""
SELECT {keys}, period, period_start, period_end,
  CASE WHEN covered AND n_all > 0 THEN stars_all * 1e0 / n_all END AS rating,
  CAST(CASE WHEN covered THEN n_all ELSE 0 END AS BIGINT) AS review_count,
  CAST(CASE WHEN covered THEN n ELSE 0 END AS BIGINT) AS new_reviews,
  CASE WHEN covered THEN least(period_end, DATE '2001-03-31') END AS rating_as_of,
  '{mode}' AS rating_mode
FROM (SELECT {keys}, {_LABEL[kind]} AS period, greatest(first, DATE '{a}') AS period_start,
    {last} AS period_end, {stars} AS stars_all, {n} AS n_all, n,
    greatest(first, DATE '{a}') <= DATE '2001-03-31' AND {last} >= DATE '1995-06-01' AS covered
  FROM (SELECT {keys}, first, coalesce(stars, 0) AS stars, coalesce(n, 0) AS n,
      coalesce(prior_stars, 0) AS prior_stars, coalesce(prior_n, 0) AS prior_n
    FROM (SELECT DISTINCT {keys} FROM history)
    CROSS JOIN (SELECT CAST(unnest(generate_series(date_trunc('{kind}', DATE '{a}'),
      DATE '{z}', INTERVAL 1 {kind})) AS DATE) AS first)
    LEFT JOIN (SELECT {keys}, CAST(date_trunc('{kind}', day) AS DATE) AS first,
      sum(star_sum) AS stars, sum(review_count) AS n FROM history
      WHERE day BETWEEN DATE '{a}' AND least(DATE '{z}', DATE '2001-03-31') GROUP BY ALL)
      USING ({keys}, first)
    LEFT JOIN (SELECT {keys}, sum(star_sum) AS prior_stars, sum(review_count) AS prior_n
      FROM history WHERE day >= DATE '1995-06-01' AND day < DATE '{a}' GROUP BY ALL)
      USING ({keys})))""", "rating", join)


_SCOPE_HISTORY = """history AS (SELECT metro, parent, day, CAST(sum(star_sum) AS BIGINT)
  AS star_sum, CAST(sum(review_day.review_count) AS BIGINT) AS review_count FROM review_day
  JOIN business USING (business_id) WHERE day <= DATE '{z}' GROUP BY ALL)"""

ORACLES = {
    "weather_accepted_readings": sql("station", "SELECT * FROM accepted", "value"),
    "weather_station_days": sql("station", "SELECT * FROM station_day", "tmin tmax pcpn"),
    "weather_complete_days": sql("station", """SELECT * FROM station_day WHERE tmin IS NOT NULL
  AND tmax IS NOT NULL AND pcpn IS NOT NULL""", "tmin tmax pcpn"),
    "weather_duplicate_readings": """SELECT 'S' || CAST(l_suppkey % 10 AS VARCHAR) AS station_id,
  CAST(l_shipdate AS DATE) AS day, count(*) AS count FROM lineitem GROUP BY ALL
  HAVING count(*) > 1""",
    "weather_station_summary": sql("business station", "SELECT * FROM station_sum",
                                   "mean_tmin mean_tmax pcpn_sum", _STATION_SUMMARY),
    "weather_station_months": sql("station", f"""SELECT station_id,
  CAST(date_trunc('month', day) AS DATE) AS month, {_SUMMARY},
  least(last_day(any_value(day)), DATE '2001-06-30') - greatest(CAST(date_trunc('month',
    any_value(day)) AS DATE), DATE '2000-03-10') + 1 AS selected_days FROM station_day
  WHERE day BETWEEN DATE '2000-03-10' AND DATE '2001-06-30'
  GROUP BY station_id, CAST(date_trunc('month', day) AS DATE)""", "mean_tmin mean_tmax pcpn_sum"),
    "weather_mapped_stations": sql("business", """SELECT DISTINCT metro, parent, station_id
  FROM business WHERE station_id IS NOT NULL"""),
    "weather_box_station_months": sql("business station", _box(
        "sample", "station_id", "month", "2000-03-10", "2001-03-31"), _BOX_DOUBLES, _SAMPLES),
    "weather_box_station_weeks": sql("business station", _box(
        "sample", "station_id", "week", "2000-01-05", "2000-03-20",
        "CASE WHEN series = 'pcpn' THEN series ELSE 'Temperature' END"), _BOX_DOUBLES, _SAMPLES),
    "weather_box_pooled_years": sql("business station", _box(
        "pooled", "metro", "year", "1996-02-29", "2000-02-29"), _BOX_DOUBLES, _SAMPLES),
    "weather_box_hourly": sql("lcd", _box(
        "hourly_sample", "station_id", "week", "2024-01-01", "2024-01-30",
        extra=""", 24 * (least(first + 6, DATE '2024-01-30') - greatest(first,
        DATE '2024-01-01') + 1) AS expected, 1e2 * readings / (24 * (least(first + 6,
        DATE '2024-01-30') - greatest(first, DATE '2024-01-01') + 1)) AS coverage_pct"""),
        _BOX_DOUBLES + " coverage_pct", _HOURLY + """, hourly_sample AS (SELECT station
        AS station_id, CAST(ts AS DATE) AS day, 'temperature' AS series, temperature_c AS value
        FROM hourly)"""),
    "weather_box_display": sql("business station", f"""SELECT station_id, series,
  CAST(date_trunc('month', day) AS DATE) AS month, arg_min(value, (day, value)) AS representative,
  count(*) AS samples FROM sample WHERE day BETWEEN {_M} GROUP BY ALL""", "representative",
        _SAMPLES),
    "weather_pooled_samples": sql("business station", """SELECT metro, station_id, day, series,
  value FROM pooled WHERE day BETWEEN DATE '2000-01-05' AND DATE '2000-03-20'""", "value",
        _SAMPLES),
    "weather_business_days": sql("business activity station", """
SELECT business_id, day, coalesce(n, 0) AS checkins, tmin, tmax, pcpn,
  tmin IS NOT NULL AND tmax IS NOT NULL AND pcpn IS NOT NULL AS weather_available
FROM (SELECT business_id, station_id, CAST(unnest(generate_series(DATE '2000-01-05',
  DATE '2000-03-20', INTERVAL 1 day)) AS DATE) AS day FROM business)
LEFT JOIN (SELECT business_id, day, CAST(sum(n) AS BIGINT) AS n FROM activity GROUP BY ALL)
  USING (business_id, day)
LEFT JOIN station_day USING (station_id, day)""", "tmin tmax pcpn"),
    "weather_bands_tmax": _band_sql("tmax"),
    "weather_bands_rain": _band_sql("pcpn"),
    "weather_correlation": sql("business activity station", f"""
SELECT business_id, 1462 AS total_days, count(tmax) AS paired_days,
  1462 - count(tmax) AS missing_days, CASE WHEN count(tmax) >= 3 AND min(tmax) <> max(tmax)
    AND min(n) <> max(n) THEN corr(tmax, n) END AS pearson_r
FROM business LEFT JOIN (SELECT business_id, tmax, coalesce(n, 0) AS n
  FROM business JOIN station_day USING (station_id)
  LEFT JOIN (SELECT business_id, day, CAST(sum(n) AS BIGINT) AS n FROM activity GROUP BY ALL)
    USING (business_id, day)
  WHERE tmax IS NOT NULL AND day BETWEEN {BETWEEN['years']}) USING (business_id)
GROUP BY business_id""", "pearson_r"),
    "weather_business_layer": sql("business station", """SELECT business_id, station_id,
  CASE WHEN tmax_days > 0 THEN mean_tmax END AS weather_value,
  coalesce(tmax_days, 0) AS weather_days FROM business LEFT JOIN station_sum USING (station_id)""",
        "weather_value", _STATION_SUMMARY),
    "weather_area_layer": sql("business station", """
SELECT metro, parent, area_id, avg(pcpn_sum) AS value, count(pcpn_sum) AS usable_businesses,
  count(*) AS total_businesses, avg(pcpn_days) FILTER (pcpn_sum IS NOT NULL) AS valid_days,
  count(DISTINCT station_id) FILTER (pcpn_sum IS NOT NULL) AS station_count,
  coalesce(array_to_string(list_sort(list_distinct(list(station_id) FILTER (
    pcpn_sum IS NOT NULL))), '; '), '') AS stations
FROM business LEFT JOIN station_sum USING (station_id) WHERE area_id IS NOT NULL
GROUP BY ALL""", "value valid_days", _STATION_SUMMARY),
    "weather_representative_station": sql("business", """
SELECT metro, arg_min(station_id, (-n, station_id)) AS station_id, max(n) AS station_businesses,
  any_value(total) AS businesses, max(n) * 1e2 / any_value(total) AS share_pct
FROM (SELECT metro, station_id, count(*) AS n FROM business WHERE station_id IS NOT NULL
  GROUP BY ALL) JOIN (SELECT metro, count(*) AS total FROM business GROUP BY 1) USING (metro)
GROUP BY metro""", "share_pct"),
    "weather_hourly_completed": sql("lcd registry", """SELECT station AS station_id, ts AS observed_at,
  event_id AS dataset_id, temperature_c FROM hourly JOIN reg ON id = event_id
  WHERE status = 'complete' AND import_key = 'click'""", "temperature_c", _HOURLY),
    "weather_hourly_latest": sql("lcd", """SELECT station AS station_id, hour, ts AS observed_at,
  temperature_c, precipitation_mm, is_trace, CAST(event_id AS VARCHAR) AS source_code
  FROM hourly""", "temperature_c precipitation_mm", _HOURLY),
    "weather_hourly_summary": sql("lcd", """SELECT station AS station_id,
  count(*) AS observations, min(ts) AS first_at, max(ts) AS last_at,
  count(*) FILTER (temperature_c IS NULL) AS missing_temperature,
  count(*) FILTER (precipitation_mm IS NULL) AS missing_precipitation,
  count(*) FILTER (is_trace) AS traces FROM hourly GROUP BY 1""", ctes=_HOURLY),
    "weather_hourly_chart": sql("lcd", """SELECT station AS station_id, ts AS observed_at,
  ts + INTERVAL 5 hour AS instant, CAST(ts AS DATE) AS day, temperature_c AS value
  FROM hourly WHERE temperature_c IS NOT NULL""", "value", _HOURLY),
    "weather_temperature_source": sql("business station lcd", """
SELECT metro, frequency, count(*) AS readings, avg(value) AS mean FROM (
  SELECT CASE WHEN station = 'click' THEN 'ASIA' ELSE 'EUROPE' END AS metro,
    'Hourly' AS frequency, temperature_c AS value FROM hourly WHERE temperature_c IS NOT NULL
  UNION ALL SELECT metro, 'Daily summaries', value FROM pooled WHERE series = 'tmax'
    AND metro NOT IN ('ASIA', 'EUROPE') AND day BETWEEN DATE '2000-01-05' AND DATE '2000-03-20')
GROUP BY ALL""", "mean", _HOURLY + ", " + _SAMPLES),
    "weather_quality_variable": _quality("variable"),
    "weather_quality_station_year": _quality("station_id, year, variable"),
    "weather_flag_counts": sql("report", """SELECT variable, CASE WHEN trim(flag) = ''
  THEN '(blank)' ELSE upper(trim(flag)) END AS flag_clean, count(*) AS rows FROM report
  GROUP BY ALL"""),
    "weather_complete_months": sql("business station", """SELECT station_id, series,
  CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS usable_days,
  day(last_day(any_value(day))) AS calendar_days,
  count(*) = day(last_day(any_value(day))) AS complete,
  CASE WHEN count(*) = day(last_day(any_value(day))) THEN
    CASE WHEN series = 'pcpn' THEN sum(value) ELSE avg(value) END END AS metric
FROM sample GROUP BY station_id, series, CAST(date_trunc('month', day) AS DATE)""", "metric",
        _SAMPLES),
    "weather_long_run_seasonality": sql("business station", """SELECT series, month(month)
  AS month_of_year, avg(metric) AS metric, count(*) AS contributing_months FROM (
  SELECT station_id, series, CAST(date_trunc('month', day) AS DATE) AS month,
    CASE WHEN series = 'pcpn' THEN sum(value) ELSE avg(value) END AS metric
  FROM sample GROUP BY station_id, series, CAST(date_trunc('month', day) AS DATE)
  HAVING count(*) >= 5e-1 * day(last_day(any_value(day))))
GROUP BY ALL""", "metric", _SAMPLES),
    "weather_coherence_checks": sql("report", """SELECT station_id,
  count(*) FILTER (tmax < tmin) AS tmax_below_tmin, count(*) FILTER (pcpn < 0) AS negative_rain
FROM (SELECT station_id, day, max(value) FILTER (variable = 'tmax') AS tmax,
  max(value) FILTER (variable = 'tmin') AS tmin, max(value) FILTER (variable = 'pcpn') AS pcpn
  FROM report GROUP BY ALL) GROUP BY 1"""),
    "review_scope_history": sql("business review", "SELECT * FROM history",
                                ctes=_SCOPE_HISTORY.format(z="2000-02-29")),
    "review_business_days": sql("review", "SELECT * FROM review_day"),
    "review_rating_period": _rating_sql("period", "month", "2000-03-10", "2001-06-30",
        "metro, parent", _SCOPE_HISTORY.format(z="2001-06-30")),
    "review_rating_cumulative": _rating_sql("cumulative", "month", "2000-03-10", "2001-06-30",
        "metro, parent", _SCOPE_HISTORY.format(z="2001-06-30")),
    "review_rating_business": _rating_sql("cumulative", "year", "1996-02-29", "2000-02-29",
        "business_id", "history AS (SELECT * FROM review_day)"),
}
_BIN = "strftime(CAST(date_trunc('month', day) AS DATE), '%B %Y') AS period"
_MONTH_GRID = """(SELECT CAST(unnest(generate_series(DATE '2000-03-01', DATE '{z}',
  INTERVAL 1 month)) AS DATE) AS first)"""
CHART_SQL = f"""
SELECT metro, strftime(first, '%B %Y') AS period, 'Recorded check-ins' AS series,
  CAST(coalesce(n, 0) AS DOUBLE) AS value, CAST(NULL AS BIGINT) AS review_count
FROM (SELECT DISTINCT metro FROM business) CROSS JOIN {_MONTH_GRID.format(z='2001-03-31')}
LEFT JOIN (SELECT metro, CAST(date_trunc('month', day) AS DATE) AS first, sum(n) AS n
  FROM activity JOIN business USING (business_id) WHERE day BETWEEN {_M} GROUP BY ALL)
  USING (metro, first)
UNION ALL
SELECT metro, {_BIN}, series, quantile_cont(value, 0.5), NULL FROM pooled
WHERE day BETWEEN DATE '2000-03-10' AND DATE '2001-06-30' GROUP BY ALL
UNION ALL
SELECT metro, strftime(first, '%B %Y'), 'Rating', stars * 1e0 / n, CAST(coalesce(n, 0) AS BIGINT)
FROM (SELECT DISTINCT metro FROM review_day JOIN business USING (business_id))
CROSS JOIN {_MONTH_GRID.format(z='2001-06-30')}
LEFT JOIN (SELECT metro, CAST(date_trunc('month', day) AS DATE) AS first, sum(star_sum) AS stars,
  sum(review_day.review_count) AS n FROM review_day JOIN business USING (business_id)
  WHERE day BETWEEN {_M} GROUP BY ALL) USING (metro, first)"""
ORACLES["chart_period_ratings"] = sql("business activity review", f"""
SELECT metro, parent, strftime(first, '%B %Y') AS period,
  greatest(first, DATE '2000-03-10') AS period_start, coalesce(c, 0) AS checkins,
  stars * 1e0 / n AS rating, CAST(coalesce(n, 0) AS BIGINT) AS review_count
FROM (SELECT DISTINCT metro, parent FROM business) CROSS JOIN {_MONTH_GRID.format(z='2001-03-31')}
LEFT JOIN (SELECT metro, parent, CAST(date_trunc('month', day) AS DATE) AS first,
  CAST(sum(activity.n) AS BIGINT) AS c FROM activity JOIN business USING (business_id)
  WHERE day BETWEEN {_M} GROUP BY ALL) USING (metro, parent, first)
LEFT JOIN (SELECT metro, parent, CAST(date_trunc('month', day) AS DATE) AS first,
  sum(star_sum) AS stars, sum(review_day.review_count) AS n FROM review_day
  JOIN business USING (business_id) WHERE day BETWEEN {_M} GROUP BY ALL)
  USING (metro, parent, first)""", "rating")


def _covered(name: str, a: str, z: str) -> str:
    """The oracle of a query on weeks, over the days from ``a`` to ``z``."""
    return ORACLES[name].replace("DATE '2000-01-05'", f"DATE '{a}'").replace("DATE '2000-03-20'", f"DATE '{z}'")


for _name, _a, _z in (("pooled_samples", "1995-01-02", "2001-11-04"), ("business_days", "1995-06-01", "2001-03-31"),
                      ("temperature_source", "1995-01-02", "2001-11-04")):
    ORACLES[f"weather_{_name}"] = ORACLES[f"weather_{_name}_covered"] = _covered(f"weather_{_name}", _a, _z)
