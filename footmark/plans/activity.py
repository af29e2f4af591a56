"""Activity, business and category questions over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from footmark.config import Filters
from footmark.functions import dates
from footmark.operators import activity as act
from footmark.operators import business as biz
from footmark.plans.domain import (
    CO_TAG, COVERAGE, FUTURE, MONTHS, SCOPE, WEEKS, YEARS, activity, businesses, sql, tidy,
)

COVERED_MONTHS = MONTHS.intersect(COVERAGE)
BETWEEN = {
    "months": "DATE '2000-03-10' AND DATE '2001-03-31'",
    "years": "DATE '1996-02-29' AND DATE '2000-02-29'",
    "weeks": "DATE '2000-01-05' AND DATE '2000-03-20'",
}
DAYS = {"months": 387, "years": 1462, "weeks": 76}

TOTALS = """totals AS (
  SELECT business_id, CAST(sum(n) AS BIGINT) AS checkins, count(DISTINCT day) AS active_days,
    CAST(coalesce(sum(n) FILTER (WHERE isodow(day) IN (6, 7)), 0) AS BIGINT) AS weekend_checkins
  FROM activity WHERE day BETWEEN {window} GROUP BY business_id),
summary AS (
  SELECT b.*, coalesce(checkins, 0) AS checkins, coalesce(active_days, 0) AS active_days,
    coalesce(weekend_checkins, 0) AS weekend_checkins,
    coalesce(checkins, 0) * 7e0 / {days} AS weekly_checkins,
    coalesce(checkins, 0) * 1e0 / {days} AS daily_checkins,
    CASE WHEN checkins > 0 THEN weekend_checkins * 1e0 / checkins END AS weekend_share
  FROM business b LEFT JOIN totals USING (business_id))"""


def summary_sql(window: str) -> str:
    return TOTALS.format(window=BETWEEN[window], days=DAYS[window])


def _summaries(spark, sf, span=COVERED_MONTHS):
    return biz.summaries(businesses(spark, sf), act.business_totals(activity(spark, sf, span), span), span)


def rank_by_activity(spark, sf):
    rows = biz.rank_businesses(_summaries(spark, sf), SCOPE, "Recorded check-ins")
    return tidy(rows.select(*SCOPE, "rank", "business_id", "name", "checkins", "active_days",
                            "weekly_checkins", "daily_checkins", "weekend_share"))


def rank_by_rating(spark, sf):
    rows = biz.rank_businesses(_summaries(spark, sf), ["metro"], "Rating (snapshot)")
    return tidy(rows.select("metro", "rank", "business_id", "stars"))


def rank_by_reviews(spark, sf):
    rows = biz.rank_businesses(_summaries(spark, sf), ["metro"], "Reviews (snapshot)")
    return tidy(rows.select("metro", "rank", "business_id", "review_count"))


def area_hour_counts(spark, sf):
    return tidy(act.by_area_hour(activity(spark, sf), businesses(spark, sf), ["metro"], COVERAGE))


def business_totals(spark, sf):
    return tidy(act.business_totals(activity(spark, sf, COVERED_MONTHS), COVERED_MONTHS))


def business_months(spark, sf):
    return tidy(act.business_months(activity(spark, sf, COVERED_MONTHS), COVERED_MONTHS))


def scope_days(spark, sf):
    return tidy(act.scope_days(activity(spark, sf, COVERED_MONTHS), businesses(spark, sf), SCOPE, COVERED_MONTHS))


def business_days(spark, sf):
    return tidy(act.business_days(activity(spark, sf, COVERED_MONTHS), COVERED_MONTHS))


def tag_filter_days(spark, sf):
    members = act.in_scope(businesses(spark, sf), Filters(COVERED_MONTHS, co_tag=CO_TAG))
    return tidy(act.scope_days(activity(spark, sf, COVERED_MONTHS), members, SCOPE, COVERED_MONTHS))


def member_area_hours(spark, sf):
    """Counts of a member list: the four leading businesses of every scope."""
    top = biz.rank_businesses(_summaries(spark, sf), SCOPE, "Recorded check-ins")
    members = top.where(F.col("rank") <= 4).select("business_id")
    return tidy(act.by_area_hour(activity(spark, sf), businesses(spark, sf), SCOPE,
                                 COVERED_MONTHS, False, members))


def month_rates(spark, sf):
    return tidy(act.month_rates(activity(spark, sf, COVERED_MONTHS), businesses(spark, sf), COVERED_MONTHS))


def _periods(spark, sf, span, coverage):
    b = businesses(spark, sf)
    daily = act.scope_days(activity(spark, sf, span), b, SCOPE, span)
    return tidy(act.period_totals(daily, b, SCOPE, span, coverage))


def period_weeks(spark, sf):
    return _periods(spark, sf, WEEKS, COVERAGE)


def period_months(spark, sf):
    return _periods(spark, sf, MONTHS, COVERAGE)


def period_years(spark, sf):
    return _periods(spark, sf, YEARS, COVERAGE)


def _area_hours(spark, sf, span):
    return act.by_area_hour(activity(spark, sf, span), businesses(spark, sf), ["metro"], span, False)


def _area_days(spark, sf, span):
    return _area_hours(spark, sf, span).groupBy("metro", "area_id", "day").agg(
        F.sum("checkins").alias("checkins"))


def heatmap(spark, sf):
    return tidy(act.heatmap(_area_hours(spark, sf, YEARS), ["metro", "area_id"]))


def activity_summary(spark, sf):
    span = dates.Span(YEARS.start.replace(month=3, day=1), YEARS.end)
    return tidy(act.activity_summary(_area_hours(spark, sf, span), ["metro", "area_id"], span))


def monthly_index(spark, sf):
    return tidy(act.month_of_year_profile(_area_days(spark, sf, YEARS), ["metro", "area_id"], YEARS))


def annual_share(spark, sf):
    return tidy(act.annual_share(_area_days(spark, sf, YEARS), ["metro"], "area_id", YEARS))


def weekly_series(spark, sf):
    return tidy(act.weekly_series(_area_days(spark, sf, COVERED_MONTHS), ["metro", "area_id"],
                                  COVERED_MONTHS))


def known_day_totals(spark, sf):
    daily = act.scope_days(activity(spark, sf, MONTHS), businesses(spark, sf), ["metro"], MONTHS)
    return tidy(act.weekday_totals(daily, ["metro"], MONTHS, COVERAGE))


def year_over_year(spark, sf):
    """Daily averages of the current and previous-year window per scope and area."""
    span, back = COVERED_MONTHS, COVERED_MONTHS.previous_year()
    day = F.col("day")
    rows = act.by_area_hour(activity(spark, sf), businesses(spark, sf), ["metro"], span, True)
    sums = rows.groupBy("metro", "area_id").agg(
        F.sum(F.when(span.holds(day), F.col("checkins")).otherwise(0)).alias("current"),
        F.sum(F.when(back.holds(day), F.col("checkins")).otherwise(0)).alias("previous"))
    full = COVERAGE.contains(span) and COVERAGE.contains(back)
    yoy = ((F.col("current") / span.days) / (F.col("previous") / back.days) - 1) * 100
    return tidy(sums.withColumn(
        "yoy_percent", F.when(F.lit(full) & (F.col("previous") > 0), yoy)))


def date_rules(spark, sf):
    """Calendar functions on every order date."""
    day = F.col("day")
    rows = activity(spark, sf).select("day").distinct()
    return tidy(rows.select(
        "day", dates.previous_year(day).alias("year_back"), dates.weekday(day).alias("weekday"),
        dates.month_start(day).alias("month"), dates.month_days(day).alias("month_days"),
        F.add_months(dates.month_start(day), 1).alias("next_month"),
        dates.calendar_cell(day).alias("cell"),
        dates.covered_days(day, F.date_add(day, 400), COVERAGE).alias("covered_days"),
        dates.grain_column(day, F.lit(YEARS.end)).alias("grain")))


def date_presets(spark, sf):
    """Presets relative to each business's own recorded interval."""
    bounds = activity(spark, sf).groupBy("business_id").agg(
        F.min("day").alias("a"), F.max("day").alias("z"))
    return tidy(bounds.select("business_id", F.inline(
        dates.preset_bounds(F.col("a"), F.col("z")))))


def _categories(spark, sf):
    return biz.category_summaries(_summaries(spark, sf), ["metro"], COVERED_MONTHS)


def category_summary(spark, sf):
    return tidy(_categories(spark, sf))


def _rank_categories(metric):
    def run(spark, sf):
        rows = _categories(spark, sf)
        return tidy(biz.rank_categories(rows, ["metro"], metric).select(
            "metro", "rank", "tag", "checkins", "businesses", "daily_per_business"))
    return run


def category_table(spark, sf):
    rows = _categories(spark, sf)
    return tidy(biz.category_table(rows, ["metro"], 5))


def tags_in_scope(spark, sf):
    return tidy(biz.distinct_tags(businesses(spark, sf), ["metro"]))


def co_tags(spark, sf):
    return tidy(biz.co_tags(businesses(spark, sf), SCOPE))


def competitors(spark, sf):
    rows = biz.competitor_list(_summaries(spark, sf), SCOPE, COVERED_MONTHS)
    return tidy(rows)


def competitors_uncovered(spark, sf):
    return tidy(biz.competitor_list(_summaries(spark, sf), SCOPE, None))


def comparison_matrix(spark, sf):
    ranked = biz.rank_businesses(_summaries(spark, sf), SCOPE, "Recorded check-ins")
    return tidy(biz.comparison_matrix(ranked, SCOPE))


def top_listings(spark, sf):
    """The twenty most active listings overall: a global top-k report."""
    rows = _summaries(spark, sf).orderBy(F.col("checkins").desc(), "business_id").limit(20)
    return tidy(rows.select("business_id", "name", "checkins"))


def name_search(spark, sf):
    """Every listing whose name or id holds the needle, case aside."""
    found = biz.search(businesses(spark, sf), "#00000007")
    return tidy(found.select("business_id", "name"))


def projected_interval_days(spark, sf):
    """Recorded and projected day counts of one selection per business and its recorded end."""
    after = FUTURE.after(COVERAGE)
    seen = activity(spark, sf).groupBy("business_id").agg(F.max("day").alias("last_day"))
    return tidy(seen.select(
        "business_id",
        F.lit(FUTURE.intersect(COVERAGE).days).alias("recorded_days"),
        F.lit(after.days).alias("projected_days"),
        F.greatest(F.lit(0), F.datediff(F.lit(FUTURE.end), F.greatest(
            F.col("last_day"), F.date_sub(F.lit(FUTURE.start), 1)))).alias("days_after_last")))


QUERIES = {
    "business_rank_activity": rank_by_activity,
    "business_rank_rating": rank_by_rating,
    "business_rank_reviews": rank_by_reviews,
    "activity_area_hours": area_hour_counts,
    "activity_member_area_hours": member_area_hours,
    "activity_business_totals": business_totals,
    "activity_business_months": business_months,
    "activity_scope_days": scope_days,
    "activity_scope_days_co_tag": tag_filter_days,
    "activity_business_days": business_days,
    "activity_month_rates": month_rates,
    "activity_period_weeks": period_weeks,
    "activity_period_months": period_months,
    "activity_period_years": period_years,
    "activity_heatmap": heatmap,
    "activity_summary": activity_summary,
    "activity_monthly_index": monthly_index,
    "activity_annual_share": annual_share,
    "activity_weekly_series": weekly_series,
    "activity_known_day_totals": known_day_totals,
    "activity_year_over_year": year_over_year,
    "calendar_rules": date_rules,
    "calendar_presets": date_presets,
    "category_summary": category_summary,
    "category_rank_checkins": _rank_categories("Recorded check-ins"),
    "category_rank_per_business": _rank_categories("Check-ins / business / day"),
    "category_rank_listed": _rank_categories("Listed businesses"),
    "category_table": category_table,
    "category_tags": tags_in_scope,
    "category_co_tags": co_tags,
    "business_competitors": competitors,
    "business_competitors_uncovered": competitors_uncovered,
    "business_comparison_matrix": comparison_matrix,
    "business_top_listings": top_listings,
    "business_name_search": name_search,
    "calendar_projected_interval": projected_interval_days,
}

_AREA = "area AS (SELECT metro, coalesce(area_id, 0) AS area_id, day, hour, CAST(sum(n) AS BIGINT)"\
    " AS checkins FROM activity JOIN business USING (business_id) WHERE {w} GROUP BY ALL)"
_AREA_YEARS = _AREA.format(w=f"day BETWEEN {BETWEEN['years']}")
_TAGS = """tagged AS (SELECT metro, unnest(categories) AS tag, checkins FROM summary),
cat AS (SELECT metro, tag, count(*) AS businesses, count(*) FILTER (checkins > 0)
    AS active_businesses, CAST(sum(checkins) AS BIGINT) AS checkins,
  sum(checkins) * 7e0 / (387 * count(*)) AS weekly_per_business,
  sum(checkins) * 1e0 / (387 * count(*)) AS daily_per_business,
  CASE WHEN sum(checkins) > 0 THEN max(checkins) * 1e0 / sum(checkins) END AS top_share,
  median(checkins) * 7e0 / 387 AS median_weekly, median(checkins) * 1e0 / 387 AS median_daily
  FROM tagged GROUP BY ALL)"""


def _period_sql(window: str, lower: str, upper: str, cover_upper: str, kind: str, last: str,
                label: str) -> str:
    return sql("business activity", f"""
SELECT metro, parent, {label} AS period, greatest(first, DATE '{lower}') AS period_start,
  least({last}, DATE '{cover_upper}') AS period_end,
  CAST(least({last}, DATE '{cover_upper}') - greatest(first, DATE '{lower}') + 1 AS BIGINT)
    AS covered_days,
  CAST(greatest(first, DATE '{lower}') AS TIMESTAMP)
    + to_seconds(43200 * (least({last}, DATE '{upper}') - greatest(first, DATE '{lower}')))
    AS midpoint,
  coalesce(checkins, 0) AS checkins
FROM (SELECT DISTINCT metro, parent FROM business)
CROSS JOIN (SELECT CAST(unnest(generate_series(date_trunc('{kind}', DATE '{lower}'),
  DATE '{cover_upper}', INTERVAL 1 {kind})) AS DATE) AS first)
LEFT JOIN (SELECT metro, parent, CAST(date_trunc('{kind}', day) AS DATE) AS first,
  CAST(sum(n) AS BIGINT) AS checkins FROM activity JOIN business USING (business_id)
  WHERE day BETWEEN DATE '{lower}' AND DATE '{cover_upper}' GROUP BY ALL)
USING (metro, parent, first)""")


def _cat_rank(order: str) -> str:
    return sql("business activity", f"""SELECT metro, row_number() OVER (PARTITION BY metro
  ORDER BY {order} DESC, tag) AS rank, tag, checkins, businesses, daily_per_business FROM cat""",
               "daily_per_business", summary_sql("months") + ", " + _TAGS)


_MATRIX_CELLS = [
    ("Recorded check-ins", "format('{:,}', checkins)"),
    ("Days with check-ins", "format('{:,}', active_days)"),
    ("Weekend share (%)",
     "coalesce(format('{:.1f}', weekend_share * 100), 'Unavailable')"),
    ("Rating (snapshot)", "coalesce(format('{:.1f}', stars), 'Unavailable')"),
    ("Reviews (snapshot)", "format('{:,}', review_count)"),
    ("Operating status (snapshot)", "CASE WHEN is_open THEN 'Open' ELSE 'Closed' END"),
    ("Source categories", "array_to_string(categories, ', ')"),
]
_MATRIX = " UNION ALL ".join(
    f"SELECT metro, parent, rank, {i} AS line, '{m}' AS metric, {e} AS value FROM ranked"
    for i, (m, e) in enumerate(_MATRIX_CELLS))

ORACLES = {
    "business_rank_activity": sql("business activity", """SELECT metro, parent, row_number() OVER (
  PARTITION BY metro, parent ORDER BY checkins DESC, business_id) AS rank, business_id, name,
  checkins, active_days, weekly_checkins, daily_checkins, weekend_share FROM summary""",
        "weekly_checkins daily_checkins weekend_share", summary_sql("months")),
    "business_rank_rating": sql("business", """SELECT metro, row_number() OVER (PARTITION BY metro
  ORDER BY stars DESC NULLS LAST, business_id) AS rank, business_id, stars FROM business"""),
    "business_rank_reviews": sql("business", """SELECT metro, row_number() OVER (PARTITION BY metro
  ORDER BY review_count DESC, business_id) AS rank, business_id, review_count FROM business"""),
    "activity_area_hours": sql("business activity", """SELECT metro, coalesce(area_id, 0)
  AS area_id, day, hour, CAST(sum(n) AS BIGINT) AS checkins FROM activity
  JOIN business USING (business_id) WHERE day BETWEEN DATE '1995-06-01' AND DATE '2001-03-31'
  OR day BETWEEN DATE '1994-06-01' AND DATE '2000-03-31' GROUP BY ALL"""),
    "activity_member_area_hours": sql("business activity", f"""SELECT metro, parent,
  coalesce(area_id, 0) AS area_id, day, hour, CAST(sum(n) AS BIGINT) AS checkins FROM activity
  JOIN business USING (business_id) WHERE day BETWEEN {BETWEEN['months']} AND business_id IN (
    SELECT business_id FROM (SELECT business_id, row_number() OVER (PARTITION BY metro, parent
      ORDER BY checkins DESC, business_id) AS r FROM summary) WHERE r <= 4)
  GROUP BY ALL""", ctes=summary_sql("months")),
    "activity_business_totals": sql("business activity", "SELECT * FROM totals",
                                    ctes=summary_sql("months")),
    "activity_business_months": sql("activity", f"""SELECT business_id,
  CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(n) AS BIGINT) AS checkins
  FROM activity WHERE day BETWEEN {BETWEEN['months']} GROUP BY ALL"""),
    "activity_scope_days": sql("business activity", f"""SELECT metro, parent, day,
  CAST(sum(n) AS BIGINT) AS checkins FROM activity JOIN business USING (business_id)
  WHERE day BETWEEN {BETWEEN['months']} GROUP BY ALL"""),
    "activity_scope_days_co_tag": sql("business activity", f"""SELECT metro, parent, day,
  CAST(sum(n) AS BIGINT) AS checkins FROM activity JOIN business USING (business_id)
  WHERE day BETWEEN {BETWEEN['months']} AND list_contains(categories, 'Balance 1')
  GROUP BY ALL"""),
    "activity_business_days": sql("activity", f"""SELECT business_id, day,
  CAST(sum(n) AS BIGINT) AS checkins FROM activity WHERE day BETWEEN {BETWEEN['months']}
  GROUP BY ALL"""),
    "activity_month_rates": sql("business activity", f"""
SELECT business_id, month, coalesce(checkins, 0) AS checkins, calendar_days,
  coalesce(checkins, 0) * 7e0 / calendar_days AS weekly_checkins,
  coalesce(checkins, 0) * 1e0 / calendar_days AS daily_checkins
FROM (SELECT business_id FROM business)
CROSS JOIN (SELECT month, CAST(least(last_day(month), DATE '2001-03-31')
    - greatest(month, DATE '2000-03-10') + 1 AS BIGINT) AS calendar_days
  FROM (SELECT CAST(unnest(generate_series(DATE '2000-03-01', DATE '2001-03-31',
    INTERVAL 1 month)) AS DATE) AS month))
LEFT JOIN (SELECT business_id, CAST(date_trunc('month', day) AS DATE) AS month,
  CAST(sum(n) AS BIGINT) AS checkins FROM activity WHERE day BETWEEN {BETWEEN['months']}
  GROUP BY ALL) USING (business_id, month)""", "weekly_checkins daily_checkins"),
    "activity_period_weeks": _period_sql(
        "weeks", "2000-01-05", "2000-03-20", "2000-03-20", "week", "first + 6",
        "'Week of ' || strftime(first, '%Y-%m-%d')"),
    "activity_period_months": _period_sql(
        "months", "2000-03-10", "2001-06-30", "2001-03-31", "month", "last_day(first)",
        "strftime(first, '%B %Y')"),
    "activity_period_years": _period_sql(
        "years", "1996-02-29", "2000-02-29", "2000-02-29", "year",
        "CAST(first + INTERVAL 1 year AS DATE) - 1", "strftime(first, '%Y')"),
    "activity_heatmap": sql("business activity", """
SELECT metro, area_id, weekday, hour, coalesce(checkins, 0) AS checkins
FROM (SELECT DISTINCT metro, area_id FROM area)
CROSS JOIN (SELECT unnest(range(7)) AS weekday) CROSS JOIN (SELECT unnest(range(24)) AS hour)
LEFT JOIN (SELECT metro, area_id, isodow(day) - 1 AS weekday, hour,
  CAST(sum(checkins) AS BIGINT) AS checkins FROM area GROUP BY ALL)
USING (metro, area_id, weekday, hour)""", ctes=_AREA_YEARS),
    "activity_summary": sql("business activity", """
SELECT metro, area_id, checkins, checkins * 7e0 / 1461 AS weekly_checkins,
  weekday_n * 1e0 / checkins AS weekday_share, 1 - weekday_n * 1e0 / checkins AS weekend_share,
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][busiest + 1]
    AS busiest_day, peak_hour, peak_month, seasonality_ratio
FROM (SELECT metro, area_id, CAST(sum(checkins) AS BIGINT) AS checkins,
    sum(checkins) FILTER (isodow(day) < 6) AS weekday_n FROM area GROUP BY ALL)
JOIN (SELECT metro, area_id, k AS busiest FROM (SELECT metro, area_id, isodow(day) - 1 AS k,
    row_number() OVER (PARTITION BY metro, area_id ORDER BY sum(checkins) DESC,
      isodow(day)) AS r FROM area GROUP BY metro, area_id, isodow(day)) WHERE r = 1)
  USING (metro, area_id)
JOIN (SELECT metro, area_id, hour AS peak_hour FROM (SELECT metro, area_id, hour,
    row_number() OVER (PARTITION BY metro, area_id ORDER BY sum(checkins) DESC, hour) AS r
    FROM area GROUP BY metro, area_id, hour) WHERE r = 1) USING (metro, area_id)
JOIN (SELECT metro, area_id, arg_min(m, (-daily_mean, m)) AS peak_month,
    CASE WHEN min(daily_mean) > 0 THEN max(daily_mean) / min(daily_mean) END AS seasonality_ratio
  FROM (SELECT metro, area_id, m, coalesce(n, 0) * 1e0 / days AS daily_mean
    FROM (SELECT DISTINCT metro, area_id FROM area)
    CROSS JOIN (SELECT month(d) AS m, count(*) AS days FROM (SELECT unnest(generate_series(
      DATE '1996-03-01', DATE '2000-02-29', INTERVAL 1 day)) AS d) GROUP BY 1)
    LEFT JOIN (SELECT metro, area_id, month(day) AS m, sum(checkins) AS n FROM area GROUP BY ALL)
      USING (metro, area_id, m)) GROUP BY ALL) USING (metro, area_id)""",
        "weekly_checkins weekday_share weekend_share seasonality_ratio",
        _AREA.format(w="day BETWEEN DATE '1996-03-01' AND DATE '2000-02-29'")),
    "activity_monthly_index": sql("business activity", """
SELECT metro, area_id, month_of_year, calendar_days, coalesce(checkins, 0) AS checkins, total,
  coalesce(checkins, 0) * 1e0 / calendar_days AS daily_mean,
  (coalesce(checkins, 0) * 1e0 / calendar_days) / (total * 1e0 / 1462) * 100 AS monthly_index
FROM (SELECT metro, area_id, CAST(sum(checkins) AS BIGINT) AS total FROM area GROUP BY ALL)
CROSS JOIN (SELECT month(d) AS month_of_year, count(*) AS calendar_days FROM (
  SELECT unnest(generate_series(DATE '1996-02-29', DATE '2000-02-29', INTERVAL 1 day)) AS d)
  GROUP BY 1)
LEFT JOIN (SELECT metro, area_id, month(day) AS month_of_year, CAST(sum(checkins) AS BIGINT)
  AS checkins FROM area GROUP BY ALL) USING (metro, area_id, month_of_year)""",
        "daily_mean monthly_index", _AREA_YEARS),
    "activity_annual_share": sql("business activity", """
SELECT metro, area_id, year, coalesce(checkins, 0) AS checkins,
  coalesce(checkins, 0) * 1e0 / city AS share
FROM (SELECT DISTINCT metro, area_id FROM area)
CROSS JOIN (SELECT unnest(range(1996, 2001)) AS year)
LEFT JOIN (SELECT metro, area_id, year(day) AS year, CAST(sum(checkins) AS BIGINT) AS checkins
  FROM area GROUP BY ALL) USING (metro, area_id, year)
LEFT JOIN (SELECT metro, year(day) AS year, sum(checkins) AS city FROM area GROUP BY ALL)
  USING (metro, year)""", "share", _AREA_YEARS),
    "activity_weekly_series": sql("business activity", """
SELECT metro, area_id, week, coalesce(checkins, 0) AS checkins
FROM (SELECT DISTINCT metro, area_id FROM area)
CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2000-03-06', DATE '2001-03-31',
  INTERVAL 7 day)) AS DATE) AS week)
LEFT JOIN (SELECT metro, area_id, CAST(date_trunc('week', day) AS DATE) AS week,
  CAST(sum(checkins) AS BIGINT) AS checkins FROM area GROUP BY ALL)
USING (metro, area_id, week)""", ctes=_AREA.format(w=f"day BETWEEN {BETWEEN['months']}")),
    "activity_known_day_totals": sql("business activity", """
SELECT metro, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(k) AS BIGINT) AS checkins,
  count(k) AS known_days, """ + ", ".join(
        f"CAST(sum(k) FILTER (isodow(day) = {i}) AS BIGINT) AS {n}"
        for i, n in enumerate("mon tue wed thu fri sat sun".split(), 1)) + """
FROM (SELECT metro, day, CASE WHEN day <= DATE '2001-03-31' THEN coalesce(n, 0) END AS k
  FROM (SELECT DISTINCT metro FROM daily) CROSS JOIN (SELECT CAST(unnest(generate_series(
    DATE '2000-03-10', DATE '2001-06-30', INTERVAL 1 day)) AS DATE) AS day)
  LEFT JOIN daily USING (metro, day)) GROUP BY ALL""", ctes="""daily AS (
  SELECT metro, day, sum(n) AS n FROM activity JOIN business USING (business_id)
  WHERE day BETWEEN DATE '2000-03-10' AND DATE '2001-06-30' GROUP BY ALL)"""),
    "activity_year_over_year": sql("business activity", """
SELECT metro, area_id, current, previous,
  CASE WHEN previous > 0 THEN ((current / 387e0) / (previous / 387e0) - 1) * 100 END AS yoy_percent
FROM (SELECT metro, area_id,
    CAST(coalesce(sum(checkins) FILTER (day BETWEEN DATE '2000-03-10' AND DATE '2001-03-31'), 0)
      AS BIGINT) AS current,
    CAST(coalesce(sum(checkins) FILTER (day BETWEEN DATE '1999-03-10' AND DATE '2000-03-31'), 0)
      AS BIGINT) AS previous FROM area GROUP BY ALL)""".replace(
        "previous / 387e0", "previous / 388e0"), "yoy_percent", _AREA.format(
        w="(day BETWEEN DATE '2000-03-10' AND DATE '2001-03-31'"
          " OR day BETWEEN DATE '1999-03-10' AND DATE '2000-03-31')")),
    "calendar_rules": sql("activity", """SELECT day, CAST(day - INTERVAL 1 year AS DATE)
    AS year_back, isodow(day) - 1 AS weekday, CAST(date_trunc('month', day) AS DATE) AS month,
  day(last_day(day)) AS month_days,
  CAST(date_trunc('month', day) + INTERVAL 1 month AS DATE) AS next_month,
  (month(day) - 1) * 7 + isodow(day) - 1 AS cell,
  greatest(0, least(day + 400, DATE '2001-03-31') - greatest(day, DATE '1995-06-01') + 1)
    AS covered_days,
  CASE WHEN DATE '2000-02-29' - day < 90 THEN 'week' WHEN DATE '2000-02-29' - day > 730 THEN 'year'
    ELSE 'month' END AS grain
  FROM (SELECT DISTINCT day FROM activity)"""),
    "calendar_presets": sql("activity", """
SELECT business_id, preset, CASE WHEN kind = 'last' THEN greatest(a, z - n + 1)
    WHEN kind = 'all' THEN a WHEN kind = 'future' THEN z + 1 ELSE greatest(a, z - 29) END
    AS from_date, CASE WHEN kind IN ('last', 'all') THEN z ELSE z + 30 END AS to_date
FROM (SELECT business_id, min(day) AS a, max(day) AS z FROM activity GROUP BY 1)
CROSS JOIN (VALUES ('Recorded activity overview', 'last', 365),
  ('Latest recorded 7 days', 'last', 7), ('Latest recorded 30 days', 'last', 30),
  ('Latest recorded 90 days', 'last', 90), ('Seasonal patterns', 'all', 0),
  ('Forecast period preview', 'future', 0),
  ('History → forecast preview', 'both', 0)) AS p(preset, kind, n)"""),
    "category_summary": sql("business activity", "SELECT * FROM cat",
        "weekly_per_business daily_per_business top_share median_weekly median_daily",
        summary_sql("months") + ", " + _TAGS),
    "category_rank_checkins": _cat_rank("checkins"),
    "category_rank_per_business": _cat_rank("daily_per_business"),
    "category_rank_listed": _cat_rank("businesses"),
    "category_table": sql("business activity", """SELECT metro, row_number() OVER (
    PARTITION BY metro ORDER BY checkins DESC, tag) AS rank, tag, checkins, businesses,
  active_businesses, round(top_share * 100, 1) AS largest_share_pct,
  CASE WHEN businesses < 5 THEN 'Few businesses (<5)' WHEN checkins < 20
    THEN 'Few check-ins (<20)' ELSE 'Descriptive comparison' END AS data_note
  FROM cat WHERE businesses >= 5""", "largest_share_pct", summary_sql("months") + ", " + _TAGS),
    "category_tags": sql("business", "SELECT DISTINCT metro, unnest(categories) AS tag FROM business"),
    "category_co_tags": sql("business", """SELECT DISTINCT metro, parent, tag,
  'Source categories' AS facet FROM (SELECT metro, parent, unnest(categories) AS tag
  FROM business) WHERE tag <> parent"""),
    "business_competitors": sql("business activity", """SELECT metro, parent, row_number() OVER (
    PARTITION BY metro, parent ORDER BY checkins DESC, business_id) AS position, name,
  postal_code, checkins, round(daily_checkins, 3) AS daily_checkins, stars, review_count,
  CASE WHEN is_open THEN 'Open' ELSE 'Closed' END AS status,
  array_to_string(categories, ', ') AS source_categories, business_id FROM summary""",
        "daily_checkins", summary_sql("months")),
    "business_competitors_uncovered": sql("business", """SELECT metro, parent, row_number() OVER (
    PARTITION BY metro, parent ORDER BY name, business_id) AS position, name, postal_code,
  CAST(NULL AS BIGINT) AS checkins, CAST(NULL AS DOUBLE) AS daily_checkins, stars, review_count,
  CASE WHEN is_open THEN 'Open' ELSE 'Closed' END AS status,
  array_to_string(categories, ', ') AS source_categories, business_id FROM business"""),
    "business_comparison_matrix": sql("business activity", """SELECT metro, parent, line, metric,
  max(value) FILTER (rank = 1) AS first, max(value) FILTER (rank = 2) AS second,
  max(value) FILTER (rank = 3) AS third, max(value) FILTER (rank = 4) AS fourth
  FROM cells GROUP BY ALL""", ctes=summary_sql("months") + """, ranked AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY metro, parent ORDER BY checkins DESC, business_id)
  AS rank FROM summary) WHERE rank <= 4), cells AS (""" + _MATRIX + ")"),
    "business_top_listings": sql("business activity", """SELECT business_id, name, checkins
  FROM summary ORDER BY checkins DESC, business_id LIMIT 20""", ctes=summary_sql("months")),
    "business_name_search": sql("business", """SELECT business_id, name FROM business
  WHERE contains(lower(name), '#00000007') OR contains(CAST(business_id AS VARCHAR), '#00000007')"""),
    "calendar_projected_interval": sql("activity", """SELECT business_id, 31 AS recorded_days,
  91 AS projected_days, greatest(0, DATE '2001-06-30' - greatest(max(day), DATE '2001-02-28'))
    AS days_after_last FROM activity GROUP BY 1"""),
}
