"""Domain relations derived from the driver tables, once for Spark and once as SQL text.

businesses <- customer, nation, region; activity <- orders; station reports <- lineitem;
reviews <- lineitem, orders; hourly samples and the dataset registry <- events.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.functions.dates import Span

COVERAGE = Span(date(1995, 6, 1), date(2001, 3, 31))
WEATHER_COVERAGE = Span(date(1995, 1, 2), date(2001, 11, 4))
MONTHS = Span(date(2000, 3, 10), date(2001, 6, 30))  # monthly bins, ends after coverage
YEARS = Span(date(1996, 2, 29), date(2000, 2, 29))  # yearly bins, wholly covered
WEEKS = Span(date(2000, 1, 5), date(2000, 3, 20))  # weekly bins, wholly covered
FUTURE = Span(date(2001, 3, 1), date(2001, 6, 30))  # reaches past coverage
CO_TAG = "Balance 1"
RADIUS_KM = 3.0
SCOPE = ["metro", "parent"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    located = ~bal.between(-800, -600)
    latitude = (
        F.lit(30.0) + F.col("r_regionkey") * F.lit(2.0) + (F.col("n_nationkey") % 5) * F.lit(0.05)
        + ((key * 7919) % 1000) * F.lit(1e-4)
    )
    longitude = F.lit(-80.0) - F.col("r_regionkey") + ((key * 104729) % 1000) * F.lit(1e-4)
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            key.alias("business_id"),
            F.col("c_name").alias("name"),
            F.col("r_name").alias("metro"),
            F.when(bal < -800, None).otherwise(F.col("n_nationkey") + 1).alias("area_id"),
            F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("postal_code"),
            F.when(located, latitude).alias("latitude"),
            F.when(located, longitude).alias("longitude"),
            F.array(
                F.col("c_mktsegment"),
                F.concat(F.lit("Balance "), F.floor(bal / F.lit(2500.0)).cast("string")),
                F.col("n_name"),
            ).alias("categories"),
            F.col("c_mktsegment").alias("parent"),
            F.when(bal >= 0, F.lit(1.0) + (key % 9) * F.lit(0.5)).alias("stars"),
            ((key * 37) % 500).alias("review_count"),
            (key % 4 != 0).alias("is_open"),
            F.when(bal < 9000, F.concat(F.lit("S"), (key % 10).cast("string"))).alias("station_id"),
        )
    )


BUSINESS_SQL = """business AS (
  SELECT c_custkey AS business_id, c_name AS name, r_name AS metro,
    CASE WHEN c_acctbal < -800 THEN NULL ELSE n_nationkey + 1 END AS area_id,
    lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS postal_code,
    CASE WHEN c_acctbal BETWEEN -800 AND -600 THEN NULL ELSE
      3e1 + r_regionkey * 2e0 + (n_nationkey % 5) * 5e-2 + ((c_custkey * 7919) % 1000) * 1e-4
    END AS latitude,
    CASE WHEN c_acctbal BETWEEN -800 AND -600 THEN NULL ELSE
      -8e1 - r_regionkey + ((c_custkey * 104729) % 1000) * 1e-4 END AS longitude,
    [c_mktsegment, 'Balance ' || CAST(CAST(floor(c_acctbal / 25e2) AS BIGINT) AS VARCHAR), n_name]
      AS categories,
    c_mktsegment AS parent,
    CASE WHEN c_acctbal >= 0 THEN 1e0 + (c_custkey % 9) * 5e-1 END AS stars,
    (c_custkey * 37) % 500 AS review_count,
    c_custkey % 4 <> 0 AS is_open,
    CASE WHEN c_acctbal < 9000 THEN 'S' || CAST(c_custkey % 10 AS VARCHAR) END AS station_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def within(rows: DataFrame, stamp: str, span: Span | None) -> DataFrame:
    """Half-open bound on the stored timestamp, which reaches the scan; a cast to date would not."""
    if span is None:
        return rows
    end = date.fromordinal(span.end.toordinal() + 1)
    bound = lambda d: F.lit(datetime(d.year, d.month, d.day)).cast("timestamp_ntz")
    return rows.where((F.col(stamp) >= bound(span.start)) & (F.col(stamp) < bound(end)))


def activity(spark: SparkSession, sf_dir: str, span: Span | None = None) -> DataFrame:
    """Sparse hourly counts per business (order date, hour label from the order key)."""
    return (
        within(table(spark, sf_dir, "orders"), "o_orderdate", span)
        .groupBy(
            F.col("o_custkey").alias("business_id"),
            F.col("o_orderdate").cast("date").alias("day"),
            (F.col("o_orderkey") % 24).cast("int").alias("hour"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


ACTIVITY_SQL = """activity AS (
  SELECT o_custkey AS business_id, CAST(o_orderdate AS DATE) AS day,
    CAST(o_orderkey % 24 AS INTEGER) AS hour, count(*) AS n
  FROM orders GROUP BY ALL)"""


def station_reports(spark: SparkSession, sf_dir: str, span: Span | None = None) -> DataFrame:
    """Long native reports: one row per (station, day, variable)."""
    li = within(table(spark, sf_dir, "lineitem"), "l_shipdate", span).select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string")).alias("station_id"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.element_at(
            F.array(F.lit("tmax"), F.lit("tmin"), F.lit("pcpn")),
            (F.col("l_linenumber") % 3 + 1).cast("int"),
        ).alias("variable"),
        F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus")
        .alias("line"),
    )
    first = li.groupBy("station_id", "day", "variable").agg(F.min("line").alias("line"))
    q, d, tax = F.col("line.l_quantity"), F.col("line.l_discount"), F.col("line.l_tax")
    rain = F.col("variable") == "pcpn"
    native = (
        F.when(rain, tax * F.lit(5.0))
        .when(F.col("variable") == "tmax", q + F.lit(60.0))
        .otherwise(q + F.lit(20.0))
    )
    missing = d.between(0.045, 0.055)
    trace = rain & (tax < 0.005) & ~missing
    return first.select(
        "station_id", "day", "variable",
        F.when(missing, None).when(d.between(0.035, 0.045), F.lit(-999.0))
        .when(trace, F.lit(0.0)).otherwise(native).alias("value"),
        F.when((F.col("line.l_linestatus") == "F") & d.between(0.055, 0.065), F.lit("other"))
        .otherwise(F.when(rain, F.lit("inch")).otherwise(F.lit("degreeF"))).alias("unit"),
        F.when(missing, F.lit("M")).when(trace, F.lit("T")).otherwise(F.lit("")).alias("raw_value"),
        F.when(d > 0.095, F.lit("A")).when(missing, F.lit("M")).when(trace, F.lit("T"))
        .otherwise(F.lit("")).alias("flag"),
        trace.alias("is_trace"),
    )


REPORTS_SQL = """report_line AS (
  SELECT 'S' || CAST(l_suppkey % 10 AS VARCHAR) AS station_id, CAST(l_shipdate AS DATE) AS day,
    ['tmax', 'tmin', 'pcpn'][CAST(l_linenumber % 3 + 1 AS INTEGER)] AS variable,
    min({'k': l_orderkey, 'n': l_linenumber, 'q': l_quantity, 'd': l_discount, 't': l_tax,
         's': l_linestatus}) AS line
  FROM lineitem GROUP BY ALL),
report_flag AS (
  SELECT *, line.d BETWEEN 45e-3 AND 55e-3 AS missing,
    variable = 'pcpn' AND line.t < 5e-3 AND NOT (line.d BETWEEN 45e-3 AND 55e-3) AS is_trace
  FROM report_line),
report AS (
  SELECT station_id, day, variable,
    CASE WHEN missing THEN NULL WHEN line.d BETWEEN 35e-3 AND 45e-3 THEN -999e0
      WHEN is_trace THEN 0e0 WHEN variable = 'pcpn' THEN line.t * 5e0
      WHEN variable = 'tmax' THEN line.q + 6e1 ELSE line.q + 2e1 END AS value,
    CASE WHEN line.s = 'F' AND line.d BETWEEN 55e-3 AND 65e-3 THEN 'other'
      WHEN variable = 'pcpn' THEN 'inch' ELSE 'degreeF' END AS unit,
    CASE WHEN missing THEN 'M' WHEN is_trace THEN 'T' ELSE '' END AS raw_value,
    CASE WHEN line.d > 95e-3 THEN 'A' WHEN missing THEN 'M' WHEN is_trace THEN 'T' ELSE '' END
      AS flag,
    is_trace
  FROM report_flag)"""

ACCEPTED_SQL = REPORTS_SQL + """,
accepted AS (
  SELECT * FROM (
    SELECT station_id, day, variable,
      CASE WHEN flag <> '' AND NOT (variable = 'pcpn' AND flag = 'T') THEN NULL
        WHEN unit <> CASE WHEN variable = 'pcpn' THEN 'inch' ELSE 'degreeF' END THEN NULL
        WHEN variable = 'pcpn' AND (flag = 'T' OR raw_value = 'T' OR is_trace) THEN 0e0
        WHEN value IS NULL OR value IN (-999e0, -9999e0) THEN NULL
        WHEN variable = 'pcpn' THEN CASE WHEN value >= 0 THEN value * 254e-1 END
        ELSE (value - 32e0) * 5e0 / 9e0 END AS value
    FROM report) WHERE value IS NOT NULL),
station_wide AS (
  SELECT station_id, day, max(CASE WHEN variable = 'tmin' THEN value END) AS tmin0,
    max(CASE WHEN variable = 'tmax' THEN value END) AS tmax0,
    max(CASE WHEN variable = 'pcpn' THEN value END) AS pcpn
  FROM accepted GROUP BY ALL),
station_day AS (
  SELECT station_id, day, CASE WHEN tmin0 > tmax0 THEN NULL ELSE tmin0 END AS tmin,
    CASE WHEN tmin0 > tmax0 THEN NULL ELSE tmax0 END AS tmax, pcpn
  FROM station_wide
  WHERE pcpn IS NOT NULL OR NOT (tmin0 IS NOT NULL AND tmax0 IS NOT NULL AND tmin0 > tmax0))"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dated reviews: one per order line."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("review_id"),
        F.col("o_custkey").alias("business_id"),
        (F.col("l_linenumber") % 5 + 1).cast("int").alias("stars"),
        F.col("l_shipdate").cast("date").alias("day"),
    )


def review_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star sum and count per business-day; lines collapse per order before the join."""
    li = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", F.col("l_shipdate").cast("date").alias("day"))
        .agg(F.sum(F.col("l_linenumber") % 5 + 1).alias("star_sum"),
             F.count(F.lit(1)).alias("review_count"))
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("o_custkey").alias("business_id"), "day")
        .agg(F.sum("star_sum").cast("long").alias("star_sum"),
             F.sum("review_count").cast("long").alias("review_count"))
    )


REVIEWS_SQL = """review_day AS (
  SELECT o_custkey AS business_id, CAST(l_shipdate AS DATE) AS day,
    CAST(sum(l_linenumber % 5 + 1) AS BIGINT) AS star_sum, count(*) AS review_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import registry rows with JSON metadata; the import key repeats many times."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.to_json(F.struct(
            F.col("event_type").alias("import_key"),
            F.when(F.col("value") >= 5, "complete").otherwise("failed").alias("status"),
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("import_revision"),
            F.concat(F.lit("r"), (F.col("event_id") - F.col("k") % 3).cast("string"))
            .alias("business_import_revision"),
            F.when(F.col("k") % 2 == 0, "assumed_source_local").otherwise("unknown")
            .alias("timestamp_policy"),
            F.struct(
                F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("start_date"),
                F.date_format(F.date_add(F.to_date("ts"), F.col("k") - 5), "yyyy-MM-dd")
                .alias("end_date"),
            ).alias("coverage"),
        )).alias("metadata"),
    )


REGISTRY_SQL = """reg AS (
  SELECT event_id AS id, event_type AS import_key,
    CASE WHEN value >= 5 THEN 'complete' ELSE 'failed' END AS status,
    'r' || CAST(event_id AS VARCHAR) AS import_revision,
    'r' || CAST(event_id - CAST(props->>'$.k' AS INTEGER) % 3 AS VARCHAR)
      AS business_import_revision,
    CASE WHEN CAST(props->>'$.k' AS INTEGER) % 2 = 0 THEN 'assumed_source_local'
      ELSE 'unknown' END AS timestamp_policy,
    CAST(ts AS DATE) AS start_date,
    CAST(ts AS DATE) + CAST(CAST(props->>'$.k' AS INTEGER) - 5 AS INTEGER) AS end_date
  FROM events)"""


def lcd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly airport rows as source text, several reports per station-hour."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("STATION"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("DATE"),
        F.when(k < 90, "FM-15").otherwise("FM-16").alias("REPORT_TYPE"),
        F.col("event_id").cast("string").alias("SOURCE"),
        F.when(k < 5, F.lit("")).when(k < 8, F.concat(F.col("event_id").cast("string"), F.lit("s")))
        .otherwise(F.concat((F.col("event_id") % 40 - 5).cast("string"), F.lit(".5")))
        .alias("HourlyDryBulbTemperature"),
        F.when(k < 12, F.lit("T")).when(k < 20, F.lit(" "))
        .otherwise((k - 25).cast("string")).alias("HourlyPrecipitation"),
    )


LCD_SQL = """lcd AS (
  SELECT event_type AS station, ts, CAST(props->>'$.k' AS INTEGER) AS k, event_id,
    CASE WHEN CAST(props->>'$.k' AS INTEGER) < 90 THEN 'FM-15' ELSE 'FM-16' END AS report_type
  FROM events),
lcd_value AS (
  SELECT *, CASE WHEN k < 8 THEN NULL
      ELSE CAST(CAST(event_id % 40 - 5 AS VARCHAR) || '.5' AS DOUBLE) END AS temperature_c,
    CASE WHEN k < 12 THEN 0e0 WHEN k < 20 THEN NULL WHEN k - 25 < 0 THEN NULL
      ELSE CAST(k - 25 AS DOUBLE) END AS precipitation_mm,
    k < 12 AS is_trace
  FROM lcd)"""

PIECES = {
    "business": BUSINESS_SQL, "activity": ACTIVITY_SQL, "report": REPORTS_SQL,
    "station": ACCEPTED_SQL, "review": REVIEWS_SQL, "registry": REGISTRY_SQL, "lcd": LCD_SQL,
}


def sql(pieces: str, body: str, doubles: str = "", ctes: str = "") -> str:
    """Oracle text: named domain pieces, extra CTEs, then the body with doubles rounded."""
    parts = [PIECES[p] for p in pieces.split()] + ([ctes] if ctes else [])
    head = f"WITH {', '.join(parts)} " if parts else ""
    if not doubles:
        return head + body
    rounded = ", ".join(f"round({d}, 6) + 0e0 AS {d}" for d in doubles.split())
    return f"{head}SELECT * REPLACE ({rounded}) FROM ({body}) AS result"


def tidy(df: DataFrame, rounded: Sequence[str] = ()) -> DataFrame:
    """Round doubles as the oracle does (and turn -0.0 into 0.0) but for those rounded already; widen integers to long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind == "double" and f.name not in rounded:
            c = F.round(c, 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
