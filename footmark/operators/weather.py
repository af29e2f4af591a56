"""Station and hourly weather: acceptance, summaries, distributions, bands, association."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import dates
from footmark.functions import weather_values as wv
from footmark.functions.dates import Span
from footmark.operators.ordering import exact_quantiles

#: Parts that the businesses of one station are dealt out to when they meet its days by shuffle.
STATION_PARTS = 8


def accepted(reports: DataFrame) -> DataFrame:
    """Usable long readings (station, day, variable, value)."""
    return reports.select(
        "station_id", "day", "variable", wv.accepted_value().alias("value")
    ).where(F.col("value").isNotNull())


def station_days(reports: DataFrame, span: Span | None = None, unique: bool = False) -> DataFrame:
    """One row per station-day; an incoherent pair keeps neither temperature.

    With ``unique``, as models need it, a second accepted reading of a variable fails the job; it is
    counted in the same aggregation.
    """
    rows = reports if span is None else reports.where(span.holds(F.col("day")))
    wide = accepted(rows).groupBy("station_id", "day").agg(*[
        F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in wv.VARIABLES
    ], F.greatest(*[F.count_if(F.col("variable") == v) for v in wv.VARIABLES]).alias("_most"))
    if unique:
        wide = wide.where(F.when(F.col("_most") <= 1, F.lit(True)).otherwise(
            F.raise_error(F.lit("repeated accepted station reading")).cast("boolean")))
    incoherent = F.coalesce(F.col("tmin") > F.col("tmax"), F.lit(False))
    return wide.select(
        "station_id", "day",
        F.when(~incoherent, F.col("tmin")).alias("tmin"),
        F.when(~incoherent, F.col("tmax")).alias("tmax"),
        "pcpn",
    ).where(F.coalesce("tmin", "tmax", "pcpn").isNotNull())


def complete_days(days: DataFrame) -> DataFrame:
    return days.na.drop(subset=list(wv.VARIABLES))


def duplicate_readings(reports: DataFrame) -> DataFrame:
    """Keys with more than one accepted reading: an error for the modelling panel."""
    return accepted(reports).groupBy("station_id", "day", "variable").count().where("count > 1")


def _summary_columns() -> list[Column]:
    return [
        F.count("tmin").alias("tmin_days"), F.count("tmax").alias("tmax_days"),
        F.count("pcpn").alias("pcpn_days"),
        F.avg("tmin").alias("mean_tmin"), F.avg("tmax").alias("mean_tmax"),
        F.sum("pcpn").alias("pcpn_sum"), F.max("day").alias("latest_day"),
    ]


def station_summary(days: DataFrame, stations: DataFrame, span: Span) -> DataFrame:
    """Every mapped station; without readings counts are 0 and statistics null."""
    stats = days.where(span.holds(F.col("day"))).groupBy("station_id").agg(*_summary_columns())
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("tmin_days", "tmax_days", "pcpn_days")}
    return (
        stations.select("station_id").distinct().join(stats, "station_id", "left")
        .withColumns(counts).withColumn("selected_days", F.lit(span.days))
    )


def station_months(days: DataFrame, span: Span) -> DataFrame:
    """Same per calendar month clipped to the span; months without readings are absent."""
    month = dates.month_start(F.col("day"))
    stats = days.where(span.holds(F.col("day"))).groupBy(
        "station_id", month.alias("month")).agg(*_summary_columns())
    return stats.withColumn(
        "selected_days",
        F.datediff(F.least(F.last_day("month"), F.lit(span.end)),
                   F.greatest("month", F.lit(span.start))) + 1)


def mapped_stations(businesses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Stations used by scoped businesses, each once."""
    return businesses.where(F.col("station_id").isNotNull()).select(*scope, "station_id").distinct()


def long_samples(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    return days.select(*keys, "day", F.inline(F.array(*[
        F.struct(F.lit(v).alias("series"), F.col(v).alias("value")) for v in wv.VARIABLES
    ]))).where(wv.finite(F.col("value")) & ((F.col("series") != "pcpn") | (F.col("value") >= 0)))


def pooled_samples(days: DataFrame, businesses: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Each station-day once per scope, never weighted by linked businesses."""
    return long_samples(
        days.join(mapped_stations(businesses, scope), "station_id"), [*scope, "station_id"])


def box_stats(
    samples: DataFrame, keys: Sequence[str], span: Span, hourly: bool = False,
    pooled: bool = False, combine_temperature: bool = False,
) -> DataFrame:
    """Distribution per calendar period.

    A station-period holds at most one reading per day (24 when hourly), so the exact
    ``percentile`` aggregate is bounded. Pooled scopes have no such bound and use distributed
    order statistics. The observation-centred midpoint clips to the reports that exist.
    """
    kind = dates.grain(span)
    series = F.when(F.col("series").isin("tmin", "tmax"), "Temperature").otherwise(
        F.col("series")) if combine_temperature else F.col("series")
    rows = samples.where(span.holds(F.col("day"))).select(
        *keys, series.alias("series"), dates.bin_first(F.col("day"), kind).alias("first"),
        "day", F.when(wv.finite(F.col("value")), F.col("value")).alias("value"))
    group = [*keys, "series", "first"]
    v, seen = F.col("value"), F.when(F.col("value").isNotNull(), F.col("day"))
    stats = rows.groupBy(*group).agg(
        F.count(v).alias("readings"), F.countDistinct(seen).alias("observed_days"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"),
        F.min(seen).alias("first_report"), F.max(seen).alias("last_report"),
        F.min("day").alias("_a"), F.max("day").alias("_z"),
        *([] if pooled else [F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("_q")]),
    )
    if pooled:
        quartiles = exact_quantiles(rows, group, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
        stats = stats.join(quartiles, group, "left")
    else:
        stats = stats.withColumns({
            n: F.col("_q")[i] for i, n in enumerate(("q1", "median", "q3"))})
    window = dates.period_columns(F.col("first"), span)
    lower = F.greatest(window["period_start"], F.coalesce("first_report", "_a"))
    upper = F.least(window["period_end"], F.coalesce("last_report", "_z"))
    centred = F.timestamp_seconds(
        F.unix_date(lower).cast("long") * 86400 + F.datediff(upper, lower) * 43200
    ).cast("timestamp_ntz")
    out = stats.withColumns({**window, "observed_midpoint": centred})
    columns = [*keys, "series", "period", "period_start", "period_end", "midpoint",
               "observed_midpoint", "readings", "observed_days", "minimum", "q1", "median", "q3",
               "maximum", "mean", "first_report", "last_report"]
    if hourly:
        out = out.withColumn("expected", F.col("covered_days") * 24).withColumn(
            "coverage_pct", F.lit(100.0) * F.col("readings") / F.col("expected"))
        columns += ["expected", "coverage_pct"]
    return out.select(*columns)


def box_display_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per box with a finite representative value when the box has one."""
    return rows.groupBy(*keys).agg(
        F.min_by("value", F.struct(~wv.finite(F.col("value")), F.col("day"), F.col("value")))
        .alias("representative"), F.count(F.lit(1)).alias("samples"))


def business_weather_days(
    daily: DataFrame, businesses: DataFrame, days: DataFrame, span: Span, coverage: Span
) -> DataFrame:
    """Covered days per business: zero activity is real, missing weather stays missing.

    A business meets its activity and its station's weather as one row each; its days are written out after
    the last join, so no table of businesses and days is shuffled. Both arrays are bounded by the covered days.
    """
    covered = span.intersect(coverage)
    if covered is None:
        raise ValueError("The selected dates lie outside coverage.")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast(daily.schema["checkins"].dataType).alias("n"),
                             F.lit(covered.days - 1).alias("to")))
    part = F.pmod(F.xxhash64("business_id"), F.lit(STATION_PARTS)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(STATION_PARTS - 1)))
    stretches = (
        # Dealt out anew: the days are written where these rows lie, and few files may hold them all.
        businesses.select("business_id", "station_id", part.alias("_part")).repartition("business_id")
        .join(_stretches(daily, covered), "business_id", "left")
        .join(_day_arrays(days, covered).withColumn("_part", parts), ["station_id", "_part"], "left")
        .select("business_id", "station_id", *wv.VARIABLES, F.inline(F.coalesce("stretches", whole)))
    )
    at = F.col("_i")
    return (
        stretches.withColumn("_i", F.explode(F.sequence("at", "to")))
        .select("station_id", F.date_add(F.lit(covered.start), at).alias("day"), "business_id",
                F.when(at == F.col("at"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("checkins"),
                *[F.get(v, at).alias(v) for v in wv.VARIABLES])
        .withColumn("weather_available", F.col("tmin").isNotNull() & F.col("tmax").isNotNull()
                    & F.col("pcpn").isNotNull())
    )


def _stretches(daily: DataFrame, covered: Span) -> DataFrame:
    """(business_id, stretches): every active day, counted from the first covered one, with its check-ins and the
    last of the zero days that follow it; zero days ahead of the first active one are a stretch without a count."""
    entries = F.array_sort(F.collect_list(F.struct(
        F.datediff("day", F.lit(covered.start)).alias("at"), F.col("checkins").alias("n"))))
    until = lambda i: F.coalesce(F.try_element_at("e", i)["at"], F.lit(covered.days)) - 1
    nothing = F.lit(None).cast(daily.schema["checkins"].dataType)
    ahead = F.filter(F.array(F.struct(F.lit(0).alias("at"), nothing.alias("n"), until(F.lit(1)).alias("to"))),
                     lambda x: x["to"] >= 0)
    return daily.where(covered.holds(F.col("day"))).groupBy("business_id").agg(entries.alias("e")).select(
        "business_id", F.concat(ahead, F.transform("e", lambda x, i: F.struct(
            x["at"].alias("at"), x["n"].alias("n"), F.greatest(x["at"], until(i + 2)).alias("to")))).alias("stretches"))


def _day_arrays(days: DataFrame, covered: Span) -> DataFrame:
    """One row per station with an array of each variable, one place per covered day, null where it is missing."""
    readings = F.array_sort(F.collect_list(F.struct(
        F.datediff("day", F.lit(covered.start)).alias("at"), F.struct(*wv.VARIABLES).alias("v"))))
    packed = days.where(covered.holds(F.col("day"))).groupBy("station_id").agg(readings.alias("e"))
    after = lambda i: F.coalesce(F.try_element_at("e", i)["at"], F.lit(covered.days))
    gap = lambda n: F.array_repeat(F.struct(*[F.lit(None).cast(days.schema[v].dataType).alias(v) for v in wv.VARIABLES]), n)
    dense = packed.withColumn("d", F.concat(gap(after(F.lit(1))), F.flatten(F.transform(
        "e", lambda x, i: F.concat(F.array(x["v"]), gap(after(i + 2) - x["at"] - 1))))))
    once = F.when(F.size("d") == covered.days, F.lit(True)).otherwise(
        F.raise_error(F.lit("repeated station day")).cast("boolean"))
    return dense.where(once).select("station_id", *[F.col("d")[v].alias(v) for v in wv.VARIABLES])


def _active_days(daily: DataFrame, businesses: DataFrame) -> DataFrame:
    return daily.where(F.col("checkins") > 0).join(
        businesses.where(F.col("station_id").isNotNull()).select("business_id", "station_id"),
        "business_id")


def band_table(
    daily: DataFrame, businesses: DataFrame, days: DataFrame, span: Span, variable: str
) -> DataFrame:
    """Check-ins by weather band per business, zero days included, empty bands kept.

    Only active days are joined. The number of days a band occurred is a station fact, so zero
    days are that number minus the active ones, and quartiles index past the zeros. The active
    counts of one business and band are at most the days of the span.
    """
    rows = days.where(span.holds(F.col("day"))).withColumn(
        "band_index", wv.band_index(F.col(variable), variable)).where("band_index IS NOT NULL")
    per_station = rows.groupBy("station_id", "band_index").agg(
        F.count(F.lit(1)).alias("day_count"))
    active = (
        _active_days(daily, businesses).join(
            rows.select("station_id", "day", "band_index"), ["station_id", "day"])
        .groupBy("business_id", "band_index")
        .agg(F.array_sort(F.collect_list("checkins")).alias("active"))
    )
    grid = businesses.select("business_id", "station_id", F.explode(
        F.sequence(F.lit(0), F.lit(len(wv.bands(variable)) - 1))).alias("band_index"))
    joined = grid.join(per_station, ["station_id", "band_index"], "left").join(
        active, ["business_id", "band_index"], "left")
    n = F.coalesce("day_count", F.lit(0))
    zeros = n - F.coalesce(F.size("active"), F.lit(0))

    def at(position: Column) -> Column:
        index = position - zeros
        return F.when(index < 0, F.lit(0)).otherwise(
            F.try_element_at("active", (index + 1).cast("int")))

    def quantile(p: float) -> Column:
        where = (n - 1) * F.lit(p)
        low = at(F.floor(where))
        return F.when(n > 0, low + (at(F.ceil(where)) - low) * (where - F.floor(where)))

    return joined.select(
        "business_id", F.lit(variable).alias("variable"), "band_index",
        wv.band_label(F.col("band_index"), variable).alias("band"),
        n.alias("day_count"), zeros.alias("zero_days"),
        quantile(0.5).alias("median"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"),
        F.when(n > 0, at(F.lit(0))).alias("minimum"), F.when(n > 0, at(n - 1)).alias("maximum"),
    )


def correlation(
    daily: DataFrame, businesses: DataFrame, days: DataFrame, span: Span, variable: str
) -> DataFrame:
    """Pearson r of activity and one weather variable per business over covered days.

    Zero-activity days add nothing to the activity sums, so they enter through the station's
    own sums. Needs three pairs and variation on both sides; clamped to [-1, 1].
    """
    x, y = F.col(variable), F.col("checkins")
    rows = days.where(span.holds(F.col("day")) & x.isNotNull()).select("station_id", "day", variable)
    station = rows.groupBy("station_id").agg(
        F.count(x).alias("n"), F.avg(x).alias("mx"), F.var_pop(x).alias("vx"),
        F.min(x).alias("x0"), F.max(x).alias("x1"))
    active = (
        _active_days(daily, businesses).join(rows, ["station_id", "day"])
        .join(station.select("station_id", "mx"), "station_id")
        .groupBy("business_id")
        .agg(F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
             F.sum((x - F.col("mx")) * y).alias("sxy"), F.count(y).alias("active"),
             F.min(y).alias("y0"), F.max(y).alias("y1"))
    )
    joined = businesses.select("business_id", "station_id").join(station, "station_id", "left").join(
        active, "business_id", "left")
    n = F.coalesce("n", F.lit(0))
    varies = (F.col("x0") != F.col("x1")) & F.col("active").isNotNull() & (
        (F.col("active") < n) | (F.col("y0") != F.col("y1")))
    vy = F.col("syy") / n - (F.col("sy") / n) * (F.col("sy") / n)
    r = F.col("sxy") / n / F.sqrt(F.col("vx") * vy)
    return joined.select(
        "business_id", F.lit(span.days).alias("total_days"), n.alias("paired_days"),
        (F.lit(span.days) - n).alias("missing_days"),
        F.when((n >= 3) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("pearson_r"))


def business_layer(
    businesses: DataFrame, summary: DataFrame, measure: str, span: Span
) -> DataFrame:
    """Business to station summary, accepted only for the same period length."""
    value, valid = {
        "temp_max": ("mean_tmax", "tmax_days"), "temp_min": ("mean_tmin", "tmin_days"),
        "precipitation": ("pcpn_sum", "pcpn_days"),
    }[measure]
    v = F.col(value)
    usable = (
        (F.col("selected_days") == span.days) & F.col(valid).between(1, span.days) & wv.finite(v)
    )
    if measure == "precipitation":
        usable = usable & (v >= 0)
    ok = summary.where(usable).select(
        "station_id", v.alias("weather_value"), F.col(valid).alias("weather_days"))
    return businesses.join(ok, "station_id", "left").withColumn(
        "weather_days", F.coalesce("weather_days", F.lit(0)))


def area_weather(layer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Business-weighted station weather per area.

    Businesses first collapse to station weights, so an area is a few station rows; rainfall
    averages station totals and never sums over businesses.
    """
    weights = layer.where(F.col("area_id").isNotNull()).groupBy(*keys, "station_id").agg(
        F.count(F.lit(1)).alias("w"), F.first("weather_value").alias("v"),
        F.first("weather_days").alias("d"))
    used = F.when(F.col("v").isNotNull(), F.col("w"))
    return weights.groupBy(*keys).agg(
        F.try_divide(F.sum(used * F.col("v")), F.sum(used)).alias("value"),
        F.coalesce(F.sum(used), F.lit(0)).alias("usable_businesses"),
        F.sum("w").alias("total_businesses"),
        F.try_divide(F.sum(used * F.col("d")), F.sum(used)).alias("valid_days"),
        F.count(used).alias("station_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(used.isNotNull(), F.col("station_id")))),
                     "; ").alias("stations"),
    )


def dominant_station(businesses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent station per key, ties to the smallest id, with its share."""
    counts = businesses.groupBy(*keys, "station_id").agg(F.count(F.lit(1)).alias("n"))
    linked = F.when(F.col("station_id").isNotNull(), F.struct(-F.col("n"), F.col("station_id")))
    return counts.groupBy(*keys).agg(
        F.min_by("station_id", linked).alias("station_id"),
        F.coalesce(F.max(F.when(F.col("station_id").isNotNull(), F.col("n"))), F.lit(0))
        .alias("station_businesses"),
        F.sum("n").alias("businesses"),
    ).withColumn("share_pct", F.col("station_businesses") / F.col("businesses") * 100)


def latest_hourly(rows: DataFrame, report_type: str = "FM-15") -> DataFrame:
    """Latest routine report per station-hour; equal times are settled by row content.

    ``max_by`` combines on the map side, so a chatty station needs no sort.
    """
    observed = F.col("DATE").try_cast("timestamp_ntz")
    content = F.to_json(F.struct(*sorted(rows.columns)))
    typed = rows.where(F.trim("REPORT_TYPE") == report_type).select(
        F.trim("STATION").alias("station_id"),
        F.when(observed.isNotNull(), observed).otherwise(
            F.raise_error(F.lit("invalid report timestamp")).cast("timestamp_ntz"))
        .alias("observed_at"),
        F.struct(
            wv.hourly_value(F.col("HourlyDryBulbTemperature")).alias("temperature_c"),
            wv.hourly_value(F.col("HourlyPrecipitation"), True).alias("precipitation_mm"),
            F.coalesce(F.trim("HourlyPrecipitation") == "T", F.lit(False)).alias("is_trace"),
            F.col("SOURCE").alias("source_code"),
        ).alias("reading"), content.alias("content"))
    best = typed.groupBy("station_id", F.date_trunc("hour", "observed_at").alias("hour")).agg(
        F.max(F.struct("observed_at", "content", "reading")).alias("best"))
    return best.select("station_id", "hour", "best.observed_at", "best.reading.*")


def completed_hourly(hourly: DataFrame, registry: DataFrame, import_key: str) -> DataFrame:
    """Hourly rows whose ``dataset_id`` is a completed registry row of the import; others stay out."""
    get = lambda p: F.get_json_object("metadata", p)
    done = registry.where((get("$.status") == "complete") & (get("$.import_key") == import_key)).select(
        F.col("id").alias("dataset_id"))
    return hourly.join(done, "dataset_id", "left_semi")


def hourly_summary(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("observations"), F.min("observed_at").alias("first_at"),
        F.max("observed_at").alias("last_at"),
        F.count_if(F.col("temperature_c").isNull()).alias("missing_temperature"),
        F.count_if(F.col("precipitation_mm").isNull()).alias("missing_precipitation"),
        F.count_if("is_trace").alias("traces"))


def hourly_chart_rows(hourly: DataFrame, offset_hours: Column, metric: str) -> DataFrame:
    """Finite samples with the instant of the fixed local standard clock."""
    value = F.col("temperature_c" if metric == "temperature" else "precipitation_mm")
    return hourly.where(wv.finite(value)).select(
        "station_id", "observed_at",
        (F.col("observed_at") - F.make_dt_interval(hours=offset_hours)).alias("instant"),
        F.to_date("observed_at").alias("day"), value.alias("value"))


def choose_temperature(
    hourly: DataFrame, daily: DataFrame, scope: Sequence[str]
) -> DataFrame:
    """Hourly temperature where a scope has any, else its daily values; never both."""
    have = hourly.select(*scope).distinct()
    fallback = daily.join(have, list(scope), "left_anti")
    return hourly.withColumn("frequency", F.lit("Hourly")).unionByName(
        fallback.withColumn("frequency", F.lit("Daily summaries")))


def completeness(reports: DataFrame, keys: Sequence[str], span: Span) -> DataFrame:
    """Requested, numeric and usable readings with percentages."""
    numeric = F.col("value").isNotNull()
    rows = reports.where(span.holds(F.col("day"))).withColumn("_ok", wv.accepted_value().isNotNull())
    requested = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        requested.alias("requested"), F.count_if(numeric).alias("numeric"),
        F.count_if("_ok").alias("usable"),
        F.max(F.when(numeric, F.col("day"))).alias("latest_numeric"),
        F.max(F.when(F.col("_ok"), F.col("day"))).alias("latest_usable"),
    ).withColumns({
        "missing_pct": (F.lit(1.0) - F.col("numeric") / F.col("requested")) * 100,
        "not_usable_pct": (F.lit(1.0) - F.col("usable") / F.col("requested")) * 100,
        "lag_days": F.datediff(F.lit(span.end), "latest_numeric"),
    })


def complete_months(days: DataFrame, share: float = 1.0) -> DataFrame:
    """Monthly mean (sum for rain) masked unless ``share`` (all) of its days are usable."""
    rows = long_samples(days, ["station_id"])
    month = rows.groupBy("station_id", "series", dates.month_start(F.col("day")).alias("month")).agg(
        F.count("value").alias("usable_days"), F.avg("value").alias("_mean"),
        F.sum("value").alias("_sum"))
    full = F.col("usable_days") >= dates.month_days(F.col("month")) * F.lit(share)
    metric = F.when(F.col("series") == "pcpn", F.col("_sum")).otherwise(F.col("_mean"))
    return month.select(
        "station_id", "series", "month", "usable_days",
        dates.month_days(F.col("month")).alias("calendar_days"), full.alias("complete"),
        F.when(full, metric).alias("metric"))


def long_run_seasonality(months: DataFrame, keys: Sequence[str]) -> DataFrame:
    return months.where(F.col("complete")).groupBy(
        *keys, F.month("month").alias("month_of_year")
    ).agg(F.avg("metric").alias("metric"), F.count(F.lit(1)).alias("contributing_months"))
