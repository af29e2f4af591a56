"""Import jobs: each query writes source files derived from the tables, then reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from footmark.functions import weather_values as wv
from footmark.operators import activity as act
from footmark.operators import quality as dq
from footmark.operators import reviews as rev
from footmark.operators import spatial
from footmark.operators import weather as wx
from footmark.plans.activity import COVERED_MONTHS, summary_sql
from footmark.plans.domain import (
    COVERAGE, WEATHER_COVERAGE, activity, businesses, lcd_rows, registry, review_days,
    reviews, sql, station_reports, table, tidy,
)
from footmark.session import checkpointed, scratch_path
from footmark.operators.ordering import exact_quantiles
from footmark.sinks import tables as sink
from footmark.sinks import versions as vs
from footmark.sources import files
from footmark.sources import manifests as mf


def _listing_files(spark, sf):
    """Listings as JSON lines with untidy cities, ZIPs and tag lists."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    bal, key = F.col("c_acctbal"), F.col("c_custkey")
    b = businesses(spark, sf).select("business_id", "latitude", "longitude", "stars",
                                     "review_count", "is_open", "categories")
    rows = (
        c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .join(b, key == b.business_id)
        .select(
            key.cast("string").alias("business_id"), F.col("c_name").alias("name"),
            F.when(bal > 5000, F.concat(F.lit("  "), F.lower("r_name"), F.lit(" ")))
            .otherwise(F.col("r_name")).alias("city"),
            F.when(bal.between(2000, 2500), "XX").otherwise(
                F.concat(F.lit(" "), F.lower(F.substring("r_name", 1, 2)))).alias("state"),
            F.concat(F.lpad(F.col("n_nationkey").cast("string"), 5, "0"),
                     F.when(bal > 8000, "-1234").otherwise(" ")).alias("postal_code"),
            "latitude", "longitude",
            F.concat(F.array_join("categories", " , "), F.lit(",, "),
                     F.col("c_mktsegment")).alias("categories"),
            "stars", "review_count", F.col("is_open").cast("int").alias("is_open"))
    )
    path = scratch_path(spark, "listings")
    rows.write.json(path)
    return files.json_lines(spark, path, files.LISTING)


def _scopes(spark, sf):
    return table(spark, sf, "region").select(
        F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 99)))
        .alias("canonical_city"),
        F.upper(F.substring("r_name", 1, 2)).alias("canonical_state"))


def listings(spark, sf):
    rows = files.require_valid(files.listings(_listing_files(spark, sf), _scopes(spark, sf)))
    return tidy(rows.select(
        "business_id", "canonical_city", "canonical_state", "usable_postal_code", "latitude",
        "longitude", F.array_join("categories", "|").alias("tags"), "stars", "review_count",
        "is_open"))


def listing_checks(spark, sf):
    raw = _listing_files(spark, sf)
    kept = files.listings(raw, _scopes(spark, sf))
    repeated = dq.duplicate_keys(kept, ["business_id"])
    rows = raw.select(F.lit("read").alias("step")).unionByName(
        kept.select(F.lit("in scope").alias("step"))).unionByName(
        kept.where("violation IS NOT NULL").select(F.lit("invalid").alias("step"))).unionByName(
        repeated.select(F.lit("repeated id").alias("step")))
    return tidy(rows.groupBy("step").agg(F.count(F.lit(1)).alias("rows")))


def listing_profile(spark, sf):
    typed = files.listings(_listing_files(spark, sf), _scopes(spark, sf))
    return tidy(dq.column_profile(typed.select(
        "business_id", "usable_postal_code", "latitude", "longitude", "stars", "review_count")))


def _checkin_files(spark, sf):
    """One line per order; every fifth carries a repeated stamp and a blank entry."""
    key = F.col("o_orderkey")
    stamp = F.date_format(
        F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int")),
        "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("business_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat_ws(", ", stamp, F.lit(""), stamp))
        .otherwise(stamp).alias("date"))
    path = scratch_path(spark, "checkins")
    rows.write.json(path)
    return files.checkin_entries(files.json_lines(spark, path, files.CHECKIN))


def checkin_buckets(spark, sf):
    return tidy(files.hourly_buckets(_checkin_files(spark, sf), COVERAGE))


def checkin_outside(spark, sf):
    return tidy(files.outside_coverage(_checkin_files(spark, sf), COVERAGE))


def checkin_coverage(spark, sf):
    """Check-in record share per city, and rows without a listing."""
    entries = _checkin_files(spark, sf)
    per = entries.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("entries"), F.min("stamp").alias("first"), F.max("stamp").alias("last"))
    b = businesses(spark, sf).withColumn("business_id", F.col("business_id").cast("string"))
    joined = b.join(per, "business_id", "left")
    return tidy(joined.groupBy("metro").agg(
        F.count(F.lit(1)).alias("businesses"), F.count("entries").alias("with_checkins"),
        F.sum("entries").alias("entries"),
        (F.count("entries") / F.count(F.lit(1))).alias("record_share")))


def checkins_without_listing(spark, sf):
    """Anti joins both ways: activity without a listing, listings without recent activity."""
    a = act.business_totals(activity(spark, sf, COVERED_MONTHS), COVERED_MONTHS).select("business_id")
    b = businesses(spark, sf).select("business_id")
    rows = a.join(b, "business_id", "left_anti").select(F.lit("no listing").alias("side"),
                                                        "business_id").unionByName(
        b.join(a, "business_id", "left_anti").select(F.lit("no activity").alias("side"),
                                                     "business_id"))
    return tidy(rows)


def _review_files(spark, sf):
    rows = reviews(spark, sf).select(
        "review_id", F.col("business_id").cast("string").alias("business_id"),
        F.when(F.col("stars") == 5, F.lit("5.0")).otherwise(F.col("stars").cast("string"))
        .alias("stars"),
        F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 12:30:00")).alias("date"))
    path = scratch_path(spark, "reviews")
    rows.write.json(path)
    return files.review_records(files.json_lines(spark, path, files.REVIEW))


def review_days_from_files(spark, sf):
    rows = files.require_valid(_review_files(spark, sf))
    return tidy(rev.daily_totals(rows, ["business_id"]))


def review_repeats(spark, sf):
    return tidy(dq.duplicate_keys(_review_files(spark, sf), ["review_id"]))


def review_violations(spark, sf):
    """Broken reviews: stars beyond 5 and zoned stamps derived from the order lines."""
    li = table(spark, sf, "lineitem")
    raw = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"),
        F.when(F.col("l_returnflag") == "R", F.lit(" ")).otherwise(
            F.col("l_suppkey").cast("string")).alias("business_id"),
        F.col("l_linenumber").cast("string").alias("stars"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
                 F.when(F.col("l_linestatus") == "F", "+02:00").otherwise("")).alias("date"))
    rows = files.review_records(raw)
    return tidy(rows.groupBy(F.coalesce("violation", F.lit("ok")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("rows")))


def review_sample(spark, sf):
    """How complete every source record is, column by column."""
    return tidy(dq.column_profile(_review_files(spark, sf)))


def stamp_checks(spark, sf):
    """Stamps of many spellings, told apart as source-local or not: what the readers would refuse."""
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 9
    spelled = F.element_at(F.array(
        day, F.concat(day, F.lit(" 10:20:30")), F.concat(day, F.lit("T10:20")), F.concat(day, F.lit(" 10:20:30.5")),
        F.substring(day, 1, 7), F.substring(day, 1, 4), F.concat(day, F.lit(" 10:20:30 UTC")),
        F.concat(day, F.lit(" 10:20:30+05")), F.concat(day, F.lit(" 10:20:30 Europe/Paris"))), (kind + 1).cast("int"))
    rows = table(spark, sf, "orders").select(kind.alias("spelling"), files.naive_stamp(spelled).alias("stamp"))
    return tidy(rows.groupBy("spelling").agg(
        F.count("stamp").alias("accepted"), F.count_if(F.col("stamp").isNull()).alias("rejected")))


def _native_station(spark, sf):
    """Native rows as the source file spells them."""
    r = station_reports(spark, sf)
    number = F.when(F.col("raw_value") == "T", F.lit("0.0")).otherwise(
        F.coalesce(F.col("value").cast("string"), F.lit("")))
    raw = F.when(F.col("raw_value") == "T", F.lit("T")).when(F.col("value").isNull(), F.lit("M")
                 ).otherwise(F.col("value").cast("string"))
    unit = F.when(F.col("variable") == "pcpn", "inch").otherwise("degreeF")
    return r.select(
        "station_id", F.concat(F.lit("Station "), "station_id").alias("station_name"),
        F.lit("00000").alias("station_county_fips"), F.lit("ST").alias("station_state"),
        F.lit("40.5").alias("station_latitude"), F.lit("-75.25").alias("station_longitude"),
        F.lit("10").alias("station_elevation_ft"),
        F.date_format("day", "yyyy-MM-dd").alias("date"), "variable", number.alias("value"),
        unit.alias("unit"), raw.alias("raw_value"), "flag", F.lit("N").alias("network_id"),
        F.lit("").alias("source_flag"), F.lit("07:00").alias("observation_time_local_standard"),
        F.col("is_trace").cast("int").cast("string").alias("is_trace"))


def _station_files(spark, sf):
    native = _native_station(spark, sf)
    data = scratch_path(spark, "station-csv")
    native.write.option("header", True).option("compression", "gzip").option(
        "emptyValue", "").csv(data)
    value = wv.native_value(F.col("raw_value"))
    audit = native.groupBy("station_id", "variable").agg(
        F.count(F.lit(1)).alias("requested_days"), F.count(value).alias("observed_days"),
        F.count_if(value.isNull()).alias("missing_days"),
        F.count_if(F.col("is_trace") == "1").alias("trace_days"))
    # A manifest lists its stations; there are ten here and three variables each.
    per_station = audit.groupBy("station_id").agg(
        F.sum("requested_days").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("variable", F.struct(
            "requested_days", "observed_days", "missing_days", "trace_days")))).alias("coverage"))
    doc = per_station.groupBy().agg(
        F.sum("rows").alias("rows"), F.collect_list(F.struct(
            "station_id", F.concat(F.lit("Station "), "station_id").alias("name"),
            F.lit(40.5).alias("latitude"), F.lit(-75.25).alias("longitude"), "rows", "coverage",
        )).alias("stations")
    ).select(F.lit(1).alias("schema_version"), F.lit("complete").alias("status"), F.struct(
        F.lit(WEATHER_COVERAGE.start).alias("start"), F.lit(WEATHER_COVERAGE.end).alias("end"),
        F.lit("daily").alias("frequency"), F.lit(WEATHER_COVERAGE.days).alias("days")
    ).alias("scope"), "rows", "stations")
    manifest = scratch_path(spark, "station-manifest")
    doc.coalesce(1).write.json(manifest)
    return (files.csv_exact(spark, data, files.STATION_CSV),
            files.manifest_stations(files.manifest(spark, manifest)), data)


def station_checks(spark, sf):
    raw, stations, _ = _station_files(spark, sf)
    rows = files.station_rows(raw, stations, WEATHER_COVERAGE)
    return tidy(rows.groupBy("variable", F.coalesce("violation", F.lit("ok")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("numeric"),
        F.count_if("is_trace").alias("traces")))


def station_audit(spark, sf):
    raw, stations, _ = _station_files(spark, sf)
    rows = files.station_rows(raw, stations, WEATHER_COVERAGE)
    return tidy(files.station_audit(rows, stations))


def manifest_rows(spark, sf):
    _, stations, _ = _station_files(spark, sf)
    span_ok = F.datediff("end", "start") + 1
    return tidy(stations.select(
        "station_id", "variable", "requested_days", "observed_days", "missing_days", "trace_days",
        (F.col("observed_days") + F.col("missing_days") == F.col("requested_days")).alias("adds_up"),
        span_ok.alias("span_days")))


_ID = "concat('USW000000', station_id)"  # the source's own form of a station's name


def day_bitmaps(spark, sf):
    """The days of a manifest against those of the rows that came, where the rows have lost every 13th day of a
    month of S0, hold every 1st twice for S1, and the manifest does not list the 20th of S2."""
    keys, day = ["station_id", "variable"], F.dayofmonth("day")
    rows = station_reports(spark, sf).select(*keys, "day")
    at = lambda station, n: (F.col("station_id") == station) & (day == n)
    came = rows.where(~at("S0", 13)).unionByName(rows.where(at("S1", 1)))
    path = scratch_path(spark, "day-bitmaps")
    mf.day_bitmaps(rows.where(~at("S2", 20)), keys, WEATHER_COVERAGE.start).write.parquet(path)  # the manifest's side
    return tidy(mf.day_differences(spark.read.parquet(path), mf.day_bitmaps(came, keys, WEATHER_COVERAGE.start), keys))


def manifest_rules(spark, sf):
    """A manifest of all stations as it should be, and a copy broken in one place for every rule."""
    days, reports = WEATHER_COVERAGE.days, station_reports(spark, sf)
    counted = reports.groupBy(F.expr(_ID).alias("station_id"), "variable").agg(F.count("value").alias("n"))
    audit = F.struct(F.lit(days).alias("requested_days"), F.col("n").alias("observed_days"), (F.lit(days) - F.col("n")).alias("missing_days"))
    stations = counted.groupBy("station_id").agg(F.map_from_entries(F.collect_list(F.struct("variable", audit))).alias("coverage")).select(
        "station_id", F.concat(F.lit("Station "), "station_id").alias("name"), F.lit(40.5).alias("latitude"), F.lit(-75.25).alias("longitude"),
        F.lit(3 * days).alias("rows"), "coverage", F.array(F.concat("station_id", F.lit(mf.NATIVE_SUFFIX))).alias("sids"))
    doc = stations.agg(F.array_sort(F.collect_list("station_id")).alias("ids"), F.collect_list(F.struct("*")).alias("stations")).select(
        F.lit(1).alias("schema_version"), F.lit("complete").alias("status"), (F.size("ids") * 3 * days).alias("rows"), F.struct(
            F.lit(str(WEATHER_COVERAGE.start)).alias("start"), F.lit(str(WEATHER_COVERAGE.end)).alias("end"), F.lit("daily").alias("frequency"),
            F.lit(days).alias("days"), F.lit("station").alias("geographic_support"), F.col("ids").alias("station_ids")).alias("scope"),
        "stations", F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(u).alias("unit")) for v, u in mf.UNITS.items()]).alias("variables"),
        F.lit("observations").alias("observations_digest"), F.lit("mapping").alias("mapping_digest"), F.size("ids").alias("scope_stations"))
    inside = lambda field, value: lambda d: d.withColumn("scope", F.col("scope").withField(field, value))
    each = lambda change: lambda d: d.withColumn("stations", F.transform("stations", change))
    first = lambda field, value: each(lambda s: F.when(
        s["station_id"] == F.element_at("scope.station_ids", 1), s.withField(field, value)).otherwise(s))
    plain = lambda name, value: lambda d: d.withColumn(name, F.lit(value))
    less = lambda c: F.transform_values(c, lambda _, a: a.withField("missing_days", a["missing_days"] - 1))
    cases = {
        "as it should be": lambda d: d, "version or status": plain("status", "pending"),
        "observations digest": plain("observations_digest", "others"), "mapping digest": plain("mapping_digest", "others"),
        "days": inside("days", F.lit(days - 1)), "frequency": inside("frequency", F.lit("hourly")),
        "support": inside("geographic_support", F.lit("county")),
        "units": plain("variables", None), "station ids": lambda d: d.withColumn("scope", F.col("scope").withField(
            "station_ids", F.concat("scope.station_ids", F.slice("scope.station_ids", 1, 1)))),
        "repeated or unlisted station": lambda d: d.withColumn("stations", F.concat("stations", F.slice("stations", 1, 1))).withColumn(
            "rows", F.col("rows") + 3 * days).withColumn("scope_stations", F.col("scope_stations") + 1),
        "absent station": lambda d: d.withColumn("scope", F.col("scope").withField(
            "station_ids", F.concat("scope.station_ids", F.array(F.lit("USW0000000X"))))),
        "station rows": first("rows", F.lit(1)), "station name": first("name", F.lit(" ")),
        "native id": first("sids", F.array(F.lit("none"))), "coordinates": first("latitude", F.lit(91.0)),
        "variables": each(lambda s: s.withField("coverage", F.map_filter(s["coverage"], lambda v, _: v != "pcpn"))),
        "day counts": each(lambda s: s.withField("coverage", less(s["coverage"]))),
        "rows": plain("rows", 0), "scope stations": plain("scope_stations", 0)}
    root = scratch_path(spark, "manifests")
    base, out = checkpointed(doc), None
    for number, (name, change) in enumerate(cases.items()):
        change(base).write.option("ignoreNullFields", False).json(f"{root}/{number}")
        one = mf.problems(mf.manifests(spark, f"{root}/{number}"), "observations", "mapping").select(
            F.lit(name).alias("broken"), F.size("stations").alias("stations"), F.array_join("problems", "; ").alias("problems"))
        out = one if out is None else out.unionByName(one)
    return tidy(out)


def source_fingerprints(spark, sf):
    """Station files, one for each station, against the manifest written with them: one file is changed after that,
    one is gone and one has come."""
    path, manifest = scratch_path(spark, "station-files"), scratch_path(spark, "station-files-manifest")
    _native_station(spark, sf).repartition("station_id").write.partitionBy("station_id").option("header", True).csv(path)
    files.file_manifest(spark, path).write.json(manifest)
    listed = spark.read.schema("file string, length long, digest string").json(manifest)
    changed, gone = (listed.where(F.col("file").startswith(f"station_id={s}/")).first()["file"] for s in ("S0", "S1"))
    vs.remove(spark, f"{path}/{gone}")
    vs.remove(spark, f"{path}/{changed}")
    vs.create_once(spark, f"{path}/{changed}", {"not": "what was there"})
    vs.create_once(spark, f"{path}/station_id=S10/part.csv", {"not": "listed"})
    rows = files.file_verdicts(spark, path, listed)
    return tidy(rows.select(F.regexp_extract("file", "station_id=([^/]+)/", 1).alias("station_id"), "verdict"))


def station_mapping(spark, sf):
    """Mapping file against catalog and station list; some coordinates are off on purpose."""
    b = businesses(spark, sf).where(F.col("latitude").isNotNull())
    status = F.when(F.col("station_id").isNull(), "outside_source").otherwise("mapped")
    nudge = F.when(F.col("review_count") < 5, F.lit(1e-5)).otherwise(F.lit(0.0))
    rows = b.select(
        "business_id", (F.col("latitude") + nudge).cast("string").alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"), status.alias("status"),
        F.coalesce("station_id", F.lit("")).alias("station_id"),
        F.coalesce("station_id", F.lit("")).alias("station_name"),
        F.lit("40.5").alias("station_latitude"), F.lit("-75.25").alias("station_longitude"))
    path = scratch_path(spark, "mapping")
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    mapping = files.csv_exact(spark, path, files.MAPPING_CSV)
    stations = wx.mapped_stations(businesses(spark, sf), []).withColumns(
        {"latitude": F.lit(40.5), "longitude": F.lit(-75.25)})
    catalog = businesses(spark, sf).withColumn("business_id", F.col("business_id").cast("string"))
    checked = files.mapping_check(mapping, catalog, stations)
    return tidy(checked.groupBy("status", F.coalesce("violation", F.lit("ok")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("rows")))


def hourly_from_files(spark, sf):
    path = scratch_path(spark, "lcd")
    lcd_rows(spark, sf).write.option("header", True).option("compression", "gzip").option(
        "emptyValue", "").csv(path)
    rows = files.csv_with(spark, path, files.LCD_REQUIRED)
    return tidy(wx.latest_hourly(rows))


def hourly_reparse(spark, sf):
    """Normalized rows equal re-parsed raw rows, one per station-hour."""
    hours = wx.latest_hourly(lcd_rows(spark, sf))
    again = lcd_rows(spark, sf).select(
        F.col("STATION").alias("station_id"), F.col("SOURCE").alias("source_code"),
        wv.hourly_value(F.col("HourlyDryBulbTemperature")).alias("_t"),
        wv.hourly_value(F.col("HourlyPrecipitation"), True).alias("_p"))
    joined = hours.join(again, ["station_id", "source_code"], "left")
    return tidy(joined.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("hour").alias("hours"),
        F.count_if(~F.col("temperature_c").eqNullSafe(F.col("_t"))
                   | ~F.col("precipitation_mm").eqNullSafe(F.col("_p"))).alias("mismatches")))


def _boundary_files(spark, sf):
    """One feature collection per region; rectangles around members, one broken label each."""
    box = businesses(spark, sf).where(F.col("latitude").isNotNull()).groupBy(
        "metro", "postal_code").agg(
        F.min("latitude").alias("a"), F.max("latitude").alias("b"),
        F.min("longitude").alias("c"), F.max("longitude").alias("d"))
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("c", "a"), point("d", "a"), point("d", "b"), point("c", "b"),
                   point("c", "a"))
    broken = F.slice(ring, 1, 4)
    area = F.array(F.when(F.col("postal_code").endswith("7"), broken).otherwise(ring))
    multi = F.col("postal_code").endswith("3")
    plain = F.struct(F.lit("Polygon").alias("type"), F.to_json(area).alias("coordinates"))
    nested = F.struct(F.lit("MultiPolygon").alias("type"), F.to_json(F.array(area)).alias(
        "coordinates"))
    features = box.select("metro", F.struct(
        F.struct("postal_code").alias("properties"),
        F.when(multi, nested).otherwise(plain).alias("geometry")).alias("feature"))
    doc = features.groupBy("metro").agg(F.collect_list("feature").alias("features"))
    path = scratch_path(spark, "boundaries")
    doc.select("features").write.option("maxRecordsPerFile", 1).json(path)
    return files.boundaries(spark, path)


def boundary_checks(spark, sf):
    rows = _boundary_files(spark, sf)
    return tidy(rows.select(
        "postal_code", "kind", F.coalesce(files.boundary_violation(), F.lit("ok")).alias("verdict"),
        F.aggregate(F.flatten("polygons"), F.lit(0), lambda n, r: n + F.size(r)).alias("points")))


def boundary_repeats(spark, sf):
    """Labels given twice: features whose label ends in 1 are read again from a second copy."""
    rows = _boundary_files(spark, sf)
    return tidy(files.repeated_labels(rows.unionByName(rows.where(F.col("postal_code").endswith("1")))))


def areas_with_boundary(spark, sf):
    """Areas with a valid boundary, and those whose boundary is missing or invalid."""
    good = _boundary_files(spark, sf).where(files.boundary_violation().isNull())
    areas = businesses(spark, sf).where(F.col("area_id").isNotNull()).select(
        "metro", "postal_code", "area_id").distinct()
    rows = spatial.attach_boundaries(areas, files.unique_boundaries(good))
    return tidy(rows.groupBy("metro").agg(
        F.count(F.lit(1)).alias("areas"), F.count("polygons").alias("with_boundary"),
        F.count_if(F.col("polygons").isNull()).alias("missing")))


def missing_boundaries(spark, sf):
    """Set difference of expected and present ZIPs in both directions."""
    have = _boundary_files(spark, sf).where(files.boundary_violation().isNull()).select(
        "postal_code")
    want = businesses(spark, sf).select("postal_code").distinct()
    return tidy(dq.set_difference(want, have))


# ---- quality ------------------------------------------------------------------------------


def registry_latest(spark, sf):
    rows = dq.latest_complete(registry(spark, sf))
    return tidy(dq.ready(rows, "assumed_source_local"))


def registry_bound(spark, sf):
    """Newest imports that were made for the newest revision of an import."""
    return tidy(dq.bound_imports(dq.latest_complete(registry(spark, sf)), "assumed_source_local"))


def activity_checks(spark, sf):
    """Totals as they are, and a copy in which some rows break each rule: both must be counted."""
    rows = act.business_totals(activity(spark, sf, COVERED_MONTHS), COVERED_MONTHS)
    key = F.col("business_id")
    broken = rows.withColumns({
        "checkins": F.when(key % 5 == 0, -F.col("checkins")).otherwise(F.col("checkins")),
        "active_days": F.when(key % 7 == 0, F.lit(COVERED_MONTHS.days + 1)).otherwise(F.col("active_days")),
        "weekend_checkins": F.when(key % 11 == 0, F.col("checkins") + 1).otherwise(F.col("weekend_checkins"))})
    check = lambda df, name: dq.activity_checks(df, COVERED_MONTHS).withColumn("table", F.lit(name))
    return tidy(check(rows, "recorded").unionByName(check(broken, "broken")))


def training_checks(spark, sf):
    return tidy(dq.training_checks(act.business_days(activity(spark, sf, COVERAGE), COVERAGE),
                                   businesses(spark, sf)))


def reconcile_totals(spark, sf):
    a = activity(spark, sf)
    return tidy(dq.reconcile({
        "daily": act.business_days(a, COVERED_MONTHS),
        "monthly": act.business_months(a, COVERED_MONTHS),
        "ranking": act.business_totals(a, COVERED_MONTHS)}, "checkins"))


def weather_period_coverage(spark, sf):
    """Complete weather days per business in a period, from station facts."""
    span = COVERED_MONTHS
    complete = wx.complete_days(wx.station_days(station_reports(spark, sf, span), span)).groupBy(
        "station_id").agg(F.count(F.lit(1)).alias("complete_days"))
    rows = businesses(spark, sf).join(complete, "station_id", "left")
    n = F.coalesce("complete_days", F.lit(0))
    return tidy(rows.select("business_id", "station_id", F.lit(span.days).alias("requested_days"),
                            n.alias("complete_days"), (n == span.days).alias("complete")))


def _station_sites(spark, sf):
    """A weather site for every supplier, near the region that it supplies."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")
    return rows.select(
        key.alias("site"), (F.lit(30.0) + F.col("n_regionkey") * F.lit(2.0) + ((key * 6151) % 1000) * F.lit(5e-4)).alias("latitude"),
        (F.lit(-80.0) - F.col("n_regionkey") + ((key * 3571) % 1000) * F.lit(4e-4)).alias("longitude"))


def region_inventory(spark, sf):
    """Size, ratings and reviews of every region, and how far its listings are from the nearest weather site."""
    b = businesses(spark, sf)
    stats = b.groupBy("metro").agg(
        F.count(F.lit(1)).alias("businesses"), F.countDistinct("area_id").alias("areas"),
        F.avg(F.col("is_open").cast("double")).alias("open_share"))
    stars = exact_quantiles(b, ["metro"], "stars", {"median_stars": 0.5})
    reviews_q = exact_quantiles(b, ["metro"], "review_count", {"reviews_p50": 0.5,
                                                               "reviews_p95": 0.95})
    near = spatial.nearest(b, _station_sites(spark, sf), "site")
    distances = exact_quantiles(b.join(near, ["latitude", "longitude"]), ["metro"], "km", {"site_km_p50": 0.5, "site_km_p95": 0.95})
    return tidy(stats.join(stars, "metro").join(reviews_q, "metro").join(distances, "metro", "left"))


def nearest_sites(spark, sf):
    """The nearest weather site of every located listing."""
    b = businesses(spark, sf)
    near = spatial.nearest(b, _station_sites(spark, sf), "site")
    return tidy(b.join(near, ["latitude", "longitude"]).select("business_id", "site", "km"))


def source_kinds(spark, sf):
    """none, the one kind, or mixed: station or airport sources per metro."""
    rows = businesses(spark, sf).groupBy("metro", "parent").agg(F.collect_set(F.when(
        F.col("station_id").isNotNull(), F.when(F.col("station_id") < "S5", "station").otherwise(
            "airport"))).alias("kinds"))
    return tidy(rows.select("metro", "parent", F.when(F.size("kinds") == 0, "none").when(
        F.size("kinds") == 1, F.element_at("kinds", 1)).otherwise("mixed").alias("source")))


def digests(spark, sf):
    """Order-free digests: equal rows per region give equal digests after reshuffling."""
    b = businesses(spark, sf).select("business_id", "name", "metro", "postal_code", "station_id", "is_open")
    one = dq.row_digest(b, ["metro"])
    two = dq.row_digest(b.repartition(13, "business_id"), ["metro"]).select("metro", F.col("digest").alias("again"))
    return tidy(one.join(two, "metro").select("metro", "rows", "digest", (F.col("digest") == F.col("again")).alias("stable")))


# ---- sinks --------------------------------------------------------------------------------


def sink_businesses(spark, sf):
    root = scratch_path(spark, "businesses")
    sink.publish(businesses(spark, sf), root, F.to_json(F.struct(F.lit("complete").alias("status"))),
                 ["metro"])
    rows = sink.published(spark, root)
    return tidy(rows.select("business_id", "metro", "parent", F.size("categories").alias("tags")))


def sink_areas(spark, sf):
    """Upsert of centres: the table so far knows the areas of open listings only."""
    keys = ["metro", "postal_code"]
    b = businesses(spark, sf)
    current = spatial.area_centres(b.where("is_open AND stars IS NOT NULL AND stars > 3"), keys)
    incoming = spatial.area_centres(b, keys).withColumn(
        "display_name", spatial.area_name("metro", "postal_code"))
    merged = sink.merge_areas(current.withColumn("display_name", F.lit("old")), incoming, keys)
    return tidy(merged)


def sink_station_scope(spark, sf):
    """Replace the station years of the second load only; the other partitions stay."""
    path = scratch_path(spark, "station-scope")
    days = wx.station_days(station_reports(spark, sf)).withColumn("year", F.year("day"))
    sink.replace_partitions(days.withColumn("load", F.lit(1)), path, ["year"])
    later = days.where(F.col("year") >= 2000).withColumn("load", F.lit(2))
    sink.replace_partitions(later, path, ["year"])
    rows = spark.read.parquet(path)
    return tidy(rows.groupBy("year", "load").agg(F.count(F.lit(1)).alias("rows")))


def sink_conflicts(spark, sf):
    """Keys another owner already holds, as a distinct union of two claims."""
    owned = station_reports(spark, sf).select("station_id", "day", "variable").withColumn(
        "owner", F.when(F.col("day") < "1996-01-01", "other").otherwise("self"))
    incoming = owned.drop("owner")
    days = sink.refuse_foreign(incoming, owned, ["station_id", "day", "variable"], "self").select(
        F.col("station_id").alias("claim"))
    stations = owned.where("owner = 'other' AND variable = 'pcpn'").select(
        F.col("station_id").alias("claim"))
    return tidy(dq.ownership_conflicts(days, stations))


def sink_reviews(spark, sf):
    return tidy(sink.reconciled(review_days(spark, sf), reviews(spark, sf)))


def sink_published_reviews(spark, sf):
    """Daily totals as readers see them after a reconciled publish."""
    root = scratch_path(spark, "review-days")
    sink.publish_reconciled(review_days(spark, sf), reviews(spark, sf), root, F.lit("{}"))
    return tidy(sink.published(spark, root))


def sink_native_stations(spark, sf):
    """Replace all native station rows, then compare the digest of what was written with the source's; of the
    copy that is published, every station whose number is even has lost its traces on the way."""
    root = scratch_path(spark, "native-stations")
    rows = station_reports(spark, sf)
    lossy = rows.where(~(F.col("is_trace") & (F.substring("station_id", 2, 9).cast("int") % 2 == 0)))
    sink.publish(lossy, root, F.lit("{}"))
    before = dq.row_digest(rows, ["station_id"])
    after = dq.row_digest(sink.published(spark, root).select(*rows.columns), ["station_id"]).select(
        "station_id", F.col("rows").alias("written"), F.col("digest").alias("again"))
    return tidy(before.join(after, "station_id", "left").select(
        "station_id", "rows", "written", F.col("digest").eqNullSafe(F.col("again")).alias("verified")))


def sink_orphans(spark, sf):
    areas = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("area_id"), "n_name")
    kept = businesses(spark, sf).where((F.col("stars") > 4.5) & (F.col("review_count") > 480))
    return tidy(sink.drop_orphans(areas, kept))


def sink_relink(spark, sf):
    b = businesses(spark, sf)
    mapping = b.select("business_id", "station_id", F.when(
        F.col("station_id").isNull() | ~F.col("is_open"), "unmapped").otherwise("mapped").alias("status"))
    return tidy(sink.relink_stations(b, mapping).select("business_id", "station_id"))


def sink_history(spark, sf):
    """Import history by manifest, kept by two writers in turn: a first load, an update by what came after, and a
    writer that still holds the first version and is refused."""
    get = lambda p: F.get_json_object("metadata", p)
    keys, root = ["import_key", "manifest"], scratch_path(spark, "history")
    rows = registry(spark, sf).select(
        get("$.import_key").alias("import_key"), get("$.business_import_revision").alias("manifest"), "id",
        (get("$.timestamp_policy") == "unknown").alias("later"))
    load = lambda part: part.groupBy(*keys).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("imports"))
    merge = {"id": F.least, "imports": lambda old, new: old + new}
    vs.commit(vs.upsert(None, load(rows.where("NOT later")), keys, merge), root, vs.current(spark, root), "first load")
    seen = vs.current(spark, root)  # both writers read this version
    vs.commit(vs.upsert(seen.rows, load(rows.where("later")), keys, merge), root, seen, "update")
    try:
        vs.commit(vs.upsert(seen.rows, load(rows), keys, merge), root, seen, "late")
        refused = 0
    except vs.StaleWrite:
        refused = 1
    newest = vs.current(spark, root)
    return tidy(newest.rows.withColumns({"version": F.lit(newest.number), "refused_writes": F.lit(refused)}))


def sink_export(spark, sf):
    """Scope-stamped CSV read back as text."""
    totals = act.business_totals(activity(spark, sf, COVERED_MONTHS), COVERED_MONTHS)
    rows = businesses(spark, sf).join(totals, "business_id").select(
        "business_id", F.concat(F.lit("="), "name").alias("name"), "metro", "checkins")
    path = scratch_path(spark, "export")
    sink.export_csv(rows, path, {
        "start_date": F.lit(str(COVERED_MONTHS.start)), "end_date": F.lit(str(COVERED_MONTHS.end))})
    return files.csv_with(spark, path, ["business_id"]).withColumn(
        "checkins", F.col("checkins").cast("long"))


QUERIES = {
    "ingest_listings": listings,
    "ingest_listing_checks": listing_checks,
    "ingest_listing_profile": listing_profile,
    "ingest_checkin_buckets": checkin_buckets,
    "ingest_checkin_outside": checkin_outside,
    "ingest_checkin_coverage": checkin_coverage,
    "ingest_unmatched_sides": checkins_without_listing,
    "ingest_review_days": review_days_from_files,
    "ingest_review_repeats": review_repeats,
    "ingest_review_violations": review_violations,
    "ingest_review_sample": review_sample,
    "ingest_stamp_checks": stamp_checks,
    "ingest_station_checks": station_checks,
    "ingest_station_audit": station_audit,
    "ingest_manifest_rows": manifest_rows,
    "ingest_fingerprints": source_fingerprints,
    "ingest_day_bitmaps": day_bitmaps,
    "ingest_manifest_rules": manifest_rules,
    "ingest_station_mapping": station_mapping,
    "ingest_hourly": hourly_from_files,
    "ingest_hourly_reparse": hourly_reparse,
    "ingest_boundary_checks": boundary_checks,
    "ingest_boundary_repeats": boundary_repeats,
    "ingest_areas_with_boundary": areas_with_boundary,
    "ingest_missing_boundaries": missing_boundaries,
    "quality_registry_latest": registry_latest,
    "quality_registry_bound": registry_bound,
    "quality_activity_checks": activity_checks,
    "quality_training_checks": training_checks,
    "quality_reconcile": reconcile_totals,
    "quality_weather_period": weather_period_coverage,
    "quality_region_inventory": region_inventory,
    "quality_nearest_sites": nearest_sites,
    "quality_source_kinds": source_kinds,
    "quality_digests": digests,
    "sink_businesses": sink_businesses,
    "sink_areas": sink_areas,
    "sink_station_scope": sink_station_scope,
    "sink_conflicts": sink_conflicts,
    "sink_reviews": sink_reviews,
    "sink_published_reviews": sink_published_reviews,
    "sink_native_stations": sink_native_stations,
    "sink_orphans": sink_orphans,
    "sink_relink": sink_relink,
    "sink_history": sink_history,
    "sink_export": sink_export,
}

_CITY = "upper(r_name[1]) || lower(r_name[2:])"
_LISTED = """listed AS (SELECT b.*, c_acctbal, r_name FROM business b
  JOIN customer ON c_custkey = business_id JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE NOT c_acctbal BETWEEN 2000 AND 2500)"""
_BAD = """CASE WHEN l_returnflag = 'R' THEN 'business id missing' WHEN l_linenumber NOT BETWEEN 1
  AND 5 THEN 'stars not an integer 1-5' WHEN l_linestatus = 'F' THEN 'review date invalid'
  ELSE 'ok' END"""
_NATIVE = """native AS (SELECT *, CASE WHEN raw_value = 'T' THEN 0e0 WHEN value IN (-999e0)
    THEN NULL ELSE value END AS native,
  CASE WHEN flag = 'A' THEN 'A' ELSE flag END AS f FROM report),
verdict AS (SELECT *, CASE
  WHEN f = 'M' AND native IS NOT NULL THEN 'missing flag with a number'
  WHEN (f = 'T' OR raw_value = 'T') AND variable <> 'pcpn' THEN 'trace not zero rain'
  WHEN variable = 'pcpn' AND native < 0 THEN 'negative rain' ELSE 'ok' END AS verdict
  FROM native)"""
_AUDIT = """audit AS (SELECT station_id, variable, count(*) AS requested_days,
  count(native) AS observed_days, count(*) - count(native) AS missing_days,
  count(*) FILTER (raw_value = 'T') AS trace_days FROM native GROUP BY ALL)"""
_ZIP = """zips AS (SELECT metro, postal_code, postal_code LIKE '%7' AS broken,
  postal_code LIKE '%3' AS multi FROM business WHERE latitude IS NOT NULL GROUP BY ALL)"""
_CENTRE = """SELECT metro, postal_code, avg(latitude) AS latitude, avg(longitude) AS longitude
  FROM business WHERE area_id IS NOT NULL"""

_NEAR = """site AS (SELECT s_suppkey AS site, 3e1 + n_regionkey * 2e0 + ((s_suppkey * 6151) % 1000) * 5e-4 AS slat,
  -8e1 - n_regionkey + ((s_suppkey * 3571) % 1000) * 4e-4 AS slon FROM supplier JOIN nation ON s_nationkey = n_nationkey),
near AS (SELECT business_id, arg_min(site, (km, site)) AS site, min(km) AS km FROM (SELECT business_id, site,
  2e0 * 63710088e-4 * asin(sqrt(least(1e0, greatest(0e0, sin(radians(slat - latitude) / 2e0) ^ 2 + cos(radians(latitude))
    * cos(radians(slat)) * sin(radians(slon - longitude) / 2e0) ^ 2)))) AS km
  FROM business, site WHERE latitude IS NOT NULL) GROUP BY 1)"""

ORACLES = {
    "ingest_stamp_checks": """SELECT o_orderkey % 9 AS spelling,
  count(*) FILTER (o_orderkey % 9 < 4) AS accepted, count(*) FILTER (o_orderkey % 9 >= 4) AS rejected
FROM orders GROUP BY 1""",
    "ingest_review_sample": " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{t}' AS dtype, {m} AS missing_rows, {p} AS missing_percent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""" for c, t, m, p in [
            ("review_id", "string", "count(*) * 0", "0e0"), ("business_id", "string", "count(*) * 0", "0e0"),
            ("stars", "int", "count(*) * 0", "0e0"), ("day", "date", "count(*) * 0", "0e0"),
            ("violation", "string", "count(*)", "100e0")]),
    "ingest_listings": sql("business", f"""SELECT CAST(business_id AS VARCHAR) AS business_id,
  {_CITY} AS canonical_city, upper(r_name[1:2]) AS canonical_state,
  CASE WHEN c_acctbal > 8000 THEN NULL ELSE postal_code END AS usable_postal_code,
  latitude, longitude, array_to_string(categories, '|') AS tags, stars, review_count, is_open
  FROM listed""", "latitude longitude", _LISTED),
    "ingest_listing_checks": sql("business", """SELECT 'read' AS step, count(*) AS rows FROM business
  UNION ALL SELECT 'in scope', count(*) FROM listed""", ctes=_LISTED),
    "ingest_listing_profile": sql("business", " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{t}' AS dtype, {m} AS missing_rows,
  round(100e0 * {m} / count(*), 2) AS missing_percent FROM listed""" for c, t, m in [
            ("business_id", "string", "0"),
            ("usable_postal_code", "string", "count(*) FILTER (c_acctbal > 8000)"),
            ("latitude", "double", "count(*) FILTER (latitude IS NULL)"),
            ("longitude", "double", "count(*) FILTER (longitude IS NULL)"),
            ("stars", "double", "count(*) FILTER (stars IS NULL)"),
            ("review_count", "bigint", "0")]), "missing_percent", _LISTED),
    "ingest_checkin_buckets": """SELECT CAST(o_custkey AS VARCHAR) AS business_id,
  CAST(o_orderdate AS DATE) AS day, o_orderkey % 24 AS hour,
  CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END) AS BIGINT) AS n FROM orders
  WHERE o_orderdate >= DATE '1995-06-01' AND o_orderdate < DATE '2001-04-01' GROUP BY ALL""",
    "ingest_checkin_outside": """SELECT CAST(sum(w) FILTER (i) AS BIGINT) AS inside,
  CAST(sum(w) FILTER (NOT i) AS BIGINT) AS outside FROM (SELECT
    CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS w,
    o_orderdate >= DATE '1995-06-01' AND o_orderdate < DATE '2001-04-01' AS i FROM orders)""",
    "ingest_checkin_coverage": sql("business", """SELECT metro, count(*) AS businesses,
  count(e) AS with_checkins, CAST(sum(e) AS BIGINT) AS entries, count(e) * 1e0 / count(*)
  AS record_share FROM business LEFT JOIN (SELECT o_custkey AS business_id,
    sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END) AS e FROM orders GROUP BY 1)
  USING (business_id) GROUP BY 1""", "record_share"),
    "ingest_unmatched_sides": sql("business activity", """SELECT DISTINCT 'no listing' AS side,
  business_id FROM totals WHERE business_id NOT IN (SELECT business_id FROM business)
  UNION ALL SELECT 'no activity', business_id FROM business
  WHERE business_id NOT IN (SELECT business_id FROM totals)""", ctes=summary_sql("months")),
    "ingest_review_days": sql("review", """SELECT CAST(business_id AS VARCHAR) AS business_id, day,
  star_sum, review_count FROM review_day"""),
    "ingest_review_repeats": """SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS review_id,
  count(*) AS copies FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
  HAVING count(*) > 1""",
    "ingest_review_violations": f"""SELECT {_BAD} AS verdict, count(*) AS rows FROM lineitem
  GROUP BY 1""",
    "ingest_station_checks": sql("report", """SELECT variable, verdict, count(*) AS rows,
  count(native) AS numeric, count(*) FILTER (raw_value = 'T' OR flag = 'T') AS traces
  FROM verdict GROUP BY ALL""", ctes=_NATIVE),
    "ingest_station_audit": sql("report", """SELECT station_id, variable, requested_days,
  requested_days AS found_days, 0 AS repeated_rows, missing_days AS found_missing,
  trace_days AS found_traces, true AS matches FROM audit""", ctes=_NATIVE + ", " + _AUDIT),
    "ingest_manifest_rows": sql("report", """SELECT *, true AS adds_up,
  DATE '2001-11-04' - DATE '1995-01-02' + 1 AS span_days FROM audit""",
        ctes=_NATIVE + ", " + _AUDIT),
    "ingest_day_bitmaps": sql("report", """SELECT station_id, variable, count(*) FILTER (l) AS listed_days, count(*) FILTER (f) AS found_days,
  count(*) FILTER (l AND NOT f) AS missing_days, count(*) FILTER (f AND NOT l) AS extra_days,
  count(*) FILTER (f AND station_id = 'S1' AND day(day) = 1) AS doubled_rows FROM (SELECT station_id, variable, day,
    NOT (station_id = 'S2' AND day(day) = 20) AS l, NOT (station_id = 'S0' AND day(day) = 13) AS f FROM report) GROUP BY ALL"""),
    "ingest_manifest_rules": sql("report", """SELECT broken, n + more AS stations, problems FROM (
  SELECT broken, 0 AS more, broken AS problems FROM (SELECT unnest(['version or status', 'observations digest', 'mapping digest', 'days',
    'frequency', 'support', 'units', 'station ids', 'absent station', 'station rows', 'station name', 'native id', 'coordinates',
    'variables', 'day counts', 'rows', 'scope stations']) AS broken)
  UNION ALL SELECT 'as it should be', 0, '' UNION ALL SELECT 'repeated or unlisted station', 1, 'repeated or unlisted station'),
  (SELECT count(DISTINCT station_id) AS n FROM report)"""),
    "ingest_station_mapping": sql("business", """SELECT status, verdict, count(*) AS rows FROM (
  SELECT CASE WHEN station_id IS NULL THEN 'outside_source' ELSE 'mapped' END AS status,
    CASE WHEN review_count < 5 THEN 'business moved' ELSE 'ok' END AS verdict
  FROM business WHERE latitude IS NOT NULL) GROUP BY ALL"""),
    "ingest_hourly_reparse": sql("lcd", """SELECT station AS station_id, count(*) AS rows,
  count(DISTINCT date_trunc('hour', ts)) AS hours, 0 AS mismatches FROM (
    SELECT station, max(ts) AS ts FROM lcd WHERE report_type = 'FM-15'
    GROUP BY station, date_trunc('hour', ts)) GROUP BY 1"""),
    "ingest_boundary_checks": sql("business", """SELECT postal_code,
  CASE WHEN multi THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
  CASE WHEN broken THEN 'ring not closed' ELSE 'ok' END AS verdict,
  CASE WHEN broken THEN 4 ELSE 5 END AS points FROM zips""", ctes=_ZIP),
    "ingest_areas_with_boundary": sql("business", """SELECT metro, count(*) AS areas,
  count(*) FILTER (NOT coalesce(broken, true)) AS with_boundary,
  count(*) FILTER (coalesce(broken, true)) AS missing
  FROM (SELECT DISTINCT metro, postal_code FROM business WHERE area_id IS NOT NULL)
  LEFT JOIN zips USING (metro, postal_code) GROUP BY 1""", ctes=_ZIP),
    "ingest_missing_boundaries": sql("business", """SELECT DISTINCT postal_code,
  'left only' AS side FROM business WHERE postal_code NOT IN (
    SELECT postal_code FROM zips WHERE NOT broken)""", ctes=_ZIP),
    "ingest_boundary_repeats": sql("business", """SELECT postal_code, 2 AS copies FROM zips
  WHERE postal_code LIKE '%1'""", ctes=_ZIP),
    "quality_registry_bound": sql("registry", """SELECT r.import_key, b.import_key AS bound_to FROM newest r
  JOIN newest b ON r.business_import_revision = b.import_revision
  WHERE r.timestamp_policy = 'assumed_source_local' AND r.end_date >= r.start_date""", ctes="""newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY import_key ORDER BY id DESC) AS n FROM reg
  WHERE status = 'complete') WHERE n = 1)"""),
    "quality_registry_latest": sql("registry", """SELECT import_key, id, import_revision,
  business_import_revision, start_date, end_date, timestamp_policy,
  timestamp_policy = 'assumed_source_local' AND end_date >= start_date AS ready FROM (
  SELECT *, row_number() OVER (PARTITION BY import_key ORDER BY id DESC) AS r FROM reg
  WHERE status = 'complete') WHERE r = 1"""),
    "quality_activity_checks": sql("business activity", """SELECT "table", unnest(['negative count', 'active days beyond period',
  'weekend beyond total']) AS check, unnest([count(*) FILTER (c < 0), count(*) FILTER (NOT a BETWEEN 0 AND 387),
  count(*) FILTER (NOT w BETWEEN 0 AND c)]) AS violations FROM (
  SELECT 'recorded' AS "table", c, a, w FROM whole UNION ALL SELECT 'broken', CASE WHEN business_id % 5 = 0 THEN -c ELSE c END,
    CASE WHEN business_id % 7 = 0 THEN 388 ELSE a END, CASE WHEN business_id % 11 = 0 THEN c + 1 ELSE w END FROM whole)
  GROUP BY 1""", ctes="""whole AS (SELECT business_id, sum(n) AS c, count(DISTINCT day) AS a,
  coalesce(sum(n) FILTER (isodow(day) > 5), 0) AS w FROM activity WHERE day BETWEEN DATE '2000-03-10' AND DATE '2001-03-31'
  GROUP BY 1)"""),
    "quality_training_checks": sql("business activity", """SELECT 'unknown id' AS check,
  count(*) AS violations FROM (SELECT business_id FROM activity
    WHERE day BETWEEN DATE '1995-06-01' AND DATE '2001-03-31'
    AND business_id NOT IN (SELECT business_id FROM business) GROUP BY business_id, day)
  UNION ALL SELECT 'negative count', 0 UNION ALL SELECT 'repeated business-day', 0"""),
    "quality_reconcile": sql("activity", """SELECT unnest(['daily', 'monthly', 'ranking'])
  AS source, CAST(sum(n) AS BIGINT) AS total, true AS matches FROM activity
  WHERE day BETWEEN DATE '2000-03-10' AND DATE '2001-03-31'"""),
    "quality_weather_period": sql("business station", """SELECT business_id, station_id,
  387 AS requested_days, coalesce(n, 0) AS complete_days, coalesce(n, 0) = 387 AS complete
  FROM business LEFT JOIN (SELECT station_id, count(*) AS n FROM station_day
    WHERE tmin IS NOT NULL AND tmax IS NOT NULL AND pcpn IS NOT NULL
    AND day BETWEEN DATE '2000-03-10' AND DATE '2001-03-31' GROUP BY 1) USING (station_id)"""),
    "quality_region_inventory": sql("business", """SELECT * FROM (SELECT metro, count(*) AS businesses,
  count(DISTINCT area_id) AS areas, avg(CASE WHEN is_open THEN 1e0 ELSE 0e0 END) AS open_share,
  median(stars) AS median_stars, quantile_cont(review_count, 0.5) AS reviews_p50,
  quantile_cont(review_count, 0.95) AS reviews_p95 FROM business GROUP BY 1) LEFT JOIN (
    SELECT metro, quantile_cont(km, 0.5) AS site_km_p50, quantile_cont(km, 0.95) AS site_km_p95
    FROM near JOIN business USING (business_id) GROUP BY 1) USING (metro)""",
        "open_share median_stars reviews_p50 reviews_p95 site_km_p50 site_km_p95", _NEAR),
    "quality_nearest_sites": sql("business", "SELECT business_id, site, km FROM near", "km", _NEAR),
    "ingest_fingerprints": sql("report", """SELECT station_id, CASE station_id WHEN 'S0' THEN 'changed' WHEN 'S1' THEN 'missing'
  ELSE 'ok' END AS verdict FROM report GROUP BY 1 UNION ALL SELECT 'S10', 'extra'"""),
    "quality_source_kinds": sql("business", """SELECT metro, parent, CASE WHEN count(station_id) = 0
  THEN 'none' WHEN count(DISTINCT station_id < 'S5') = 2 THEN 'mixed'
  WHEN bool_and(station_id < 'S5') THEN 'station' ELSE 'airport' END AS source
  FROM business GROUP BY ALL"""),
    "quality_digests": sql("business", "SELECT metro, count(*) AS rows, " + " || '-' || ".join(
        f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))
        + """ AS digest, true AS stable FROM (SELECT metro, sha256(concat_ws(chr(31), CAST(business_id AS VARCHAR), name,
  metro, postal_code, coalesce(station_id, chr(8709)), CAST(is_open AS VARCHAR))) AS h FROM business) GROUP BY 1"""),
    "sink_businesses": sql("business", """SELECT business_id, metro, parent, len(categories) AS tags
  FROM business"""),
    "sink_areas": sql("business", f"""SELECT n.metro, n.postal_code, n.latitude, n.longitude,
  'ZIP ' || n.postal_code AS display_name, CASE WHEN o.metro IS NULL THEN 'inserted'
    ELSE 'updated' END AS action FROM ({_CENTRE} GROUP BY ALL) n
  LEFT JOIN ({_CENTRE} AND is_open AND stars > 3 GROUP BY ALL) o USING (metro, postal_code)""",
        "latitude longitude"),
    "sink_station_scope": sql("station", """SELECT year(day) AS year,
  CASE WHEN year(day) >= 2000 THEN 2 ELSE 1 END AS load, count(*) AS rows FROM station_day
  GROUP BY ALL"""),
    "sink_conflicts": sql("report", """SELECT DISTINCT station_id AS claim FROM report
  WHERE day < DATE '1996-01-01'"""),
    "sink_reviews": """SELECT CAST(sum(l_linenumber % 5 + 1) AS BIGINT) AS staged_stars,
  count(*) AS staged_reviews, CAST(sum(l_linenumber % 5 + 1) AS BIGINT) AS source_stars,
  count(*) AS source_reviews, true AS equal FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "sink_published_reviews": sql("review", "SELECT * FROM review_day"),
    "sink_native_stations": sql("report", """SELECT station_id, count(*) AS rows, count(*) FILTER (NOT lost) AS written,
  NOT bool_or(lost) AS verified FROM (SELECT station_id, is_trace AND CAST(station_id[2:] AS INTEGER) % 2 = 0 AS lost FROM report)
  GROUP BY 1"""),
    "sink_orphans": sql("business", """SELECT n_nationkey + 1 AS area_id, n_name FROM nation
  WHERE n_nationkey + 1 NOT IN (SELECT area_id FROM business WHERE area_id IS NOT NULL
    AND stars > 45e-1 AND review_count > 480)"""),
    "sink_relink": sql("business", """SELECT business_id,
  CASE WHEN is_open THEN station_id END AS station_id FROM business"""),
    "sink_history": sql("registry", """SELECT import_key, business_import_revision AS manifest,
  min(id) AS id, count(*) AS imports, count(DISTINCT timestamp_policy) AS revision, 2 AS version, 1 AS refused_writes
  FROM reg GROUP BY ALL"""),
    "sink_export": sql("business activity", """SELECT CAST(business_id AS VARCHAR) AS business_id,
  '''=' || name AS name, metro, checkins, '2000-03-10' AS start_date, '2001-03-31' AS end_date
  FROM summary WHERE checkins > 0""", ctes=summary_sql("months")),
}
from footmark.plans import weather as _weather  # noqa: E402

ORACLES["ingest_hourly"] = _weather.ORACLES["weather_hourly_latest"]
