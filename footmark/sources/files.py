"""Readers with explicit schemas. Bad records fail the job instead of becoming nulls."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footmark.functions import weather_values as wv
from footmark.functions.dates import Span


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Numbers stay text until validated, so a bad one is reported and not nulled by the parser.
LISTING = _strings(
    "business_id", "name", "address", "city", "state", "postal_code", "latitude", "longitude",
    "categories", "stars", "review_count", "is_open",
)
CHECKIN = _strings("business_id", "date")
REVIEW = _strings("review_id", "business_id", "stars", "date")
STATION_CSV = _strings(
    "station_id", "station_name", "station_county_fips", "station_state", "station_latitude",
    "station_longitude", "station_elevation_ft", "date", "variable", "value", "unit", "raw_value",
    "flag", "network_id", "source_flag", "observation_time_local_standard", "is_trace",
)
MAPPING_CSV = _strings(
    "business_id", "latitude", "longitude", "status", "station_id", "station_name",
    "station_latitude", "station_longitude",
)
COUNTY_CSV = _strings(
    "county_fips", "county_name", "state", "dataset", "scenario", "statistic", "frequency",
    "period", "variable", "unit", "grid", "value",
)
COVERAGE = T.StructType([
    T.StructField(n, T.LongType())
    for n in ("requested_days", "observed_days", "missing_days", "trace_days")
])
STATION_MANIFEST = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("scope", T.StructType([
        T.StructField("start", T.DateType()), T.StructField("end", T.DateType()),
        T.StructField("frequency", T.StringType()), T.StructField("days", T.LongType()),
    ])),
    T.StructField("rows", T.LongType()),
    T.StructField("missing_values", T.LongType()),
    T.StructField("stations", T.ArrayType(T.StructType([
        T.StructField("station_id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
        T.StructField("rows", T.LongType()),
        T.StructField("coverage", T.MapType(T.StringType(), COVERAGE)),
    ]))),
])
LCD_REQUIRED = (
    "STATION", "DATE", "REPORT_TYPE", "HourlyDryBulbTemperature", "HourlyPrecipitation",
)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line. Blank lines are skipped; other content fails the read.

    A line is read as the array ``[line,{}]``, which must hold exactly one object before the last: what
    follows a first object is an error and not lost.
    """
    line = F.col("value")
    text = spark.read.text(path).where(F.trim(line) != "")
    parsed = F.from_json(F.concat(F.lit("["), line, F.lit(",{}]")), T.ArrayType(schema), {"mode": "FAILFAST"})
    only = F.when(line.rlike(r"^\s*\{") & (F.size(parsed) == 2), F.get(parsed, 0)).otherwise(
        F.raise_error(F.lit("source records must be objects")))
    return text.select(only.alias("record")).select("record.*")


def csv_exact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header must equal the schema; rows must have every column (gzip is read as is)."""
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").csv(path).na.fill("")
    )


def csv_with(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Any columns in any order, all text, but the required ones must be there."""
    rows = (
        spark.read.option("header", True).option("mode", "FAILFAST")
        .option("inferSchema", False).csv(path).na.fill("")
    )
    absent = set(required) - set(rows.columns)
    if absent:
        raise ValueError(f"Missing columns: {sorted(absent)}")
    return rows


def table(spark: SparkSession, location: str, **jdbc: str) -> DataFrame:
    """A stored table: parquet by path, or the same question through JDBC options."""
    if jdbc:
        return spark.read.format("jdbc").options(url=location, **jdbc).load()
    return spark.read.parquet(location)


def manifest(spark: SparkSession, path: str, schema: T.StructType = STATION_MANIFEST) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def manifest_stations(rows: DataFrame) -> DataFrame:
    """One row per station and variable with the audited coverage."""
    stations = rows.select("scope.start", "scope.end", F.inline("stations"))
    return stations.select(
        "start", "end", "station_id", "name", "latitude", "longitude",
        F.explode("coverage").alias("variable", "audit"),
    ).select("*", "audit.*").drop("audit")


#: Bytes of a chunk, and chunk digests under one node of a file's digest tree.
CHUNK, NODE = 1 << 20, 1024


def _chunk_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path, chunk in zip(batch["path"], batch["chunk"]):
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as stream:
                stream.seek(int(chunk) * CHUNK)
                digests.append(hashlib.sha256(stream.read(CHUNK)).hexdigest())
        yield batch.assign(digest=digests)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest) of every file below a folder, from the digests of its chunks.

    A file is read by ranges of 1 MiB in as many tasks as there are; its digest is that of its nodes' digests,
    a node's that of up to 1,024 chunks' in order. No file and no list of all its chunks lies in one row.
    Spark lists no empty files, so they are left out.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ranges = listing.withColumn("chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("length") / CHUNK) - 1))))
    chunks = ranges.repartition("path", "chunk").mapInPandas(_chunk_digests, "path string, length long, chunk long, digest string")
    node = (F.col("chunk") / NODE).cast("long")

    def joined(place: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "digest"))), lambda x: x["digest"]), ""), 256)

    nodes = chunks.groupBy("path", "length", node.alias("node")).agg(joined("chunk").alias("digest"))
    return nodes.groupBy("path", "length").agg(joined("node").alias("digest"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, digest) with paths below the folder, as they go into a manifest."""
    below = F.regexp_replace("path", "^.*" + re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return fingerprints(spark, path).select(below.alias("file"), "length", "digest")


def file_verdicts(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, verdict): ok, changed, missing or extra against a manifest made when the files were written."""
    found = file_manifest(spark, path).select("file", F.col("length").alias("_length"), F.col("digest").alias("_digest"))
    return manifest.join(found, "file", "full_outer").select("file", F.when(
        F.col("digest").isNull(), "extra").when(F.col("_digest").isNull(), "missing").when(
        (F.col("length") != F.col("_length")) | (F.col("digest") != F.col("_digest")), "changed").otherwise("ok").alias("verdict"))


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> None:
    """Raise unless a folder holds exactly the files of its manifest."""
    bad = file_verdicts(spark, path, manifest).where("verdict != 'ok'").orderBy("file").first()
    if bad is not None:
        raise ValueError(f"{bad['file']}: {bad['verdict']}.")


# ---- listings -----------------------------------------------------------------------------


def normal_city(city: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(city, r"\s+", " ")))


def usable_zip(postal_code: Column) -> Column:
    text = F.trim(postal_code)
    return F.when(text.rlike("^[0-9]{5}$"), text)


def tag_list(text: Column) -> Column:
    """Split, trim, drop empties, keep the first of equal tags in order."""
    tags = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t))
    return F.array_distinct(F.filter(tags, lambda t: t != ""))


def bounded(text: Column, limit: float) -> Column:
    """Number of a coordinate-like text; null when empty."""
    return F.when(text != "", text.try_cast("double"))


def bounded_violation(text: Column, limit: float) -> Column:
    number = text.try_cast("double")
    return (text != "") & (
        number.isNull() | F.isnan(number) | ~number.between(-limit, limit)
    )


def listings(raw: DataFrame, scopes: DataFrame) -> DataFrame:
    """Listings of the given scopes with typed columns and the first violation, if any.

    ``scopes`` has (canonical_city, canonical_state); matching ignores case and spacing.
    """
    keyed = raw.withColumns({"_city": normal_city(F.coalesce("city", F.lit(""))),
                             "_state": F.upper(F.trim(F.coalesce("state", F.lit(""))))})
    wanted = scopes.withColumns({"_city": normal_city(F.col("canonical_city")),
                                 "_state": F.upper(F.trim("canonical_state"))})
    count = F.coalesce(F.nullif("review_count", F.lit("")), F.lit("0")).try_cast("long")
    status = F.coalesce("is_open", F.lit("0")).try_cast("int")
    stars = bounded(F.col("stars"), 5)
    bad = (
        F.when(F.coalesce("business_id", F.lit("")) == "", "business id missing")
        .when(bounded_violation(F.col("stars"), 5) | (stars < 0), "rating out of range")
        .when(bounded_violation(F.col("latitude"), 90)
              | bounded_violation(F.col("longitude"), 180), "coordinate out of bounds")
        .when(count.isNull() | (count < 0), "review count invalid")
        .when(status.isNull() | ~status.isin(0, 1), "operating status invalid")
    )
    return keyed.join(wanted, ["_city", "_state"]).select(
        "business_id", F.coalesce("name", F.lit("")).alias("name"), "city", "state",
        "canonical_city", "canonical_state", "postal_code",
        usable_zip(F.coalesce("postal_code", F.lit(""))).alias("usable_postal_code"),
        bounded(F.col("latitude"), 90).alias("latitude"),
        bounded(F.col("longitude"), 180).alias("longitude"),
        tag_list(F.col("categories")).alias("categories"), stars.alias("stars"),
        count.alias("review_count"), (status == 1).alias("is_open"), bad.alias("violation"))


def require_valid(rows: DataFrame, violation: str = "violation") -> DataFrame:
    """Fail the job on the first invalid row; use a filter on the column to quarantine."""
    v = F.col(violation)
    return rows.where(
        F.when(v.isNull(), F.lit(True)).otherwise(F.raise_error(v).cast("boolean"))
    ).drop(violation)


# A date, or a date and a time of day, and nothing else: no zone, no year or month alone.
_NAIVE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?)?$"


def naive_stamp(text: Column) -> Column:
    """A source-local stamp in the whole naive ISO form; null for anything else."""
    return F.when(text.rlike(_NAIVE), F.translate(text, ",", ".").try_cast("timestamp_ntz"))


# ---- check-ins ----------------------------------------------------------------------------


def checkin_entries(raw: DataFrame) -> DataFrame:
    """One row per source entry; repeated stamps stay; zoned or unreadable stamps fail."""
    entry = F.trim("entry")
    stamp = naive_stamp(entry)
    exploded = raw.select(
        "business_id", F.explode(F.split(F.coalesce("date", F.lit("")), ",")).alias("entry"))
    return exploded.where(entry != "").select(
        "business_id",
        F.when(stamp.isNotNull(), stamp).otherwise(
            F.raise_error(F.lit("check-in timestamp is invalid")).cast("timestamp_ntz"))
        .alias("stamp"))


def hourly_buckets(entries: DataFrame, coverage: Span) -> DataFrame:
    """Sparse hourly counts inside coverage; the shuffle carries partial counts only."""
    day = F.to_date("stamp")
    return entries.where(coverage.holds(day)).groupBy(
        "business_id", day.alias("day"), F.hour("stamp").alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))


def outside_coverage(entries: DataFrame, coverage: Span) -> DataFrame:
    inside = coverage.holds(F.to_date("stamp"))
    return entries.agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


# ---- reviews ------------------------------------------------------------------------------


def review_records(raw: DataFrame) -> DataFrame:
    """Typed reviews with a violation column; every row is judged, in or out of the catalog."""
    stars = F.col("stars").try_cast("double")
    stamp = naive_stamp(F.col("date"))
    bad = (
        F.when(F.trim(F.coalesce("review_id", F.lit(""))) == "", "review id missing")
        .when(F.trim(F.coalesce("business_id", F.lit(""))) == "", "business id missing")
        .when(stars.isNull() | ~stars.isin(1.0, 2.0, 3.0, 4.0, 5.0), "stars not an integer 1-5")
        .when(stamp.isNull(), "review date invalid")
    )
    return raw.select("review_id", "business_id", stars.cast("int").alias("stars"),
                      F.to_date(stamp).alias("day"), bad.alias("violation"))


# ---- stations -----------------------------------------------------------------------------


def station_rows(raw: DataFrame, stations: DataFrame, span: Span) -> DataFrame:
    """Native daily rows joined to their manifest entry, with the first violation."""
    s = stations.select(
        "station_id", F.col("name").alias("_name"), F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lon")).distinct()
    day = F.col("date").try_cast("date")
    unit = F.when(F.col("variable") == "pcpn", "inch").otherwise("degreeF")
    lat, lon = F.col("station_latitude").try_cast("double"), F.col("station_longitude").try_cast(
        "double")
    native = wv.native_value(F.col("raw_value"))
    trace = (F.trim("flag") == "T") | (F.trim("raw_value") == "T")
    bad = (
        F.when(F.col("_name").isNull(), "unknown station")
        .when(~F.col("variable").isin(*wv.VARIABLES) | (F.col("unit") != unit), "unit")
        .when((F.col("station_name") != F.col("_name")) | (F.abs(lat - F.col("_lat")) > 1e-7)
              | (F.abs(lon - F.col("_lon")) > 1e-7), "station metadata differs")
        .when(day.isNull() | ~span.holds(day), "date outside coverage")
        .when(~wv.native_value(F.col("value")).eqNullSafe(native), "normalized value differs")
        .when(~F.col("is_trace").isin("0", "1") | ((F.col("is_trace") == "1") != trace), "trace")
        .otherwise(wv.native_violation(F.col("variable"), F.col("raw_value"), F.col("flag")))
    )
    return raw.join(s, "station_id", "left").select(
        "station_id", day.alias("day"), "variable", native.alias("value"), "unit", "raw_value",
        "flag", "network_id", trace.alias("is_trace"), bad.alias("violation"))


def station_audit(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """Row, missing and trace counts against the manifest's coverage per variable."""
    found = rows.groupBy("station_id", "variable").agg(
        F.count(F.lit(1)).alias("found_rows"), F.countDistinct("day").alias("found_days"),
        F.count_if(F.col("value").isNull()).alias("found_missing"),
        F.count_if("is_trace").alias("found_traces"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return stations.join(found, ["station_id", "variable"], "left").select(
        "station_id", "variable", "requested_days", n("found_days").alias("found_days"),
        (n("found_rows") - n("found_days")).alias("repeated_rows"),
        n("found_missing").alias("found_missing"), n("found_traces").alias("found_traces"),
        ((n("found_days") == F.col("requested_days"))
         & (n("found_missing") == F.col("missing_days"))
         & (n("found_traces") == F.col("trace_days"))).alias("matches"))


def mapping_check(mapping: DataFrame, catalog: DataFrame, stations: DataFrame) -> DataFrame:
    """Business-station mapping against catalog and stations, coordinates within 1e-7."""
    far = lambda a, b: F.abs(F.col(a).try_cast("double") - F.col(b)) > 1e-7
    c = catalog.select("business_id", F.col("latitude").alias("_blat"),
                       F.col("longitude").alias("_blon"))
    s = stations.select("station_id", F.col("latitude").alias("_slat"),
                        F.col("longitude").alias("_slon")).distinct()
    mapped = F.col("status") == "mapped"
    bad = (
        F.when(F.col("_blat").isNull(), "not in catalog")
        .when(far("latitude", "_blat") | far("longitude", "_blon"), "business moved")
        .when(mapped & F.col("_slat").isNull(), "station not in manifest")
        .when(mapped & (far("station_latitude", "_slat") | far("station_longitude", "_slon")),
              "station moved")
        .when(~mapped & (F.coalesce("station_id", F.lit("")) != ""), "unmapped row has a station")
    )
    return mapping.join(c, "business_id", "left").join(s, "station_id", "left").select(
        "business_id", "status", "station_id", bad.alias("violation"))


# ---- boundaries ---------------------------------------------------------------------------

FEATURES = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.StructType([T.StructField("postal_code", T.StringType())])),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
])))])


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Features keyed by ZIP with parsed polygons (Polygon becomes a one-part list)."""
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(
        F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    ring = "array<array<array<double>>>"
    return rows.select(
        F.col("f.properties.postal_code").alias("postal_code"), kind.alias("kind"),
        F.when(kind == "Polygon", F.array(F.from_json(text, ring)))
        .when(kind == "MultiPolygon", F.from_json(text, f"array<{ring}>")).alias("polygons"))


def repeated_labels(rows: DataFrame) -> DataFrame:
    """Labels that more than one feature carries."""
    return rows.groupBy("postal_code").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def unique_boundaries(rows: DataFrame) -> DataFrame:
    """The same features; a repeated label fails the job, as it would multiply what is joined to it."""
    once = F.when(F.col("copies") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("repeated boundary label "), F.col("postal_code"))).cast("boolean"))
    return rows.groupBy("postal_code").agg(
        F.any_value("polygons").alias("polygons"), F.count(F.lit(1)).alias("copies")).where(once).drop("copies")


def boundary_violation() -> Column:
    """Why a boundary is unusable: label, type, closed rings, three points, WGS84 bounds."""
    def bad_point(p: Column) -> Column:
        return F.coalesce(
            (F.size(p) != 2) | F.isnan(p[0]) | F.isnan(p[1])
            | ~p[0].between(-180, 180) | ~p[1].between(-90, 90), F.lit(True))

    def open_ring(r: Column) -> Column:
        return (F.size(r) < 4) | (F.element_at(r, 1) != F.element_at(r, -1))

    rings = F.flatten("polygons")
    return (
        F.when(~F.coalesce(F.col("postal_code").rlike("^[0-9]{5}$"), F.lit(False)), "label")
        .when(F.col("polygons").isNull() | (F.size("polygons") == 0), "geometry")
        .when(F.exists("polygons", lambda p: F.size(p) == 0), "no rings")
        .when(F.exists(rings, open_ring), "ring not closed")
        .when(F.exists(rings, lambda r: F.exists(r, bad_point)), "coordinates")
        .when(F.exists(rings, lambda r: F.size(F.array_distinct(r)) < 3), "no area")
    )
