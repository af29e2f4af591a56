import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from footmark.functions.dates import Span
from footmark.sinks import tables as sink
from footmark.sources import files


def write(tmp_path, text, name="data.jsonl"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines_skip_blank_and_fail_on_bad(spark, tmp_path):
    good = write(tmp_path, '{"business_id": "a", "date": "x"}\n\n   \n{"business_id": "b"}\n')
    assert files.json_lines(spark, good, files.CHECKIN).count() == 2
    for bad in ('{"business_id": ', '["a"]', '"text"', '{"business_id": "b"}{"business_id": "c"}', '{"business_id": "b"} junk',
                '{"business_id": "b"}, {"business_id": "c"}', '{"business_id": "b"}]', 'null'):
        with pytest.raises(Exception):
            files.json_lines(spark, write(tmp_path, bad + "\n", "bad.jsonl"), files.CHECKIN).collect()


def test_repeated_boundary_labels_are_refused(spark):
    rows = spark.createDataFrame([("12345", [[[[0.0, 0.0]]]]), ("12346", [[[[0.0, 0.0]]]]), ("12345", [[[[1.0, 0.0]]]])],
                                 "postal_code string, polygons array<array<array<array<double>>>>")
    assert [tuple(r) for r in files.repeated_labels(rows).collect()] == [("12345", 2)]
    assert files.unique_boundaries(rows.limit(2)).count() == 2
    with pytest.raises(Exception, match="repeated boundary label"):
        files.unique_boundaries(rows).collect()


def test_checkins_repeat_and_coverage(spark):
    raw = spark.createDataFrame(
        [("a", "2020-01-01 05:00:00, 2020-01-01 05:59:59,, 2020-01-01 06:00:00"),
         ("a", "2020-01-01 05:00:00,2021-01-01 00:00:00")], files.CHECKIN)
    entries = files.checkin_entries(raw)
    cov = Span(date(2020, 1, 1), date(2020, 12, 31))
    assert {(r["hour"], r["n"]) for r in files.hourly_buckets(entries, cov).collect()} == {(5, 3), (6, 1)}
    assert tuple(files.outside_coverage(entries, cov).first()) == (4, 1)


@pytest.mark.parametrize("stamp", [
    "2020-01-01T05:00:00Z", "2020-01-01 05:00:00+02:00", "soon", "2020", "2020-01", "2020-01-01 05:00:00 UTC",
    "2020-01-01 05:00:00+05", "2020-01-01 05:00:00 Europe/Paris", "2020-02-30 05:00:00", "2020-01-01 25:00:00"])
def test_zoned_or_unreadable_stamps_fail(spark, stamp):
    with pytest.raises(Exception):
        files.checkin_entries(spark.createDataFrame([("a", stamp)], files.CHECKIN)).collect()


def listing(**change):
    row = dict(business_id="b1", name="N", address="", city="  pHiLa  town ", state=" pa ",
               postal_code="19103", latitude="39.95", longitude="-75.1", categories="Coffee & Tea, Cafes,, Cafes ",
               stars="4.5", review_count="3", is_open="1")
    row.update(change)
    return tuple(row[f] for f in files.LISTING.fieldNames())


def read(spark, *rows):
    scopes = spark.createDataFrame([("Phila Town", "PA")], "canonical_city string, canonical_state string")
    return files.listings(spark.createDataFrame(list(rows), files.LISTING), scopes)


def test_listing_scope_tags_and_zip(spark):
    rows = read(spark, listing(), listing(business_id="b2", state="NJ"),
                listing(business_id="b3", postal_code="19103-1234", latitude="", stars=None)).orderBy(
                    "business_id").collect()
    assert [r["business_id"] for r in rows] == ["b1", "b3"]
    assert rows[0]["categories"] == ["Coffee & Tea", "Cafes"] and rows[0]["usable_postal_code"] == "19103"
    assert rows[1]["usable_postal_code"] is None and rows[1]["latitude"] is None and rows[1]["violation"] is None


@pytest.mark.parametrize("change", [
    {"latitude": "91"}, {"longitude": "abc"}, {"stars": "5.5"}, {"stars": "-1"}, {"review_count": "-1"},
    {"review_count": "x"}, {"is_open": "2"}, {"business_id": ""}, {"latitude": "NaN"}])
def test_listing_violations_fail(spark, change):
    rows = read(spark, listing(**change))
    assert rows.first()["violation"]
    with pytest.raises(Exception):
        files.require_valid(rows).collect()


def test_review_rules(spark):
    raw = [("1", "b", "5.0", "2020-01-01 10:00:00"), ("2", "b", "4.5", "2020-01-01"), ("3", "b", "6", "2020-01-01"),
           (" ", "b", "3", "2020-01-01"), ("5", "", "3", "2020-01-01"), ("6", "b", "3", "2020-01-01T00:00:00Z"),
           ("7", "b", "1", "2020-01-01")]
    rows = files.review_records(spark.createDataFrame(raw, files.REVIEW)).collect()
    assert [r["violation"] is None for r in rows] == [True, False, False, False, False, False, True]
    assert rows[0]["day"] == date(2020, 1, 1)


def test_csv_header_must_match(spark, tmp_path):
    names = files.MAPPING_CSV.fieldNames()
    ok = write(tmp_path, ",".join(names) + "\n" + ",".join("x" for _ in names) + "\n", "ok.csv")
    assert files.csv_exact(spark, ok, files.MAPPING_CSV).count() == 1
    swapped = write(tmp_path, ",".join(reversed(names)) + "\n" + ",".join("x" for _ in names) + "\n", "no.csv")
    with pytest.raises(Exception):
        files.csv_exact(spark, swapped, files.MAPPING_CSV).collect()
    with pytest.raises(ValueError):
        files.csv_with(spark, ok, ["STATION"])


def test_fingerprint_equals_hashlib(spark, tmp_path):
    path = tmp_path / "big.bin"
    path.write_bytes(b"abc" * 700_000)
    row = files.fingerprints(spark, str(path)).first()
    assert row["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and row["length"] == 2_100_000


@pytest.mark.parametrize("geometry,verdict", [
    ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', None),
    ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}', None),
    ('{"type":"Point","coordinates":[0,0]}', "geometry"),
    ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}', "ring not closed"),
    ('{"type":"Polygon","coordinates":[[[0,0],[181,0],[1,1],[0,0]]]}', "coordinates"),
    ('{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0],[0,0]]]}', "no area"),
    ('{"type":"MultiPolygon","coordinates":[]}', "geometry"),
    ('{"type":"Polygon","coordinates":[]}', "no rings")])
def test_boundaries(spark, tmp_path, geometry, verdict):
    text = '{"features":[{"properties":{"postal_code":"19103"},"geometry":%s}]}' % geometry
    rows = files.boundaries(spark, write(tmp_path, text, "b.json"))
    assert rows.select(files.boundary_violation().alias("v")).first()["v"] == verdict


def test_station_row_rules(spark):
    stations = spark.createDataFrame([("S", "Name", 1.0, 2.0)],
                                     "station_id string, name string, latitude double, longitude double")
    base = dict(station_id="S", station_name="Name", station_latitude="1.0", station_longitude="2.0",
                date="2020-01-02", variable="pcpn", value="0.1", unit="inch", raw_value="0.1", flag="", is_trace="0")
    def row(**c):
        r = {**base, **c}
        return tuple(r.get(f, "") for f in files.STATION_CSV.fieldNames())
    cases = [({}, None), ({"station_id": "Z"}, "unknown station"), ({"unit": "mm"}, "unit"),
             ({"station_latitude": "1.1"}, "station metadata differs"), ({"date": "2021-01-01"}, "date outside coverage"),
             ({"value": "0.2"}, "normalized value differs"), ({"is_trace": "1"}, "trace"),
             ({"flag": "M"}, "missing flag with a number"), ({"raw_value": "M", "value": "", "flag": "M"}, None),
             ({"raw_value": "T", "value": "0", "flag": "T", "is_trace": "1"}, None),
             ({"raw_value": "-1", "value": "-1"}, "negative rain")]
    raw = spark.createDataFrame([row(**c) for c, _ in cases], files.STATION_CSV)
    got = files.station_rows(raw, stations, Span(date(2020, 1, 1), date(2020, 12, 31))).select("violation").collect()
    assert sorted(str(r["violation"]) for r in got) == sorted(str(v) for _, v in cases)


def test_publish_serves_the_latest_complete_version(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in (3, 5):
        sink.publish(spark.range(n), root, F.lit("{}"))
    assert sink.published(spark, root).count() == 5


def test_partition_replace_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "p")
    sink.replace_partitions(spark.createDataFrame([(1, "a"), (2, "a")], "v int, k string").unionByName(
        spark.createDataFrame([(3, "b")], "v int, k string")), path, ["k"])
    sink.replace_partitions(spark.createDataFrame([(9, "a")], "v int, k string"), path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_merge_and_guard(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int")
    got = {r["k"]: (r["v"], r["action"]) for r in sink.merge_areas(old, new, ["k"]).collect()}
    assert got == {"a": (1, "kept"), "b": (5, "updated"), "c": (6, "inserted")}
    cells = spark.createDataFrame([("=1",), ("+1",), ("-1",), ("@x",), ("a=1",)], "t string")
    guarded = [r["g"] for r in cells.select(sink.formula_guard(F.col("t")).alias("g")).collect()]
    assert guarded == ["'=1", "'+1", "'-1", "'@x", "a=1"]


def test_digest_trees_of_files_and_what_has_become_of_them(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(files, "NODE", 2)
    folder = tmp_path / "held"
    (folder / "deep").mkdir(parents=True)
    contents = {"a.bin": b"1", "b.bin": bytes(range(256)) * 20_000, "deep/c.bin": b"x" * (1 << 20)}
    for name, content in contents.items():
        (folder / name).write_bytes(content)

    def tree(content):
        h = lambda x: hashlib.sha256(x).hexdigest()
        chunks = [h(content[i:i + (1 << 20)]) for i in range(0, max(len(content), 1), 1 << 20)]
        nodes = [h("".join(chunks[i:i + 2]).encode()) for i in range(0, len(chunks), 2)]
        return h("".join(nodes).encode())

    manifest = files.file_manifest(spark, str(folder)).collect()
    assert {r["file"]: (r["length"], r["digest"]) for r in manifest} == {n: (len(c), tree(c)) for n, c in contents.items()}
    made = spark.createDataFrame(manifest)
    files.verified(spark, str(folder), made)
    changed = bytearray(contents["b.bin"])
    changed[3_000_000] ^= 1
    (folder / "b.bin").write_bytes(bytes(changed))
    (folder / "deep/c.bin").unlink()
    (folder / "new.bin").write_bytes(b"1")
    got = {r["file"]: r["verdict"] for r in files.file_verdicts(spark, str(folder), made).collect()}
    assert got == {"a.bin": "ok", "b.bin": "changed", "deep/c.bin": "missing", "new.bin": "extra"}
    with pytest.raises(ValueError, match="b.bin: changed"):
        files.verified(spark, str(folder), made)
