import pytest
from pyspark.sql import functions as F

from footmark.sinks import versions as vs


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, n long")


ADD = {"n": lambda old, new: old + new}


def test_of_two_writers_only_the_first_wins(spark, root):
    seen = vs.current(spark, root)
    assert seen.number == 0 and seen.rows is None
    assert vs.commit(vs.upsert(None, table(spark, [(1, 5), (2, 6)]), ["k"], ADD), root, seen) == 1
    both = vs.current(spark, root)
    assert vs.commit(vs.upsert(both.rows, table(spark, [(2, 1), (3, 1)]), ["k"], ADD), root, both) == 2
    with pytest.raises(vs.StaleWrite):
        vs.commit(vs.upsert(both.rows, table(spark, [(9, 9)]), ["k"], ADD), root, both)
    newest = vs.current(spark, root)
    assert newest.number == 2
    assert sorted(map(tuple, newest.rows.select("k", "n", "revision").collect())) == [(1, 5, 1), (2, 7, 2), (3, 1, 1)]
    assert vs.commit(vs.upsert(newest.rows, table(spark, [(9, 9)]), ["k"], ADD), root, newest) == 3


def test_upsert_of_empty_tables_and_null_values(spark, root):
    known = vs.upsert(None, table(spark, [(1, None)]), ["k"], ADD)
    assert [tuple(r) for r in vs.upsert(known, table(spark, []), ["k"], ADD).collect()] == [(1, None, 1)]
    assert [tuple(r) for r in vs.upsert(known.where("false"), table(spark, [(2, 1)]), ["k"], ADD).collect()] == [(2, 1, 1)]


def bundle(spark, extra=0, revision="r1", parent=None):
    own = spark.range(50).select("id", (F.col("id") * 0.5 + extra).alias("own"))
    shared = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "scope string, theta array<double>")
    return vs.Bundle({"own": own, "shared": shared, "none": own.where("false")}, revision, parent)


def test_bundles_load_only_whole_unchanged_and_new(spark, root):
    vs.publish_bundle(spark, root, "one", bundle(spark))
    assert vs.bundle_problem(spark, root, "one", "r1") is None
    parts = vs.load_bundle(spark, root, "one", "r1")
    assert parts["own"].count() == 50 and parts["none"].count() == 0 and parts["shared"].count() == 2
    assert vs.bundle_problem(spark, root, "one", "r2") == "stale revision"
    vs.publish_bundle(spark, root, "twin", bundle(spark))
    assert not vs.create_once(spark, f"{root}/twin/manifest.json", {"status": "other"})
    vs.write_parts(spark, root, "half", bundle(spark))  # the writer is lost before the second phase
    assert vs.bundle_problem(spark, root, "half", "r1") == "no manifest"
    vs.publish_bundle(spark, root, "hurt", bundle(spark))
    vs.publish_bundle(spark, root, "child", bundle(spark, 1, "r1", "hurt"))
    assert vs.bundle_problem(spark, root, "child", "r1") is None
    bundle(spark, 1e-9).parts["own"].write.mode("overwrite").parquet(f"{root}/hurt/own")
    assert vs.bundle_problem(spark, root, "hurt", "r1") == "changed part: own"
    assert vs.bundle_problem(spark, root, "child", "r1") == "parent: changed part: own"
    vs.remove(spark, f"{root}/one/shared")
    with pytest.raises(ValueError, match="missing part: shared"):
        vs.load_bundle(spark, root, "one", "r1")


def test_revision_follows_content_not_order(spark):
    rows = table(spark, [(1, 2), (3, None)])
    assert vs.table_revision(rows) == vs.table_revision(rows.orderBy(F.desc("k")).repartition(3))
    assert vs.table_revision(rows) != vs.table_revision(table(spark, [(1, 2), (3, 0)]))
    assert vs.table_revision(rows.where("false")) == "empty"


def test_a_run_goes_on_after_its_last_complete_stage(spark, root):
    run, calls = vs.Run(spark, root), []

    def work(stage, fail=False):
        def make():
            calls.append(stage)
            if fail:
                raise RuntimeError("lost")
            return table(spark, [(len(calls), 1)])
        return make

    with pytest.raises(RuntimeError):
        run.resume({"first": work("first"), "second": work("second", fail=True), "third": work("third")})
    run.select("first", "a")
    with pytest.raises(ValueError):
        run.select("second", "a")
    out = run.resume({"first": work("first"), "second": work("second"), "third": work("third")})
    assert calls == ["first", "second", "second", "third"]
    assert [out[s].first()["k"] for s in ("first", "second", "third")] == [1, 3, 4]
    run.select("first", "a")
    with pytest.raises(vs.StaleWrite, match="frozen"):
        run.select("first", "b")
    states = {r["stage"]: (r["state"], r["attempts"], r["selected"]) for r in run.states().rows.collect()}
    assert states == {"first": ("complete", 1, "a"), "second": ("complete", 2, None), "third": ("complete", 1, None)}
