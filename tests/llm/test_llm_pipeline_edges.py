"""Every stage on empty tables, nulls in any column, repeated rows and columns with clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, epoch int, number long, row long, "
          "component_id string, digest long")
STAGES = dict(corpus_pipeline.STAGES)


def docs(spark):
    text = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, text, "en", "web01"), (1, text, "en", "web01"), (2, text + " more", None, None), (None, text, "de", "src7"),
            (None, None, None, None), (4, "", "", ""), (5, " \n\t", "fr", "src1"), (6, "é" * 30_000, "en", "src2"),
            (7, "\n".join([text] * 300), "en", "src2")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 3, 9, 8, "c", 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows_and_on_none(spark, name):
    odd, last = docs(spark), name == corpus_pipeline.STAGES[-1][0]
    got = STAGES[name](spark, odd, SF)
    none = STAGES[name](spark, odd.where("false"), SF)
    assert got.columns == none.columns and none.count() == 0
    if last:
        assert got.count() == odd.count() and got.where("doc_id IS NULL").count() == 2
        return
    assert [c for c in odd.columns if c != "epoch"] == [c for c in got.columns if c != "epoch"]
    assert got.where("kept != 'k' OR number != 9 OR row != 8 OR component_id != 'c' OR digest != 5").count() == 0
    ids = {r.doc_id for r in got.collect()}
    assert ids <= {1, 2, 4, 5, 6, 7, None}
    if name == "line dedup":
        assert got.count() == odd.count() and got.where("text IS NULL").count() == 1
        assert got.where(~F.col("n_chars").eqNullSafe(F.length("text"))).count() == 0
    if name == "near duplicates":
        assert sorted(map(repr, [r.doc_id for r in got.collect()])) == sorted(map(repr, [1, None, 4, 5, 6]))
