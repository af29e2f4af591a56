import random
import re
from collections import Counter

import pytest

from footmark.llm.quality import QualityRules, judge, keep_rows, labelled_sample

SF = "/root/testdata/sf0.1"


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), dup, len(covered), failed


def test_base_measures_of_edge_rows(spark):
    texts = [None, "", " \t\n", "a b a b a b", "x\ny\nx\n \n ", "é ü#*|<>&%$ ñ z", "a\x0bb\x0cc\rd\x1ce", "long " * 30_000,
             "\n".join(["same line here"] * 60), " ".join(f"w{i}" for i in range(80)), "😀 x" * 3]
    docs = spark.createDataFrame([(i % 9, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r)[1:7] for r in judge(docs, labels).collect())
    assert got == sorted(measures(t or "") for t in texts)
    assert all(r.kept == (not r.base_failed) for r in judge(docs, labels).collect())
    kept = keep_rows(docs, labels)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == [texts[9]]
    assert judge(docs.where("false"), labels).count() == 0


def test_rows_of_several_slices_keep_their_verdicts(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([10, 9000]))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    want = {i for i, t in enumerate(texts) if len(t.split()) >= 50}
    assert {r[0] for r in keep_rows(docs, labels).select("doc_id").collect()} == want
    assert {r.doc_id for r in judge(docs, labels).where("kept").collect()} == want


def test_held_out_rows_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    params = QualityRules()
    used = {r[0] for r in labelled_sample(docs, labels, params).select("doc_id").collect()}
    rows = judge(docs, labels, params).join(labels, "doc_id").collect()
    held = [r for r in rows if r.doc_id not in used and not r.base_failed]
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert len(good) > 300 and len(bad) > 30
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)
    gap = sum(r.probability for r in held) / len(held) - len(good) / len(held)
    assert gap == pytest.approx(0, abs=0.05)
