import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from footmark.llm import filter_audit
from footmark.llm.queries import op12_filter_audit

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(docs):
    """One set of letters for each (id, text), by the definitions."""
    out = []
    for i, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A"} if len(words) < 200 else set()
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            failed.add("C")
        if re.search(r"[#$%&*|]", text):
            failed.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t in docs):
            failed.add("E")
        out.append(failed)
    return out


def brute(docs, labels):
    """The rows of the audit, by applying every order to every document."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    failed, parts = failures([d[:2] for d in docs]), defaultdict(list)
    for (i, _, source), f in zip(docs, failed):
        parts[source or ""].append((i, f))
    rows, shares = [], Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shares[part, letter] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone),
                             sum(letter in f for _, f in members) - len(gone), sum(f == {letter} for _, f in members),
                             sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in rows)


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


DOCS = [
    (1, " ".join(f"w{i}" for i in range(250)), "a"), (2, " ".join(f"w{i}" for i in range(250)), "a"),
    (2, " ".join(f"w{i}" for i in range(250)), "b"), (None, " ".join(f"w{i}" for i in range(250)), None),
    (3, "same same " * 150, "a"), (4, "same same " * 150, ""), (5, None, None), (6, "", None), (7, "SHOUT # $", "b"),
    (7, "SHOUT # $", "b"), (None, None, "b"), (8, "word \x0b\x1c wörd  " * 40_000, "c"), (9, "É" * 10 + "A", "c"),
    (10, " \n ", "c"), (11, "%", "c")]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (4, 1, None), (None, 1, 1), (7, 1, 1), (99, 1, 1)]


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*d, 0, "x") for d in docs],
                                  "doc_id long, text string, source string, mask int, digest string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_nulls_repeats_long_texts_and_clashing_columns_equal_brute_force(spark):
    docs, labels = frames(spark, DOCS, LABELS)
    assert found(filter_audit.audit(filter_audit.mask_counts(filter_audit.masks(docs), labels))) == brute(DOCS, LABELS)


@pytest.mark.parametrize("digest", [lambda t: F.length(t).cast("long") % 3, lambda t: F.lit(1).cast("long")])
def test_texts_with_one_digest_are_compared_in_full(spark, digest):
    docs, _ = frames(spark, DOCS, LABELS)
    got = Counter((r.doc_id, r.mask) for r in filter_audit.masks(docs, digest).collect())
    wanted = [(i, sum(1 << "ABCDE".index(c) for c in f)) for (i, *_), f in zip(DOCS, failures([d[:2] for d in DOCS]))]
    assert got == Counter(wanted)


def test_counters_clear_unique_digests_and_never_a_repeated_one(spark):
    rows = [(n,) for n in range(2000)] + [(n,) for n in range(0, 2000, 10)]
    digests = spark.createDataFrame(rows, "digest long")
    blocks = len(rows) * filter_audit.COUNTERS // filter_audit.BLOCK
    counters = filter_audit.repeated_counters(digests, blocks)
    left = Counter(r.digest for r in filter_audit.possible_repeats(digests, counters, blocks).collect())
    assert all(left[n] == 2 for n in range(0, 2000, 10))
    assert sum(n % 10 != 0 for n in left) < 40


def test_large_tables_are_joined_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SENT", 0)
    docs, labels = frames(spark, DOCS, LABELS)
    assert found(filter_audit.audit(filter_audit.mask_counts(filter_audit.masks(docs), labels))) == brute(DOCS, LABELS)


def test_empty_tables_give_no_rows(spark):
    docs, labels = frames(spark, DOCS, LABELS)
    assert filter_audit.audit(filter_audit.mask_counts(filter_audit.masks(docs.where("false")), labels)).count() == 0
    none = filter_audit.audit(filter_audit.mask_counts(filter_audit.masks(docs), labels.where("false")))
    assert found(none) == brute(DOCS, [])


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = op12_filter_audit(spark, SF)
    assert got.columns == COLUMNS and found(got) == brute(docs, labels)
