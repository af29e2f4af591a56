import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footmark.llm import resampling
from footmark.llm.queries import op13_resampling

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text, most):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return [" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets=10_000, most=1, least=20, percent=10):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    found = [[place(f) for f in features(t, most)] for _, t in docs]
    s = Counter(b for d in found for b in d)
    t = Counter(place(f) for x in target for f in features(x, most))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for (i, _), d in zip(docs, found):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, d))
        rows.append((i, len(d), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    out = [(*r, n if n <= len(fit) * percent // 100 else None) for n, r in enumerate(fit, 1)]
    return sorted(out + [(*r, None) for r in rows if r[1] < least], key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=8), st.integers(0, 3))
def test_checksums_of_spans_equal_the_library(spans, gap):
    start = np.cumsum([0] + [len(s) + gap for s in spans[:-1]])
    raw = np.frombuffer(b"".join(s + bytes(gap) for s in spans), np.uint8)
    got = resampling.span_crcs(raw, start, start + [len(s) for s in spans])
    assert got.tolist() == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("length", [1, 63, 64, 65, 128, 1000, 100_003, 1 << 18, 300_001])
def test_long_spans_are_folded(length):
    raw = np.frombuffer(random.Random(length).randbytes(length), np.uint8)
    assert resampling.span_crcs(raw, np.array([0]), np.array([length])).tolist() == [zlib.crc32(raw.tobytes())]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.sampled_from(["A b-C", "ÄÖ éa9", "x" * 200 + " Y"])), max_size=6),
       st.integers(1, 3))
def test_features_of_a_batch_equal_brute_force(texts, most):
    got, first = resampling.features(pa.array(texts, pa.string()), 1000, most)
    for n, text in enumerate(texts):
        wanted = [zlib.crc32(f.encode()) % 1000 for f in features(text, most)]
        assert sorted(got[first[n]:first[n + 1]].tolist()) == sorted(wanted)


def rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)] + ["Ünder", "x" * 90, "9"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [docs[3], docs[3], (None, docs[4][1]), (None, docs[4][1]), (None, None), (500, None), (501, ""),
             (502, "long text, " * 30_000), (503, "y" * 300_000)]
    return docs, [t for _, t in docs[:5]] + [None, "", "w1 w2 w3"]


@pytest.mark.parametrize("most", [1, 2])
def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark, most):
    docs, target = rows()
    df = spark.createDataFrame([(i, t, 0, "r") for i, t in docs], "doc_id long, text string, rank int, row string").repartition(4)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = found(resampling.resample(df, aim, 500, most))
    assert got == brute(docs, target, 500, most)


def test_empty_tables(spark):
    docs, target = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert resampling.resample(df.where("false"), aim).count() == 0
    assert found(resampling.resample(df, aim.where("false"))) == brute(docs, [])


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = op13_resampling(spark, SF)
    assert got.columns == COLUMNS and found(got) == brute(docs, target)
