import math
import random

from footmark.llm.vector_search import MTree, top_k

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, k, every):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for q, v in {x for x in usable if x[0] % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def check(spark, rows, params=MTree(), k=5, every=5):
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, top_k(df, k, every, params).collect())) == brute(rows, k, every)


def vectors(rng, n, size):
    return [(i, [float(f"{rng.gauss(0, 0.3):.3f}") for _ in range(size)]) for i in range(n)]


def test_random_and_equal_vectors_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [round(x * 64) / 64 for x in v]) for i, v in vectors(rng, 500, 6)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)]
    check(spark, rows, MTree(page_rows=70, leaf_rows=8, fanout=4, pivots=5, block_queries=4, blocks_held=3, pages_held=2))


def test_edge_rows(spark):
    rng = random.Random(4)
    rows = [(i, [round(x * 64) / 64 for x in v]) for i, v in vectors(rng, 30, 3)]
    rows += [(5, None), (10, [1.0, None, 2.0]), (15, [float("nan"), 0.0, 0.0]), (20, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
             (35, [0.25, 0.5]), (36, [0.5, 0.25]), (40, []), (41, []), rows[0], rows[7], (50, [0.0, 0.0, 0.0])]
    check(spark, rows)
    check(spark, rows[:3], k=9)


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
