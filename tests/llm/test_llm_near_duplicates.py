import random
import re
from collections import defaultdict

from footmark.llm.components import components
from footmark.llm.near_duplicates import MinHash, near_duplicates

SCHEMA = "doc_id long, text string, cls string, bucket string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        least = min(groups[find(i)], default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return out


def check(spark, rows, params=MinHash()):
    docs = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA)
    got = near_duplicates(docs, params).select("doc_id", "n_shingles", "component_id", "kept").collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows), key=order)


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    check(spark, [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE  two"), (10, text), (11, text.upper()),
                  (11, text.upper()), (None, text), (None, "lonely words here"), (12, text + " more"), (13, "é É"), (14, "É é")])


def test_groups_chains_and_stragglers_equal_brute_force(spark):
    rng = random.Random(3)
    base = [f"b{rng.randrange(500)}" for _ in range(200)]
    rows, previous = [(i, None) for i in range(2)], list(base)
    for i in range(10, 60):  # near copies of one base at many distances
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    for i in range(60, 90):  # a chain in which only neighbours are similar
        previous = list(previous)
        previous[(i * 7) % 200] = f"c{i}"
        rows.append((i, " ".join(previous)))
    rows += [(i, " ".join(f"r{rng.randrange(50)}" for _ in range(40))) for i in range(90, 120)]
    check(spark, rows)
    check(spark, rows, MinHash(block=4, salt_rows=3, broadcast_rows=1))


def test_many_rows_without_an_id_or_with_one_id(spark):
    rows = [(None if i < 400 else 9, f"p{i // 2} " * 3 + " ".join(f"x{i // 2}y{j}" for j in range(30)) + " z" * (i % 2))
            for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).groupBy("doc_id", "class_id", "component_id").count().collect()
    assert sum(r["count"] for r in got) == 800 and len({r.class_id for r in got}) == 800
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (9, 9)}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_paths_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
