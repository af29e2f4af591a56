import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from footmark.llm.mixing import Mix, leaf_budgets, mixed

SCHEMA = "doc_id long, text string, domain string, lang string, source string, draw int, epoch string"
MIX = Mix(weights=({"a": 3, "z": 0}, {"en": 5}, {}), budget_percent=70, bucket_bits=3)


def levels():
    return {"domain": F.col("domain"), "lang": F.col("lang"), "source": F.col("source")}


def split(budget, children):
    """Children as {name: (weight, capacity)}; shortages go to the siblings, rounded down."""
    out, left, budget = {n: 0 for n in children}, {n for n, (w, c) in children.items() if w and c}, Fraction(budget)
    while left:
        total = sum(children[n][0] for n in left)
        full = {n for n in left if children[n][1] * total <= children[n][0] * budget}
        if not full:
            for n in left:
                out[n] = int(children[n][0] * budget // total)
            break
        least = min(Fraction(children[n][1], children[n][0]) for n in full)
        for n in [n for n in full if Fraction(children[n][1], children[n][0]) == least]:
            out[n] = children[n][1]
            budget -= children[n][1]
            left.discard(n)
    return out


def brute_budgets(leaves, mix):
    """leaves: {(domain, lang, source): tokens}."""
    def go(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        children = {}
        for leaf, tokens in leaves.items():
            if leaf[:len(prefix)] == prefix:
                name = leaf[len(prefix)]
                children[name] = (mix.weights[len(prefix)].get(name, 1), children.get(name, (0, 0))[1] + tokens * mix.epochs)
        return {k: v for n, b in split(budget, children).items() for k, v in go((*prefix, n), b).items()}

    return go((), sum(leaves.values()) * mix.budget_percent // 100)


def brute(rows, mix):
    leaf = lambda r: tuple(x or "" for x in r[2:5])
    size = lambda r: len((r[1] or "").split())
    total = defaultdict(int)
    for r in rows:
        total[leaf(r)] += size(r)
    out = []
    for key, budget in brute_budgets(total, mix).items():
        if not total[key] and not all(mix.weights[n].get(x, 1) for n, x in enumerate(key)):
            continue
        whole, rest = divmod(budget, total[key]) if total[key] else (0, 0)
        own, by_draw = [r for r in rows if leaf(r) == key], defaultdict(int)
        draw = lambda r: int(hashlib.md5(f"{mix.seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)  # noqa: E731,B023
        for r in own:
            by_draw[draw(r)] += size(r)
        taken, used = set(), 0
        for d in sorted(by_draw):
            if used + by_draw[d] > rest:
                break
            used += by_draw[d]
            taken.add(d)
        out += [(*r[:5], e) for r in own for e in range(min(mix.epochs, whole + (draw(r) in taken)))]
    return out


def rows_of(rng, n):
    return [(rng.choice([None, *range(n)]) if i % 50 == 0 else i, " ".join(["w"] * rng.randrange(0, 30)) if i % 17 else None,
             rng.choice("aaabcz"), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", None]), 1, "e") for i in range(n)]


def test_mixture_equals_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(random.Random(seed), 400)
        got = mixed(spark.createDataFrame(rows, SCHEMA), levels(), MIX)
        assert got.columns == ["doc_id", "text", "domain", "lang", "source", "draw", "epoch"]
        assert sorted((tuple(r) for r in got.drop("draw").collect()), key=repr) == sorted(brute(rows, MIX), key=repr)


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("a", "de", "s1"): 1000, ("b", "en", "s1"): 1000}
    mix = Mix(budget_percent=50, epochs=1)
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "d string, l string, s string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in leaf_budgets(df, ["d", "l", "s"], mix).collect()}
    assert got == brute_budgets(leaves, mix)
    assert got["a", "en", "s1"] == 10 and got["a", "en", "s2"] == 366 and got["a", "de", "s1"] == 376


def test_empty_table_and_texts(spark):
    assert mixed(spark.createDataFrame([], SCHEMA), levels(), MIX).count() == 0
    none = [(1, None, None, None, None, 1, "e"), (2, "", "a", "en", "s", 1, "e")]
    got = mixed(spark.createDataFrame(none, SCHEMA), levels(), MIX)
    assert sorted((r.doc_id, r.epoch) for r in got.collect()) == [(1, 0), (2, 0)]


def test_a_leaf_without_tokens_keeps_its_documents_once(spark):
    rows = [(i, "w " * 10, "a", "en", "s1", 1, "e") for i in range(20)] + [(100 + i, "", "a", "en", "empty", 1, "e") for i in range(5)]
    rows += [(200 + i, None, "z", "en", "s1", 1, "e") for i in range(3)] + [(300, " \n", "b", "de", "s1", 1, "e")]
    got = mixed(spark.createDataFrame(rows, SCHEMA), levels(), MIX)
    assert sorted((tuple(r) for r in got.drop("draw").collect()), key=repr) == sorted(brute(rows, MIX), key=repr)
    assert {r.doc_id for r in got.where("doc_id >= 100").collect()} == {*range(100, 105), 300}
