import random

from footmark.llm.line_dedup import Passages, remove_passages, remove_repeated

SPACE = " \t\n\v\f\r"


def words(line):
    return len("".join(" " if c in SPACE else c for c in line).split(" ")) - \
        "".join(" " if c in SPACE else c for c in line).split(" ").count("")


def brute(docs, least=8):
    """(doc_id, text, lines cut) by the rule on pairs and wordy lines; ids order the documents."""
    seen, gone = {}, {}
    for doc, text in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0)):
        lines = text.split("\n")
        for i in range(len(lines)):
            for last in (i, i + 1):
                piece = lines[i:last + 1]
                if last < len(lines) and (words(lines[i]) >= least if last == i else any(map(words, piece))):
                    if seen.setdefault("\n".join(piece), (doc, i)) != (doc, i):
                        gone.setdefault((doc, text), set()).update(range(i, last + 1))
    out = []
    for doc, text in docs:
        cut = gone.get((doc, text), set())
        out.append((doc, text if text is None else "\n".join(
            x for i, x in enumerate(text.split("\n")) if i not in cut), len(cut)))
    return out


def check(spark, docs, params=Passages()):
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in docs],
                               "doc_id long, text string, doc_key string, spans int, n_removed_lines int")
    got = remove_passages(df, params)
    assert got.columns == ["doc_id", "text", "doc_key", "spans", "n_removed_lines"]
    rows = sorted((tuple(r) for r in got.select("doc_id", "text", "n_removed_lines").collect()), key=repr)
    assert rows == sorted(brute(docs, params.least_words), key=repr)
    return rows


def planted(rng):
    """Passages of 1 to 12 lines, each in three documents between lines of their own."""
    docs, doc = [], 0
    for size in range(1, 13):
        for p in range(4):
            passage = [f"passage {size} {p} line {i} " + "word " * (9 if size == 1 else rng.randrange(6)) for i in range(size)]
            for _ in range(3):
                docs.append((doc, [f"own {doc} a"], passage, [f"own {doc} {i}" for i in range(rng.randrange(3))]))
                doc += 1
    return docs


def test_planted_passages_of_1_to_12_lines_stay_only_once(spark):
    docs = planted(random.Random(3))
    rows = dict((d, (t, n)) for d, t, n in check(spark, [(d, "\n".join(a + p + z)) for d, a, p, z in docs]))
    for d, a, p, z in docs:
        first = d % 3 == 0
        assert rows[d] == ("\n".join(a + (p if first else []) + z), 0 if first else len(p))


def test_the_chunk_rule_leaves_some_of_them(spark):
    docs = planted(random.Random(3))
    df = spark.createDataFrame([(d, "\n".join(a + p + z)) for d, a, p, z in docs], "doc_id long, text string")
    cut = dict(remove_repeated(df).select("doc_id", "n_removed_lines").collect())
    assert sum(cut.values()) < sum(len(p) for d, _, p, _ in docs if d % 3)


def test_random_lines_equal_brute_force_and_no_line_vanishes(spark):
    rng = random.Random(8)
    pool = ["", " \t", "a", "b", "é ü", "x\r", "one two three four five six seven", "1 2 3 4 5 6 7 8", " 1 2 3 4 5 6 7  8 "]
    docs = [(d if d % 9 else None, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for d in range(1, 60)]
    docs = [(d, t) for n, (d, t) in enumerate(docs) if d is not None or n == 8]
    rows = check(spark, docs)
    check(spark, docs, Passages(least_words=2))
    assert {x for _, t in docs for x in t.split("\n")} <= {x for _, t, _ in rows for x in t.split("\n")}


def test_edge_rows(spark):
    same = "\n".join(f"line {i}" for i in range(40))
    check(spark, [(1, None), (2, ""), (3, "\n\n\n"), (4, same), (4, same), (5, same), (None, same), (6, same + "\n" + same),
                  (7, "one line"), (8, "one line"), (9, "tail\n"), (10, "é\nü\né\nü\né\nü"), (11, "1 2 3 4 5 6 7 8"),
                  (12, "1 2 3 4 5 6 7 8")])
    assert check(spark, []) == []
