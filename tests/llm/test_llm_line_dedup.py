import hashlib
import random

from test_llm_passage_dedup import brute as cut_passages

from footmark.llm.line_dedup import LineChunks, remove_all, remove_repeated


def number(line):
    return int(hashlib.md5(line.encode()).hexdigest()[:8], 16)


def chunks(text):
    lines, start = text.split("\n"), 0
    for i, line in enumerate(lines):
        before = number(lines[i - 1]) if i else 0
        if i == len(lines) - 1 or (before * 31 + number(line)) % 2 == 0:
            if i > start and "\n".join(lines[start:i + 1]).strip(" \t\n\v\f\r"):
                yield start, i, "\n".join(lines[start:i + 1])
            start = i + 1


def brute(docs):
    first = {}
    for doc, text in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0)):
        for a, _, chunk in chunks(text):
            first.setdefault(chunk, (doc, text, a))
    out = []
    for doc, text in docs:
        if text is None:
            out.append((doc, None, 0))
            continue
        gone = {i for a, z, chunk in chunks(text) if first[chunk] != (doc, text, a) for i in range(a, z + 1)}
        out.append((doc, "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone)))
    return out


def check(spark, docs, params=LineChunks()):
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in docs],
                               "doc_id long, text string, doc_key string, spans int, n_removed_lines int")
    got = remove_repeated(df, params)
    assert got.columns == ["doc_id", "text", "doc_key", "spans", "n_removed_lines"]
    rows = sorted((tuple(r) for r in got.select("doc_id", "text", "n_removed_lines").collect()), key=repr)
    assert rows == sorted(brute(docs), key=repr)
    return sum(r[2] for r in rows)


def test_repeats_everywhere_equal_brute_force(spark):
    rng = random.Random(5)
    passages = [[f"passage {p} line {i} " + "word " * 12 for i in range(rng.randrange(2, 9))] for p in range(4)]
    docs = []
    for d in range(60):
        lines = [f"own {d} {i}" for i in range(rng.randrange(1, 6))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = p
        docs.append((d, "\n".join(lines)))
    assert check(spark, docs) > 50
    check(spark, docs, LineChunks(broadcast_spans=1))


def test_edge_rows(spark):
    same = "\n".join(f"line {i}" for i in range(40))
    docs = [(1, None), (2, ""), (3, "\n\n\n"), (4, same), (4, same), (5, same), (None, same), (6, same + "\n" + same),
            (7, "one line"), (8, "one line"), (9, "tail\n"), (10, "é\nü\né\nü\né\nü")]
    check(spark, docs)
    assert check(spark, []) == 0


def cut_all(docs):
    """Chunks first, then what is left of passages."""
    first = brute(docs)
    return [(d, t, n + m) for (_, _, n), (d, t, m) in zip(first, cut_passages([r[:2] for r in first]))]


def check_all(spark, docs):
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in docs],
                               "doc_id long, text string, doc_key string, spans int, n_removed_lines int")
    got = remove_all(df)
    assert got.columns == ["doc_id", "text", "doc_key", "spans", "n_removed_lines"]
    rows = sorted((tuple(r) for r in got.select("doc_id", "text", "n_removed_lines").collect()), key=repr)
    assert rows == sorted(cut_all(docs), key=repr)
    return {r[0]: r for r in rows}


def test_planted_passages_of_every_length_go_whole(spark):
    rng, docs = random.Random(9), []
    for length in range(1, 13):
        passage = [f"passage {length} line {i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for i in range(length)]
        for copy in range(4):
            own = [f"own {length} {copy} {i} {rng.randrange(10**9)}" for i in range(6)]
            own[copy:copy] = passage
            docs.append((100 * length + copy, "\n".join(own)))
    rows = check_all(spark, docs)
    for length in range(1, 13):
        assert [rows[100 * length + copy][2] for copy in range(4)] == [0, length, length, length]


def test_edge_rows_of_both_steps(spark):
    same = "\n".join(f"line {i}" for i in range(40))
    docs = [(1, None), (2, ""), (3, "\n\n\n"), (4, same), (4, same), (5, same), (None, same), (6, same + "\n" + same),
            (7, "one line"), (8, "one line"), (9, "tail\n"), (10, "é\nü\né\nü\né\nü"), (11, "x " * 30_000 + "\nend"), (12, "x " * 30_000)]
    check_all(spark, docs)
    assert check_all(spark, []) == {}
