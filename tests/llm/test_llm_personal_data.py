import re

import pytest

from footmark.llm.personal_data import Bootstrap, base_spans, find

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


CASES = [
    "", "a@b.c", "x a@b.c_d@e.f y", "@@a@b", "a@b@c.d", "a@b. c@d.e.", "a.@b-.c-", "é@b.c", "a@b.c@d.e", "%+-@1.2",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "1..2.3.4", "0001.2.3.4", "00000256.1.1.1", "999.1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111  1111 1111 1111", "12 4111111111111111", "0" * 13, "0" * 20,
    "+1 (415) 555-2671", "+1", "+12", "++1 415 555 2671.", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+49 30 1234567 +1 415 555 2671",
    "+1 (415) 555-2671 4111 1111 1111 1111", "😀 a@b.c 😀 1.2.3.4", "mail a@b.co\n+1 4155552671\n10.0.0.1",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_equal_the_plain_patterns(text):
    assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "1 " * 100_000):
        base_spans(text)


def test_contexts_discover_unseen_identifiers_and_leave_others_alone(spark):
    rows = [(i, f"Note {i}. Please call me at +1 415 555 {1000 + i} soon.") for i in range(20)]
    rows += [(100, "Please call me at (415) 555-2671 soon."), (101, "part number is 415 555 2672 today"),
             (102, None), (103, ""), (100, "Please call me at (415) 555-2671 soon."), (None, "call me at 4155552673")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = find(docs, Bootstrap()).collect()
    assert len(got) == len(rows)
    added = sorted((r.doc_id or 0, [tuple(x) for x in r.added]) for r in got if r.added)
    assert added == [(0, [(3, 11, 21)]), (100, [(3, 18, 32)]), (100, [(3, 18, 32)])]
    assert sum(len(r.base) for r in got) == 20
    assert find(docs.where("false")).count() == 0


def test_few_seeds_trust_no_context(spark):
    rows = [(1, "call me at +1 415 555 1000"), (2, "call me at +1 415 555 1000"), (3, "call me at 415 555 1001")]
    assert not any(r.added for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def found(spark, rows):
    got = find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id for r in got if r.added}, {r.doc_id: [tuple(x) for x in r.added] for r in got}


def test_instances_that_are_found_teach_the_next_context(spark):
    unseen = [f"4155552{i}00" for i in range(100, 116)]
    rows = [(i, f"a{i} b{i} call me on +1 415 555 1{100 + i} x{i} y{i}") for i in range(12)]
    rows += [(100 + i, f"c{i} d{i} call me on {n} w{i} z{i}") for i, n in enumerate(unseen[:8])]
    rows += [(200 + i, f"e{i} f{i} desk line {n} v{i} u{i}") for i, n in enumerate(unseen)]
    rows += [(300 + i, f"g{i} order number {n} s{i} t{i}") for i, n in enumerate(unseen[12:])]
    ids, _ = found(spark, rows)
    # The first context finds eight numbers; by them the second is trusted and finds eight more.
    assert ids >= {*range(100, 108), *range(200, 216)} and not ids & set(range(12))


def test_labels_at_the_start_of_a_line_and_words_after(spark):
    rows = [(i, f"Name{i}\nPhone: +1 415 555 1{100 + i}\nx") for i in range(12)]
    rows += [(100 + i, f"Other{i}\nPhone: (415) 555-2{100 + i}\ny") for i in range(5)]
    rows += [(200 + i, f"k{i} l{i} m{i}@mail{i}.org is my address") for i in range(12)]
    rows += [(300, "p q someone (at) host (dot) org is my address"), (301, "she looked at and. is my address"),
             (302, "we met at noon. is my address"), (400, "Part: (415) 555-2999\nz")]
    ids, spans = found(spark, rows)
    assert ids == {*range(100, 105), 300} and spans[300] == [(0, 4, 31)]


def brute_result(rows, params=Bootstrap()):
    """Counts, digest text and added spans of every row, with the graph kept in dictionaries."""
    from collections import defaultdict
    from math import exp, log1p

    from footmark.llm.personal_data import _contexts, _loose_spans, _plain
    seen, edges, belief = [], set(), {}
    for doc, text in rows:
        text = text or ""
        base = brute(text)
        loose = _loose_spans(text, base)
        seen.append((doc, text, base, loose))
        for spans, value in ((base, 1.0), (loose, None)):
            for k, a, b in spans:
                one = (k, _plain(k, text[a:b]))
                belief[one] = value or belief.get(one)
                edges |= {(k, c, one) for c in _contexts(text, a, b, params.reach)}
    by_pattern, trusted, sure = defaultdict(set), {}, None
    for k, c, one in edges:
        by_pattern[k, c].add(one)
    linked = {one for _, _, one in edges}
    while sure != (sure := {i for i in linked if (belief[i] or 0) >= params.promoted}):
        trusted = {}
        for (k, c), ones in by_pattern.items():
            score, seeds = sum(0.5 if belief[i] is None else belief[i] for i in ones) / len(ones), sum(i in sure for i in ones)
            weak = c.startswith("1 ")
            if score >= (params.weak_score if weak else params.least_score) and seeds >= params.least_seeds * (1 + weak):
                trusted[k, c] = score
        for one in linked:
            scores = [trusted[k, c] for k, c in by_pattern if (k, c) in trusted and one in by_pattern[k, c]]
            if scores:
                belief[one] = max(belief[one] or 0, 1 - exp(sum(log1p(-min(x, 0.999)) for x in scores)))
    return [(doc, base, [(k, a, b) for k, a, b in loose if any((k, c) in trusted for c in _contexts(text, a, b, params.reach))])
            for doc, text, base, loose in seen]


def test_query_equals_brute_force(spark, tmp_path):
    import hashlib
    import random

    from footmark.llm.personal_data import KINDS
    from footmark.llm.queries import op4_personal_data

    rng, rows = random.Random(4), []
    for i in range(160):
        number = f"{rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}"
        label = rng.choice(["call me at", "ring", "order no", "Tel:"])
        rows.append((i if i % 9 else None, rng.choice(["", "word "]) + f"{label} {rng.choice(['+1 ', ''])}{number} "
                     + rng.choice(["", "today please", "mail a.b@c.org", "x 10.0.0.1", "4111 1111 1111 1111"])))
    rows += [(500, None), (501, ""), (502, "é" * 50_000 + " call me at 415 555 2671 today please")]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row long, base string").write.parquet(
        str(tmp_path / "documents.parquet"))
    shown = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
    want = [(doc, *[sum(k == n for k, _, _ in base) for n in range(4)], hashlib.sha256(shown(sorted(base)).encode()).hexdigest(),
             shown(sorted(base + added))) for doc, base, added in brute_result(rows)]
    got = op4_personal_data(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert any(added for _, _, added in brute_result(rows))
