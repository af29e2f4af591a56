import math

import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from footmark.llm.token_counts import ForwardTrie, count_tokens, unigram_scores

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCORES = unigram_scores(PATH)
TRIE = ForwardTrie(SCORES)


def brute(piece, scores):
    best = [(0.0, 0)] + [None] * len(piece)
    for i in range(1, len(piece) + 1):
        for j in range(i):
            if best[j] is not None and piece[j:i] in scores:
                new = (best[j][0] + scores[piece[j:i]], best[j][1] + 1)
                if best[i] is None or (-new[0], new[1]) < (-best[i][0], best[i][1]):
                    best[i] = new
    return best[-1][1] if best[-1] else -1


def test_scores_are_a_distribution():
    assert math.fsum(map(math.exp, SCORES.values())) == __import__("pytest").approx(1.0)


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=40))
def test_terminal_counts_equal_brute_force(text):
    assert TRIE.insert(text.encode()) == brute(text.encode(), SCORES)


def test_shared_prefixes_are_scored_once_and_gaps_are_told():
    trie = ForwardTrie({b"a": -1.0, b"ab": -1.5, b"b": -1.0, b"abc": -9.0})
    assert [trie.insert(x) for x in (b"ab", b"abab", b"abd", b"")] == [1, 2, -1, 0]
    assert len(trie.best) == 6


def test_rows_nulls_and_repeats(spark):
    texts = [(1, "Hello the world"), (1, "Hello the world"), (None, None), (2, ""), (3, "word " * 2000 + "x" * 3000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, n_tokens int")
    want = []
    for i, text in texts:
        pieces = regex.findall(public_tokenizers.PATTERN, text or "")
        want.append((i, len(pieces), sum(brute(p.encode(), SCORES) for p in pieces if len(p) < 100)
                     + sum(TRIE.insert(p.encode()) for p in pieces if len(p) >= 100)))
    got = [tuple(r) for r in count_tokens(docs, PATH, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert count_tokens(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
