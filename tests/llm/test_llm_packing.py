import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from footmark.llm import packing
from footmark.llm.queries import op11_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
SF = "/root/testdata/sf0.001"


def whole(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def decoded(ids):
    return np.frombuffer(bytes(ids), "<u4").tolist()


def best_fit_decreasing(lengths, window):
    """The used lengths of the sequences, by looking at all open windows."""
    used = []
    for length in sorted(lengths, reverse=True):
        open_ = [n for n, u in enumerate(used) if u + length <= window]
        if open_:
            used[max(open_, key=lambda n: used[n])] += length
        else:
            used.append(length)
    return sorted(used)


def check(rows, texts, window):
    """Every id of every text in one piece, sequences gapless and within the window."""
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append(r)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    wanted = defaultdict(list)
    for i, text in texts:
        ids = whole(text)
        wanted[(i, len(ids))].append(ids)
    assert {k: len(v) for k, v in wanted.items()} == {
        k: sum(r.length for r in v) // k[1] for k, v in by_document.items()}
    return by_document, by_sequence, wanted


words = st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12)
odd = ["the", "don't", "DON'T're", "<|endoftext|>", "\u0301", "e\u0301", "İ", "\u3000", "\x85", "ΑΣ", "ÉÀ×÷ß", "ÿŸ", "a1é2!?", "\x00\x1c",
       "x\u00a0y", "ªº", "K", "ﬁ", "각", "𝐀"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(words, st.text(alphabet="aéÉ1!'sТ ×", max_size=8), st.sampled_from(odd)), max_size=12),
       st.sampled_from([" ", "\n", "\t\r", "\x0b", "\x0c ", "\u2003", "\x1c", "\xa0"]))
def test_ids_of_words_are_the_ids_of_the_text(parts, space):
    texts = [space.join(parts), "", " ".join(reversed(parts))]
    got = packing.encoded(packing._words(PATH), pa.array(texts))
    assert [g.tolist() for g in got] == [whole(t)[:-1] for t in texts]


def test_every_code_point_is_encoded_as_in_the_library():
    for low in range(0, 0x30000, 1024):
        chars = [chr(c) for c in range(low, low + 1024) if not 0xD800 <= c < 0xE000]
        texts = ["".join(f"a{c} {c}1{c}é  É{c}'s " for c in chars)] if chars else []
        assert [g.tolist() for g in packing.encoded(packing._words(PATH), pa.array(texts, pa.string()))] == [
            whole(t)[:-1] for t in texts]


def test_long_texts_are_split_at_spaces_and_the_store_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 50)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcé1!") for _ in range(rng.choice((2, 5, 90)))) for _ in range(500))
    words = packing.Words(PATH)
    texts = ["", text, "short one", "x" * 200, text]
    assert [g.tolist() for g in packing.encoded(words, pa.array(texts))] == [whole(t)[:-1] for t in texts]
    assert len(words.words) <= 30 and len(words.word_ids.length) == len(words.words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([32, 33, 40]))
def test_segment_tree_gives_best_fit_decreasing(lengths, window):
    open_, used = packing.OpenWindows(window), []
    for length in sorted(lengths, reverse=True):
        room = open_.tightest(length)
        if room < 0:
            number, room = len(used), window
            used.append(0)
        else:
            number, _ = open_.take(room)
        used[number] += length
        if room > length:
            open_.put(room - length, (number, used[number]))
    assert sorted(used) == best_fit_decreasing(lengths, window)


@pytest.mark.parametrize("least", [4096, 10])
def test_rows_nulls_repeats_very_long_texts_and_clashing_columns(spark, monkeypatch, least):
    monkeypatch.setattr(packing, "GROUP_PIECES", least)
    rng = random.Random(5)
    texts = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, "ñandú 😀"), (None, None), (3, None), (4, ""),
             (5, " ".join(rng.choice(("alpha", "Beta", "12")) for _ in range(30_000))), (6, "x" * 20_000)]
    texts += [(i, "word " * rng.randint(1, 60)) for i in range(7, 60)]
    docs = spark.createDataFrame([(i, t, 0, "s", 1) for i, t in texts],
                                 "doc_id long, text string, start int, ids string, row long").repartition(3)
    packed = packing.pack(docs, PATH, 64)
    rows = packed.collect()
    by_document, by_sequence, wanted = check(rows, texts, 64)
    for key, copies in wanted.items():
        pieces = sorted(by_document[key], key=lambda r: r.start)
        found = [[] for _ in copies]
        for n, r in enumerate(pieces):
            found[n % len(copies)] += decoded(r.ids)
        assert sorted(found) == sorted(copies)
    if least == 4096:
        assert sorted(sum(r.length for r in v) for v in by_sequence.values()) == best_fit_decreasing(
            [r.length for r in rows], 64)
    laid = packing.sequences(packed, 64).collect()
    assert len(laid) == len(by_sequence)
    for r in laid:
        parts = sorted(by_sequence[r.sequence_id], key=lambda p: p.offset)
        assert r.ids[:r.used] == [i for p in parts for i in decoded(p.ids)]
        assert len(r.ids) == 64 or len(r.ids) == r.used and r.used & (r.used - 1) == 0
    assert packing.pack(docs.where("false"), PATH, 64).count() == 0
    assert packing.sequences(packing.pack(docs.where("false"), PATH, 64)).count() == 0


def test_query_packs_every_document_with_little_padding(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_packing(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    _, by_sequence, wanted = check(rows, texts, 2048)
    ids = {i: whole(t) for i, t in texts}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
    total = sum(len(x) for x in ids.values())
    assert len(by_sequence) <= -(-total // 2048) + 2
