import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from footmark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.Ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.rank, special_tokens={})


def split(text):
    import regex

    return [p.encode() for p in regex.findall(public_tokenizers.PATTERN, text)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library_and_decode_back(text):
    ids = [i for part in RANKS.encode(split(text)) for i in part.tolist()]
    assert ids == LIBRARY.encode_ordinary(text)
    assert RANKS.decode(np.array(ids, np.int32)) == text.encode()


def test_every_code_point_splits_as_in_the_library():
    for low in range(0, 0x30000, 256):
        text = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}  " for c in range(low, low + 256) if not 0xD800 <= c < 0xE000)
        assert [i for part in RANKS.encode(split(text)) for i in part.tolist()] == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("letters", ["a", "ab", "the of", "éà"])
def test_long_pieces_run_alone_with_the_same_result(letters):
    rng = random.Random(1)
    piece = "".join(rng.choice(letters.replace(" ", "")) for _ in range(3000)).encode()
    assert RANKS._merge_alone(piece).tolist() == LIBRARY._encode_single_piece(piece)
    short = piece[:300].decode(errors="ignore").encode()
    assert RANKS.encode([short])[0].tolist() == LIBRARY._encode_single_piece(short)


def test_rows_nulls_repeats_and_clashing_columns(spark):
    texts = [(1, "Hello  world\n", "x"), (1, "Hello  world\n", "x"), (None, "ñandú 😀", "y"), (3, None, "z"), (4, "", "z")]
    docs = spark.createDataFrame([(i, t, n, 0) for i, t, n in texts], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.encode(docs, PATH, public_tokenizers.PATTERN, tuple(bpe.OUTPUTS)).collect()
    assert len(rows) == 5
    for row, (i, text, _) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(
            texts, key=lambda r: (r[0] is None, r[0] or 0))):
        ids = LIBRARY.encode_ordinary(text or "")
        assert row.ids == ids and row.n_tokens == len(ids) and bytes(row.decoded) == (text or "").encode()
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded).decode() for r in bpe.decode(encoded, PATH).collect()) == sorted(t or "" for _, t, _ in texts)
    assert bpe.encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
