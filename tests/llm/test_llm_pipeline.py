import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_llm_line_dedup import brute as cut_lines
from test_llm_mixing import brute as mix_brute
from test_llm_near_duplicates import brute as near_brute
from test_llm_quality import measures

from footmark.llm.bpe import Ranks
from footmark.llm.queries import RANK_FILE, TARGETS

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def domain(source):
    number = int(source[3:]) // 5
    return ("web", "news", "books", "forum")[min(number, 3)]


def test_each_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    start = rows(docs)
    first = stages["quality rules"](spark, docs, SF)
    assert first.columns == docs.columns
    kept, labels = rows(first), dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    assert set(kept) <= set(start)
    for row in start:
        if row not in kept:
            assert measures(row[1] or "")[5] or labels.get(row[0], 0) == 0
    assert not any(measures(r[1] or "")[5] for r in kept)

    second = stages["line dedup"](spark, first, SF)
    want = sorted(((d, t, *r[2:4], len(t)) for (d, t, _), r in zip(cut_lines([r[:2] for r in kept]), kept)), key=repr)
    assert second.columns == docs.columns and rows(second) == want

    third = stages["near duplicates"](spark, second, SF)
    alone = {r[0] for r in near_brute([r[:2] for r in want]) if r[3]}
    singles = [r for r in want if r[0] in alone]
    assert third.columns == docs.columns and rows(third) == singles and len(singles) < len(want)

    fourth = stages["mixing"](spark, third, SF)
    mixture = mix_brute([(r[0], r[1], domain(r[3]), r[2], r[3]) for r in singles], TARGETS)
    assert fourth.columns == docs.columns
    assert sorted((r[0], r[1]) for r in rows(fourth)) == sorted((r[0], r[1]) for r in mixture)

    ranks = Ranks(public_tokenizers.path(RANK_FILE)).rank
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] for r in singles}
    fifth = stages["bpe"](spark, fourth, SF).collect()
    assert sorted(r.doc_id for r in fifth) == sorted(r[0] for r in mixture)
    for r in fifth:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage_and_rows_may_repeat(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (None, text), (4, "other words")],
                                 "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, text), (3, None), (4, "other words")]
