from collections import Counter

import pytest

from footmark.llm.sharding import ShardTable, place, write_shards


def test_slots_are_even_and_follow_turns():
    even = Counter(ShardTable(tuple("abcdefg")).fill())
    assert sum(even.values()) == 2039 and max(even.values()) - min(even.values()) <= 1
    heavy = Counter(ShardTable(("a", "b", "c"), turns={"a": 2, "c": 0}).fill())
    assert heavy[0] == pytest.approx(2 * heavy[1], abs=2) and heavy[2] == 0


def test_a_lost_shard_moves_few_other_slots():
    names = tuple(f"s{i}" for i in range(20))
    before, after = ShardTable(names).fill(), ShardTable(names[:-1]).fill()
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.12 * 2039


@pytest.mark.parametrize("bad", [dict(shards=()), dict(shards=("a", "a")), dict(shards=("a",), slots=10),
                                 dict(shards=("a", "b", "c", "d"), slots=3), dict(shards=("a",), turns={"a": 0})])
def test_tables_without_sense_are_refused(bad):
    with pytest.raises(ValueError):
        ShardTable(**bad)


def test_rows_nulls_repeats_and_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (None, None, 6), (3, "", 7)], "doc_id long, shard string, slot int")
    table = ShardTable(("p", "q"), slots=101)
    rows = place(df, table).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert all(table.shards[table.fill()[r.slot]] == r.shard for r in rows)
    write_shards(df, table, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id or 0, r.shard) for r in back.collect()) == sorted((r.doc_id or 0, r.shard) for r in rows)
    assert place(df.where("false"), table).count() == 0
