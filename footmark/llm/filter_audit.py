"""How filters interact: what each removes at each step of every order, from additive counts of failure masks.

Only one filter looks beyond its own document: whether a smaller id has the same text. A counting Bloom
filter, kept as a table of counters, goes first. Every task adds up the counters of its own documents (the
map side of the aggregation is its sketch), the shuffle merges the sketches, and a document with a counter
of one is proven unique. Only the texts of possible repeats are shuffled, to be compared in full.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.llm.common import small_side, staged

#: The filters in the order of their bits.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Counters of a document, and probes: about one unique text in 200 is not cleared.
COUNTERS, PROBES, BLOCK = 16, 3, 1024
#: Numbers sent to every task at most, as a table of blocks or of digests.
SENT = 2_000_000


def with_own_mask(rows: DataFrame) -> DataFrame:
    """``rows`` with ``mask``: the bits of the filters that look at one text alone (A to D)."""
    text = F.col("text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = rows.withColumn("words", words).withColumns({
        "words": F.size("words"), "distinct": F.size(F.array_distinct("words")),
        "capitals": F.regexp_count(text, F.lit("[A-Z]"))})
    failures = (F.col("words") < 200, 100 * F.col("distinct") < 50 * F.col("words"),
                100 * F.col("capitals") > 2 * F.length(text), text.rlike(r"[#$%&*|]"))
    mask = sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(failures)), F.lit(0))
    return counted.withColumn("mask", mask).drop("words", "distinct", "capitals")


def _probes(blocks: int) -> tuple[Column, Column]:
    """A digest's block and its distinct positions there."""
    block = F.pmod(F.xxhash64("digest", F.lit(0)), F.lit(blocks))
    return block, F.array_distinct(F.array(*[
        F.pmod(F.xxhash64("digest", F.lit(n + 1)), F.lit(BLOCK)).cast("int") for n in range(PROBES)]))


def repeated_counters(digests: DataFrame, blocks: int) -> DataFrame:
    """(block, positions): the counters that at least two rows of ``digest`` have hit.

    A row counts once in each of its counters, so a row with a counter that is not listed is the only one
    with its digest. The array has at most ``BLOCK`` values.
    """
    block, positions = _probes(blocks)
    slots = digests.select(block.alias("block"), F.explode(positions).alias("position"))
    counters = slots.groupBy("block", "position").count().where("count > 1")
    return counters.groupBy("block").agg(F.collect_list("position").alias("positions"))


def possible_repeats(rows: DataFrame, counters: DataFrame, blocks: int) -> DataFrame:
    """The rows all of whose counters are listed."""
    block, positions = _probes(blocks)
    listed = small_side(counters.withColumnRenamed("positions", "listed"), SENT, F.size("listed"))
    found = rows.withColumns({"block": block, "positions": positions}).join(listed, "block")
    return found.where(F.size(F.array_except("positions", "listed")) == 0).drop("block", "positions", "listed")


def _digested(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text")).withColumn(
        "digest", digest(F.col("text")))


def masks(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs``: the failures of its text as bits, A first.

    Filter E holds a row against all rows with the same whole text, a null one being empty: it fails if any
    of them has a smaller id. A null id is not smaller than others and has none smaller. Rows that repeat
    id and text do not fail for each other's sake. ``digest`` may collide: texts that share one are compared
    in full.
    """
    whole = _digested(docs, digest)
    rows = staged(with_own_mask(whole).drop("text"), "masks")
    blocks = max(1, rows.count() * COUNTERS // BLOCK)
    counters = staged(repeated_counters(rows, blocks), "counters")
    texts = possible_repeats(whole.select("doc_id", "text", "digest"), counters, blocks).groupBy("digest", "text").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    # A digest of one text stands for it, as the grouping by whole texts has shown.
    firsts = staged(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least"),
                                                F.sum("rows").alias("rows")).where("rows > 1"), "firsts")
    alone = small_side(firsts.where("texts = 1").select("digest", "least"), SENT // 2)
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * REPEATED
    found = rows.join(small_side(firsts.where("texts > 1").select("digest"), SENT // 2), "digest", "left_anti").join(
        alone, "digest", "left").select("doc_id", "part", (F.col("mask") + later).alias("mask"))
    mixed = firsts.where("texts > 1").select("digest")
    if mixed.isEmpty():
        return found
    shared = with_own_mask(whole.join(small_side(mixed, SENT // 2), "digest", "left_semi"))
    least = shared.groupBy("text").agg(F.min("doc_id").alias("least"))
    return found.unionByName(shared.join(least, "text").select("doc_id", "part", (F.col("mask") + later).alias("mask")))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows, and rows whose id is labelled as quality 1 or toxic 1.

    An id labelled twice has a mark if any of its labels has it; null ids have none.
    """
    marked = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                          F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return masks.join(small_side(marked, SENT // 4), "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), counted("good"), counted("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """Every part's figures at each step of every order of the filters, from its counts by mask (all long).

    A step removes what fails its filter and none before it, so its figures hang on the filter and on the
    set of filters before it alone: 80 sums over at most 32 counts a part, picked by order and step.
    """
    every = 1 << len(FILTERS)
    by_mask = counts.groupBy("part").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(every)]).alias(c)
        for c in ("n", "good", "toxic")])
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = by_mask.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    bits = lambda holds: sum(
        (F.when(holds(at), 1 << bit).otherwise(0) for bit, at in enumerate(place.values())), F.lit(0))
    steps = steps.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})

    def over(counted: str, holds: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.transform(counted, lambda v, m: F.when(holds(m), v).otherwise(F.lit(0).cast("long"))),
                           F.lit(0).cast("long"), lambda a, v: a + v).alias(counted)

    def fails(m: Column) -> Column:
        return m.bitwiseAND(F.col("own")) != 0

    def gone(m: Column) -> Column:
        return m.bitwiseAND(F.col("before")) != 0

    removed = steps.select(
        "part", "filter_order", "step", "own", over("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        over("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        over("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        over("n", lambda m: m == F.col("own")).alias("unique_fails"),
        over("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        over("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"))
    # 120 rows a part and filter.
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))
    return removed.withColumn("shapley", shapley).drop("own")
