"""Mixing sources to target weights by hierarchical budgets.

The levels of a tree (domain, language, source) split a token budget from the root down. A node's
children share its budget by weight; a child that cannot use its share gives the rest to its siblings,
and only what a whole family cannot use goes to the siblings of its parent. Each leaf then reads its
documents in a seeded order, epoch after epoch, and stops before the first document that exceeds its
budget.

Sharing is closed-form per family (sorted by capacity over weight, running sums), and the place where a
leaf stops is found through token sums of hash buckets, so no leaf is ever sorted whole or in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footmark.llm.common import staged

HASH_BITS = 60


@dataclass(frozen=True)
class Mix:
    """Weights by level and value (1 if not named), seed, budget as a percentage of all tokens, most epochs."""

    weights: tuple[dict[str, int], ...] = field(default_factory=lambda: ({}, {}, {}))
    seed: int = 7
    budget_percent: int = 80
    epochs: int = 2
    bucket_bits: int = 12


def token_count(text: Column) -> Column:
    """Words: maximal runs of characters other than space and tab to carriage return; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: Column | int, epoch: Column, key: Column) -> Column:
    """A number of 60 bits that places a document in an epoch."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _weight(level: int, value: Column, mix: Mix) -> Column:
    known = mix.weights[level]
    if not known:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for item in known.items() for x in item])
    return F.coalesce(F.try_element_at(table, value), F.lit(1)).cast("long")


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children that have ``capacity``, ``weight`` and the parent's budget ``given``."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    active = (F.col("weight") > 0) & (F.col("capacity") > 0)
    wide = lambda c: c.cast("decimal(38,0)")
    order = family.orderBy(F.when(active, 0).otherwise(1), F.col("capacity").cast("double") / F.greatest("weight", F.lit(1)), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    w = F.when(active, F.col("weight")).otherwise(F.lit(0))
    c = F.when(active, F.col("capacity")).otherwise(F.lit(0))
    marked = (nodes.withColumn("w", w).withColumn("c", c)
              .withColumn("c_before", F.coalesce(F.sum("c").over(before), F.lit(0)))
              .withColumn("w_onward", F.sum("w").over(onward))
              .withColumn("full", active & (wide(F.col("c")) * F.col("w_onward") <= wide(F.col("w")) * (F.col("given") - F.col("c_before")))))
    open_ = marked.withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("c")).otherwise(0)).over(family)) \
        .withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(family))
    part = F.expr("least(c, cast((cast(w as decimal(38,0)) * left) div greatest(w_open, 1) as bigint))")
    budget = F.when(F.col("full"), F.col("c")).when(active, part).otherwise(F.lit(0)).cast("long")
    return open_.withColumn("budget", budget).drop("w", "c", "c_before", "w_onward", "full", "left", "w_open", "given")


def leaf_budgets(leaves: DataFrame, levels: list[str], mix: Mix) -> DataFrame:
    """(levels, tokens, budget, alive) for leaves that have ``tokens``; budgets in whole tokens, rounded down.

    A leaf is alive if no weight on its path is 0.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    total = leaves.agg(F.expr(f"cast(coalesce(sum(tokens), 0) * {mix.budget_percent} div 100 as bigint)").alias("given"))
    known = None
    for depth, name in enumerate(levels):
        path = levels[:depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(depth, F.col(name), mix))
        if known is None:
            total = total.withColumns({"one": F.lit(1), "above": F.lit(True)})
            nodes = nodes.withColumn("one", F.lit(1)).join(total, "one").drop("one")
        else:
            nodes = nodes.join(known.withColumnsRenamed({"budget": "given", "alive": "above"}), levels[:depth])
        shared = _share(nodes, levels[:depth], name).withColumn("alive", F.col("above") & (F.col("weight") > 0))
        known = shared.select(*path, "budget", "alive")
    return shared.select(*levels, "tokens", "budget", "alive")


def cuts(rows: DataFrame, budgets: DataFrame, levels: list[str], mix: Mix) -> DataFrame:
    """(levels, whole, cut): a leaf's full epochs, and the last draw that it takes from the next one.

    ``rows`` has the levels, ``key`` and ``tokens`` of every document. A leaf's draws fall in 2^bucket_bits
    buckets; running sums over buckets find the one in which the budget ends, and only that bucket's
    documents are put in order. Rows of one draw (a repeated id) are taken together or not at all. Of a leaf
    without tokens every document is taken once, if it is alive.
    """
    plan = (budgets.where("tokens > 0 OR alive").withColumn("whole", F.expr("if(tokens > 0, budget div tokens, 0)"))
            .withColumn("rest", F.expr("if(tokens > 0, budget % tokens, 0)")).select(*levels, "whole", "rest"))
    drawn = rows.join(plan, levels).withColumn("draw", draw(mix.seed, F.col("whole"), F.col("key")))
    shift = HASH_BITS - mix.bucket_bits
    drawn = drawn.withColumn("bucket", F.shiftright("draw", shift))
    leaf = Window.partitionBy(*levels)
    upto = lambda c: leaf.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    sums = (drawn.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("tokens"), F.min("rest").alias("rest"))
            .withColumn("total", F.sum("tokens").over(upto("bucket"))))
    open_ = (sums.where("total > rest").groupBy(*levels)
             .agg(F.min_by(F.struct("bucket", (F.col("total") - F.col("tokens")).alias("passed")), "bucket").alias("at"))
             .select(*levels, F.col("at.bucket").alias("bucket"), F.col("at.passed").alias("passed")))
    inside = (drawn.join(open_, [*levels, "bucket"]).groupBy(*levels, "draw")
              .agg(F.sum("tokens").alias("tokens"), F.min("rest").alias("rest"), F.min("passed").alias("passed"))
              .withColumn("total", F.col("passed") + F.sum("tokens").over(upto("draw"))))
    last = inside.groupBy(*levels).agg(F.min(F.when(F.col("total") > F.col("rest"), F.col("draw"))).alias("refused"))
    return (plan.join(last, levels, "left")
            .select(*levels, "whole", F.coalesce(F.col("refused") - 1, F.lit((1 << HASH_BITS) - 1)).alias("cut")))


def mixed(docs: DataFrame, levels: dict[str, Column], mix: Mix = Mix(), key: str = "doc_id",
          tokens: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, once for every epoch that takes them, and ``epoch``.

    ``levels`` names the tree from the root down; a null value is a branch of its own, named ''.
    Tokens are words unless another expression is given; a document without tokens costs nothing and goes
    with its leaf's draw, once where the whole leaf has no tokens. Leaves of weight 0 get nothing. Repeated rows of one id share their draw and
    are taken together. A column ``epoch`` of the input is replaced. No rows give no rows.
    """
    names = [f"level_{n}" for n in levels]
    values = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())]
    count = token_count(F.col("text")) if tokens is None else tokens
    rows = staged(docs.select(*values, F.col(key).alias("key"), F.coalesce(count, F.lit(0)).cast("long").alias("tokens")), "mix")
    budgets = staged(leaf_budgets(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), names, mix), "budgets")
    ends = staged(cuts(rows, budgets, names, mix), "cuts")
    columns = [F.col(f"row.`{c}`") for c in docs.columns if c != "epoch"]
    packed = docs.select(*values, F.struct("*").alias("row")).join(ends, names)
    more = (draw(mix.seed, F.col("whole"), F.col(f"row.`{key}`")) <= F.col("cut")).cast("long")
    times = F.least(F.col("whole") + more, F.lit(mix.epochs))
    return (packed.withColumn("times", times).where("times > 0")
            .select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch")))
