"""Ranks, running totals and exact quantiles for groups too large for one task.

``row_number().over(partitionBy(group))`` places a whole group in one task. Here the rows
are range partitioned on (group, order), so a group holding a third of the table spans as
many tasks as its size needs. What is local to a range slice is combined with the offset of
the slices before it; there are at most (slices + groups) offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.session import checkpointed


def _sort_columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _sliced(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Range slices in final order, written out so that both later reads see one placement."""
    keys = [F.col(g).asc() for g in group] + _sort_columns(order)
    return checkpointed(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright(F.col("_at"), 33))
    )


def _with_offsets(rows: DataFrame, group: Sequence[str], offsets: DataFrame) -> DataFrame:
    keys = [*group, "_slice"]
    renamed = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                             *[c for c in offsets.columns if c not in keys])
    on = None
    for k in keys:
        term = rows[k].eqNullSafe(renamed[f"_k_{k}"])
        on = term if on is None else on & term
    return rows.join(renamed, on, "inner").drop(*[f"_k_{k}" for k in keys])


def _offsets(slices: DataFrame, group: Sequence[str]) -> DataFrame:
    """Exclusive prefix and group total; one row per (group, slice), a few per group."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumns({
        "_before": F.coalesce(F.sum("_part").over(before), F.lit(0)),
        "_total": F.sum("_part").over(whole),
    }).drop("_part")


def rank_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """1-based row number inside each group. ``order`` must end in a unique key."""
    rows = _sliced(df, group, order)
    slices = rows.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_part"), F.min("_at").alias("_first")
    )
    return (
        _with_offsets(rows, group, _offsets(slices, group))
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + F.lit(1))
        .drop("_at", "_slice", "_before", "_total", "_first")
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    weight: str,
    name: str = "running",
    total: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` inside each group, and optionally the group total."""
    rows = _sliced(df, group, order)
    slices = rows.groupBy(*group, "_slice").agg(F.sum(weight).alias("_part"))
    local = Window.partitionBy(*group, "_slice").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, 0
    )
    out = _with_offsets(
        rows.withColumn(name, F.sum(weight).over(local)), group, _offsets(slices, group)
    ).withColumn(name, F.col(name) + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_at", "_slice", "_before", "_total")


def value_positions(
    df: DataFrame, group: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Distinct (group, value) with ``n_equal``, ``n_before`` (smaller) and ``n_total``.

    Nulls and NaN take no part. The map-side count shrinks repeated values before any sort.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*group, value)
        .agg(n.cast("long").alias("n_equal"))
    )
    return running_totals(
        counted, group, [F.col(value).asc()], "n_equal", "_through", "n_total"
    ).withColumn("n_before", F.col("_through") - F.col("n_equal")).drop("_through")


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linear quantiles at (n - 1) * p, the definition of ``percentile`` and numpy.

    Two order statistics per quantile are picked from the value positions, so no task holds
    a group's values.
    """
    positions = value_positions(df, group, value, weight)
    v = F.col(value).cast("double")
    picks = {}
    for name, p in probabilities.items():
        at = (F.col("n_total") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n_equal"))
            picks[f"_{name}_{side}"] = F.max(F.when(inside, v))
    picked = positions.groupBy(*group).agg(
        F.max("n_total").alias("_n"), *[c.alias(k) for k, c in picks.items()]
    )
    out = {}
    for name, p in probabilities.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out[name] = lo + (hi - lo) * (at - F.floor(at))
    return picked.select(*group, *[c.alias(k) for k, c in out.items()])


def average_percentiles(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """(average ascending rank - 1) / (n - 1); one value gives 0.5; nulls stay null."""
    positions = value_positions(df, group, value).select(
        *group,
        F.col(value),
        F.when(
            F.col("n_total") > 1,
            (F.col("n_before") + (F.col("n_equal") - 1) / F.lit(2.0)) / (F.col("n_total") - 1),
        ).otherwise(F.lit(0.5)).alias(name),
    )
    return df.join(positions, [*group, value], "left")
