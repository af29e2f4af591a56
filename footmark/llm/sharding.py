"""Constant-time shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a step from
its name. Shards take turns (heavier ones more often) and each turn claims the shard's next free slot.
A key's hash picks a slot. Taking a shard away leaves nearly all keys of the others in place.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


@dataclass(frozen=True)
class ShardTable:
    """Shard names in turn order, slots (a prime, well above the shards' number), turns of a shard (1)."""

    shards: tuple[str, ...]
    slots: int = 2039
    turns: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.shards or len(set(self.shards)) != len(self.shards):
            raise ValueError("Shard names must be distinct and there must be one.")
        if not is_prime(self.slots) or self.slots < len(self.shards):
            raise ValueError("The number of slots must be a prime not below the number of shards.")
        if any(self.turns.get(s, 1) < 0 for s in self.shards) or not any(self.turns.get(s, 1) for s in self.shards):
            raise ValueError("Turns must not be negative and some shard must have one.")

    def fill(self) -> list[int]:
        """The shard number of every slot."""
        table, left = [-1] * self.slots, self.slots
        offset = [_digest(f"offset:{s}") % self.slots for s in self.shards]
        step = [_digest(f"step:{s}") % (self.slots - 1) + 1 for s in self.shards]
        tried = [0] * len(self.shards)
        while left:
            for shard, name in enumerate(self.shards):
                for _ in range(self.turns.get(name, 1)):
                    while left:
                        slot = (offset[shard] + tried[shard] * step[shard]) % self.slots
                        tried[shard] += 1
                        if table[slot] < 0:
                            table[slot], left = shard, left - 1
                            break
        return table


def slot_of(key: Column, slots: int) -> Column:
    """A key's slot; a null key is placed like an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, table: ShardTable, key: str = "doc_id") -> DataFrame:
    """(key, slot, shard) for every row; equal keys share a shard, repeated rows are all returned.

    The lookup table has exactly ``slots`` rows, a parameter, and so is broadcast.
    """
    spark = df.sparkSession
    lookup = spark.createDataFrame([(i, table.shards[s]) for i, s in enumerate(table.fill())], "slot long, shard string")
    keyed = df.select(F.col(key).alias(key), slot_of(F.col(key), table.slots).alias("slot"))
    return keyed.join(lookup.hint("broadcast"), "slot").select(key, "slot", "shard")


def write_shards(df: DataFrame, table: ShardTable, path: str, key: str = "doc_id") -> None:
    """Write the rows below ``path`` by shard; several tasks may write one shard, so none is a bottleneck."""
    columns = [F.col(f"`{c}`") for c in df.columns if c != "shard"]
    spark = df.sparkSession
    lookup = spark.createDataFrame([(i, table.shards[s]) for i, s in enumerate(table.fill())], "its_slot long, shard string")
    rows = df.select(F.struct(*columns).alias("row"), slot_of(F.col(f"`{key}`"), table.slots).alias("its_slot"))
    rows.join(lookup.hint("broadcast"), "its_slot").select("row.*", "shard").write.partitionBy("shard").parquet(path)
