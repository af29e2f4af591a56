"""Importance resampling towards a target collection, on hashed word runs.

A feature's bucket is the CRC-32 of its bytes. The checksum is linear over XOR: every byte adds a value
that hangs on the byte and on its distance from the feature's end alone, and the length adds a constant.
Those values stand in a table of positions, so the features of a whole Arrow batch cost one table look-up a
byte and one ``bitwise_xor.reduceat`` over their spans. Longer spans are folded block by block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import slices, staged, with_text
from footmark.llm.wordhash import buffers, lowered
from footmark.operators.ordering import rank_rows

#: Bytes of a block: the distances from a feature's end that the table of positions covers.
BLOCK = 64
#: Bytes looked up at once, a power of two, and of the text columns worked on at once.
CHUNK, TEXT_SLICE = 1 << 17, 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _position_table() -> np.ndarray:
    """[distance, byte]: what a byte with so many bytes behind it adds to the checksum."""
    table = np.empty((BLOCK, 256), np.uint32)
    zero = [zlib.crc32(bytes(n)) for n in range(BLOCK + 1)]
    for distance in range(BLOCK):
        table[distance] = [zlib.crc32(bytes([b]) + bytes(distance)) ^ zero[distance + 1] for b in range(256)]
    return table


_POSITIONS = _position_table()
#: What a checksum's own bytes become when a block of zeros follows: four tables of 256 values.
_SHIFT = np.array([[zlib.crc32(bytes(BLOCK), v << (8 * k)) ^ zlib.crc32(bytes(BLOCK), 0) for v in range(256)]
                   for k in range(4)], np.uint32)
_LENGTH = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)


def _shifted(value: np.ndarray, shift: np.ndarray = _SHIFT) -> np.ndarray:
    out = np.zeros_like(value)
    for k in range(4):
        out ^= shift[k][(value >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _chunk_shift() -> np.ndarray:
    """The same four tables for a chunk of zeros: a shift applied to itself is one twice as long."""
    shift, length = _SHIFT, BLOCK
    while length < CHUNK:
        shift, length = _shifted(shift, shift), 2 * length
    return shift


_SHIFT_CHUNK = _chunk_shift()


def _zeros(length: int) -> int:
    """The checksum of so many zero bytes, a block at a time."""
    value = int(_LENGTH[length % BLOCK])
    for _ in range(length // BLOCK):
        value = zlib.crc32(bytes(BLOCK), value)
    return value


def _linear(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What the bytes of every span add up to; spans lie in order, are not empty and do not overlap."""
    # The bytes of all spans side by side, and each byte's distance from the end of its span.
    length = end - start
    upto = np.cumsum(length)
    at = np.arange(upto[-1]) + np.repeat(start - (upto - length), length)
    distance = np.repeat(upto, length) - np.arange(upto[-1]) - 1
    adds = _POSITIONS[distance % BLOCK, raw[at]]
    # Spans are cut into blocks counted from their end, so that only the first block may be short.
    count = -(-length // BLOCK)
    of = np.repeat(np.arange(len(length)), count)
    behind = np.repeat(np.cumsum(count), count) - np.arange(len(of)) - 1
    cut = np.maximum(upto[of] - (behind + 1) * BLOCK, (upto - length)[of])
    blocks = np.bitwise_xor.reduceat(adds, cut)
    first = np.cumsum(count) - count
    out = blocks[first]
    for n in range(1, int(count.max())):  # the n-th block of every span that has one
        longer = np.flatnonzero(count > n)
        out[longer] = _shifted(out[longer]) ^ blocks[first[longer] + n]
    return out


def span_crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of every span ``raw[start:end]``; spans lie in order, are not empty and do not overlap.

    ``CHUNK`` bytes are looked up at once; a longer span is folded chunk by chunk as others are block by block.
    """
    length = end - start
    out, upto, at = np.empty(len(start), np.uint32), np.cumsum(length), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - length[at] + CHUNK, side="right")))
        if length[at] <= CHUNK:
            out[at:to] = _linear(raw, start[at:to], end[at:to])
        else:
            value, head = np.zeros(1, np.uint32), start[at] + length[at] % CHUNK
            if head > start[at]:
                value = _linear(raw, start[at:to], np.array([head]))
            for chunk in range(head, end[at], CHUNK):
                value = _shifted(value, _SHIFT_CHUNK) ^ _linear(raw, np.array([chunk]), np.array([chunk + CHUNK]))
            out[at] = value[0]
        at = to
    constant = _LENGTH[np.minimum(length, BLOCK)]
    for n in np.flatnonzero(length > BLOCK).tolist():
        constant[n] = _zeros(int(length[n]))
    return out ^ constant


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a text column, and for each text the index of its first word (n + 1 values).

    Words are runs of digits, letters a-z and bytes outside ASCII; ``raw`` is lower-cased already.
    """
    letter = np.zeros(len(raw) + 2, dtype=bool)
    letter[1:-1] = _LETTER[raw]
    begins, ends = letter[1:-1] & ~letter[:-2], letter[1:-1] & ~letter[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] |= letter[1:-1][inner]
    ends[inner - 1] |= letter[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def features(texts: pa.Array, buckets: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of all texts, text by text, and the n + 1 offsets of the texts among them.

    Features are the runs of 1 to ``most`` consecutive words of a text, joined by one space.
    """
    raw, offsets = buffers(texts)
    raw = lowered(raw)
    start, end, first = words(raw, offsets)
    found, of = [], []
    length, text = end - start, np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if most > 1 and len(start):  # runs need words one space apart: lay them out anew
        upto = np.cumsum(length + 1)
        at = np.arange(upto[-1] - 1)
        gap = np.repeat(upto, length + 1)[:-1] - at == 1
        laid = raw[np.minimum(at + np.repeat(start - (upto - length - 1), length + 1)[:-1], len(raw) - 1)]
        laid[gap] = 32
        raw, start, end = laid, upto - length - 1, upto - 1
    for run in range(1, most + 1):
        inside = np.flatnonzero(text[run - 1:] == text[:len(text) - run + 1])
        # Runs overlap, so each of the ``run`` sets of disjoint ones has its own spans.
        for turn in range(run):
            mine = inside[inside % run == turn]
            found.append(span_crcs(raw, start[mine], end[mine + run - 1]) % np.uint32(buckets))
            of.append(text[mine])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable") if most > 1 else slice(None)
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(of[order], np.arange(len(offsets)))


def bucket_counts(texts: DataFrame, buckets: int, most: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; a task sends at most ``buckets`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", TEXT_SLICE):
            counts += np.bincount(features(batch["text"], buckets, most)[0], minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], names=["bucket", "n"])

    return with_text(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, most: int, scale: int = 1000) -> np.ndarray:
    """The gain of every bucket: the scaled log of its smoothed share in the target against that in ``docs``.

    The table is as long as the number of buckets, whatever the data.
    """
    source = bucket_counts(docs, buckets, most).withColumnRenamed("n", "s")
    both = source.join(bucket_counts(target, buckets, most).withColumnRenamed("n", "t"), "bucket", "full_outer")
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for bucket, a, b in both.agg(F.collect_list(F.struct("bucket", "s", "t"))).first()[0]:  # at most ``buckets``
        s[bucket], t[bucket] = a or 0, b or 0
    ratio = (t + 1) * float(s.sum() + buckets) / ((s + 1) * float(t.sum() + buckets))
    return np.array([math.floor(scale * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int, key: str = "doc_id") -> DataFrame:
    """(key, n_features, weight): every row's features and the sum of their gains."""
    kind = docs.schema[key].dataType.simpleString()
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_SLICE):
            found, first = features(batch["text"], buckets, most)
            total = np.concatenate([[0], np.cumsum(gain[found])])
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array(np.diff(first), pa.int64()), pa.array(total[first[1:]] - total[first[:-1]], pa.int64())],
                names=[key, "n_features", "weight"])

    return with_text(docs, key).mapInArrow(run, f"`{key}` {kind}, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, most: int = 1, least: int = 20,
             percent: int = 10, seed: int = 2024, scale: int = 1000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs``; the drawn rows have a rank.

    Weights are log importance ratios of bag-of-features models of ``target`` and ``docs``; scores add Gumbel
    noise from a digest of seed and id, so the highest scores are a draw without replacement in proportion to
    the ratios. Drawn are ``percent`` of the rows with at least ``least`` features, ties going to smaller ids, null ids
    last. A null text has no features, a null id the noise of an empty one; rows may repeat, each is judged
    by itself. With no target texts every count there is 0. Other columns are not read.
    """
    gain = gains(docs, target, buckets, most, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(float(-scale)) * F.ln(-F.ln(chance))).cast("long")
    scored = staged(weighed(docs, gain, most).withColumn("score", F.col("weight") + noise).withColumn(
        "row", F.monotonically_increasing_id()), "scored")
    fit = scored.where(F.col("n_features") >= least)
    draws = fit.count() * percent // 100
    # The row number parts repeated ids, so that equal rows do not gather in one range.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = rank_rows(fit, [], order).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")).cast("long"))
    short = scored.where(F.col("n_features") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(short).drop("row")
