"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

A document's set holds the distinct 5-word shingles of its lower-cased words. Texts with the same set
form a class; minima, bands and comparisons exist once per class. Two rounds find every link that
matters for components:

1. In each band bucket, all members are compared with the bucket's smallest member (a star).
2. Buckets whose members still lie in several components are compared across components, in blocks;
   a pair is looked at once, and only confirmed links leave a task.

Both rounds first ask the signatures (agreement below 0.55 of 160 minima has a chance of about 3e-9
for a true link) and then the full sets: texts move only for classes that have a likely partner. A pair
of similarity 0.75 shares none of the 40 bands with a chance of 2.5e-7. Nothing caps buckets, members or
partners.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm import wordhash
from footmark.llm.common import drop_staged, runs, slices, small_side, staged, with_text
from footmark.llm.components import components


@dataclass(frozen=True)
class MinHash:
    """Parameters: minima, rows of a band, similarity in percent, signature floor, block of a bucket."""

    minima: int = 160
    rows: int = 4
    percent: int = 75
    signature_floor: float = 0.55
    block: int = 512
    salt_rows: int = 256
    broadcast_rows: int = 500_000
    seed: int = 20_240_117

    def family(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd multipliers and offsets of h(x) = (a x + b) mod 2^64, the high bits being used."""
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 1 << 63, self.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, rng.integers(0, 1 << 63, self.minima, dtype=np.uint64)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    raw, offsets = wordhash.buffers(texts)
    raw = wordhash.lowered(raw)
    start, end, first = wordhash.words(raw, offsets)
    return wordhash.shingles(wordhash.word_hashes(raw, start, end), first)


def _class_of(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 1024) -> bytes:
    """16 high bits of each minimum, so that a band of four is eight bytes."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), chunk):
        values = np.multiply.outer(a, shingles[at:at + chunk])
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return wordhash.mix(least).astype(np.uint16).tobytes()


def _describe(params: MinHash):
    a, b = params.family()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            sets = _sets(piece["text"])
            keys = [_class_of(s) if len(s) else None for s in sets]
            made: dict[bytes, bytes] = {}
            for key, s in zip(keys, sets):
                if key is not None and key not in made:
                    made[key] = _signature(s, a, b)
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], piece["digest"], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(keys, pa.binary()), pa.array([made.get(k) for k in keys], pa.binary())],
                names=["doc_id", "digest", "n_shingles", "cls", "sig"])

    return run


def _agreeing(params: MinHash):
    """Keep the pairs whose signatures agree often enough and whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig_a, sig_b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, params.minima)
                            for c in ("sig_a", "sig_b"))
            keep = (sig_a == sig_b).sum(axis=1) >= params.signature_floor * params.minima
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _likely_pairs(group: pa.Table, sigs: list[bytes], size: np.ndarray, params: MinHash) -> Iterator[tuple[int, np.ndarray]]:
    """In one block of a bucket: a row, and the rows of other components that its signature may be linked with.

    A pair that meets in several bands is looked at in the first of them only.
    """
    sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, params.minima)
    bands = sig.reshape(len(sig), -1, params.rows)
    here = (bands == bands[0]).all(axis=2).all(axis=0)
    comp = np.unique(np.array(group["comp"].to_pylist(), dtype=object), return_inverse=True)[1]
    side, left, right = group["block"].to_numpy(), group["left"][0].as_py(), group["right"][0].as_py()
    one, other = np.flatnonzero(side == left), np.flatnonzero(side == right)
    for i in one.tolist():
        js = other[other > i] if left == right else other
        js = js[(comp[js] != comp[i])
                & (100 * np.minimum(size[js], size[i]) >= params.percent * np.maximum(size[js], size[i]))]
        same = sig[js] == sig[i]
        likely = same.sum(axis=1) >= params.signature_floor * params.minima
        js, same = js[likely], same[likely].reshape(-1, len(here), params.rows).all(axis=2)
        js = js[here[same.argmax(axis=1)]] if len(js) else js
        if len(js):
            yield i, js


def _hopeful(params: MinHash):
    """The rows of every block that have a likely partner there, from signatures alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket", "left", "right"]):
            group = group.combine_chunks()
            keep = np.zeros(len(group), dtype=bool)
            for i, js in _likely_pairs(group, group["sig"].to_pylist(), group["n_shingles"].to_numpy(), params):
                keep[i] = keep[js] = True
            for batch in group.select(["bucket", "left", "right", "block", "comp", "cls"]).filter(pa.array(keep)).to_batches():
                yield batch

    return run


def _across(params: MinHash):
    """Links between different components within one block of a bucket, confirmed on the full sets."""
    a, b = params.family()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket", "left", "right"]):
            group = group.combine_chunks()
            sets = _sets(pa.concat_arrays(group["text"].chunks))
            cls, size = group["cls"].to_pylist(), np.array([len(x) for x in sets])
            u, v = [], []
            for i, js in _likely_pairs(group, [_signature(x, a, b) for x in sets], size, params):
                ends = np.cumsum(size[js])
                hits = np.concatenate([[0], np.cumsum(np.isin(np.concatenate([sets[j] for j in js]), sets[i]))])
                common = hits[ends] - hits[ends - size[js]]
                for j in js[100 * common >= params.percent * (size[js] + size[i] - common)]:
                    u.append(cls[i])
                    v.append(cls[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _verify(params: MinHash):
    """In groups of one hub and its partners, links confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_key, hub = None, None
        for piece in slices(batches, "text"):
            sets, u, v = _sets(piece["text"]), [], []
            hubs, parts = piece["hub"].to_pylist(), piece["part"].to_pylist()
            is_hub, cls = piece["is_hub"].to_pylist(), piece["cls"].to_pylist()
            for i, s in enumerate(sets):
                if is_hub[i]:
                    hub_key, hub = (hubs[i], parts[i]), s
                elif hub_key == (hubs[i], parts[i]):
                    common = np.isin(s, hub, assume_unique=True).sum()
                    if 100 * common >= params.percent * (len(s) + len(hub) - common):
                        u.append(cls[i])
                        v.append(hubs[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, params: MinHash) -> DataFrame:
    """(cls, text) with one text of every wanted class, read by the id and the text digest of its first row."""
    reps = small_side(classes.join(wanted.distinct(), "cls").select(
        "cls", F.col("rep.doc_id").alias("its_id"), F.col("rep.digest").alias("its_digest")), params.broadcast_rows)
    texts = with_text(docs, "doc_id").withColumn("digest", F.xxhash64("text")).join(
        reps, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")))
    # Should two texts of one id share a digest, the class, computed again, tells them apart.
    return texts.select("cls", "text").mapInArrow(_same_class, "cls binary, text string").dropDuplicates(["cls"])


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, params: MinHash) -> DataFrame:
    """Verified links (u, v) among candidate pairs (a, b); b is the hub that several a may share.

    A hub's partners are dealt out in parts of about ``salt_rows`` and each part gets its own copy of
    the hub's text, so that a hub of a very large group does not meet in one task.
    """
    sized = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / params.salt_rows).cast("int").alias("parts"))
    members = pairs.join(sized, "b").select(
        F.col("a").alias("cls"), F.col("b").alias("hub"),
        F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_hub"))
    hubs = sized.select(F.col("b").alias("cls"), F.col("b").alias("hub"),
                        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    roles = staged(members.union(hubs), "roles")
    dealt = (roles.join(_texts(docs, classes, roles.select("cls"), params), "cls")
             .repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub")))
    links = staged(dealt.mapInArrow(_verify(params), "u binary, v binary"), "confirmed")
    drop_staged(roles)
    return links


def _same_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        keep = [_class_of(s) == k for s, k in zip(_sets(piece["text"]), piece["cls"].to_pylist())]
        yield piece.filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, params: MinHash = MinHash()) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of ``docs``.

    Only ``doc_id`` and ``text`` are read; other columns, whatever their names, play no part. A null
    text, an empty one and one without words have an empty set, no class and no link: they are their
    own component and kept. Fewer than five words are one shingle. Rows that repeat a document share
    its set and hence its component; each of them is returned. A null id never is the smallest of a
    component that has another; a component of null ids only has a null component id and is kept. No
    rows give no rows.
    """
    described = staged(with_text(docs, "doc_id").withColumn("digest", F.xxhash64("text")).mapInArrow(
        _describe(params), _schema(docs, "digest long, n_shingles long, cls binary, sig binary")), "described")
    classes = staged(described.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "digest")).alias("rep"),
        F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig")), "classes")

    bands = range(params.minima // params.rows)
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 2 * params.rows * b + 1, 2 * params.rows)) for b in bands])
    members = classes.select("cls", F.explode(keys).alias("bucket"))
    buckets = (members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("pivot"))
               .where("n > 1"))
    shared = staged(members.join(buckets.hint("merge"), "bucket"), "shared")

    # Merge joins with the signatures at every size, so that a small trial shows what a large run does.
    stars = shared.where("cls != pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    side = lambda c, s: classes.select(
        F.col("cls").alias(c), F.col("sig").alias(f"sig_{s}"), F.col("n_shingles").alias(f"n_{s}")).hint("merge")
    sized = (100 * F.least("n_a", "n_b") >= params.percent * F.greatest("n_a", "n_b"))
    likely = staged(stars.join(side("a", "a"), "a").join(side("b", "b"), "b").where(sized)
                    .select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing(params), "a binary, b binary"), "likely")
    links = _confirmed(docs, classes, likely, params)
    roots = staged(components(links), "roots")

    placed = (shared.where("n > 2").join(roots, shared["cls"] == roots["node"], "left")
              .select("bucket", "cls", "n", F.coalesce("root", "cls").alias("comp")))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1")
    blocks = F.ceil(F.col("n") / params.block).cast("int")
    open_ = (placed.join(mixed.select("bucket"), "bucket")
             .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", "cls", "comp", "block", F.least("block", "other").alias("left"),
                     F.greatest("block", "other").alias("right")))
    # A class meets its signature, and then its text, once; only then is it dealt out to its buckets.
    open_, member = _dealt(open_, "open"), ["cls", "sig", "n_shingles"]
    hopeful = _dealt(open_.join(classes.select(member).hint("merge"), "cls").select(*member, F.inline("places"))
                     .repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
                     .mapInArrow(_hopeful(params), "bucket long, left int, right int, block int, comp binary, cls binary"),
                     "hopeful")
    crossing = (hopeful.join(_texts(docs, classes, hopeful.select("cls"), params), "cls")
                .select("cls", "text", F.inline("places"))
                .repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right"))
    more = staged(crossing.mapInArrow(_across(params), "u binary, v binary"), "confirmed")
    drop_staged(shared, likely, roots, open_, hopeful)
    roots = staged(components(links.union(more)), "roots")

    named = (classes.select("cls", "least").join(roots, classes["cls"] == roots["node"], "left")
             .select("cls", "least", F.coalesce("root", "cls").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("cls", "component_id")
    rows = described.select("doc_id", "n_shingles", "cls")
    worded = rows.where(F.col("cls").isNotNull()).join(ids, "cls")
    alone = rows.where(F.col("cls").isNull()).withColumn("component_id", F.col("doc_id"))
    out = staged(worded.unionByName(alone).select(
        "doc_id", "n_shingles", F.hex("cls").alias("class_id"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near")
    drop_staged(described, classes, links, more, roots)
    return out


def _dealt(places: DataFrame, name: str) -> DataFrame:
    """(cls, places) with the blocks that a class is compared in, a few for each of its bands."""
    packed = F.collect_list(F.struct("bucket", "left", "right", "block", "comp")).alias("places")
    return staged(places.groupBy("cls").agg(packed), name)


def _schema(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"
