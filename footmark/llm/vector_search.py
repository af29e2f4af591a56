"""Exact top-k inner products over an index of paged metric trees.

Vectors are dealt out by their nearest of a bounded sample of pivots, in ranges that also split a cell
of many equal vectors, and cut into pages. A page is an M-tree: every node has a routing object, a
covering radius, the largest norm below it and its distance to its parent's routing object; a leaf's
entries have their distance to the leaf's. Since 2 q.x = |q|^2 + |x|^2 - d(q, x)^2, the triangle
inequality bounds inner products from these stored numbers: a child or an entry whose bound cannot
reach the k-th best score is left out before its distance or product is computed. Nodes are visited
best bound first. The sample only shapes the cells; every vector is indexed and results are exact.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footmark.llm.common import runs, staged


@dataclass(frozen=True)
class MTree:
    """Rows of a page, entries of a leaf, children of a node, sampled pivots, and the query grid."""

    page_rows: int = 4096
    leaf_rows: int = 1024
    fanout: int = 4
    pivots: int = 64
    block_queries: int = 256
    blocks_held: int = 32
    pages_held: int = 4


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; null where the vector or a component is unusable."""
    sound = embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (
        F.abs(x.cast("double")) == float("inf")))
    return F.when(sound, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


class Page:
    """One M-tree, kept as flat arrays; children of a node are consecutive, so are a leaf's entries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, params: MTree) -> None:
        self.points = vectors.astype(np.float64)
        self.nodes: list[tuple[float, float, float, int, int, bool]] = []  # radius, norm, up, from, to, leaf
        self.routing: list[int] = []
        self.order: list[np.ndarray] = []
        self.entry: list[np.ndarray] = []
        self.placed = 0
        self.norm = (self.points ** 2).sum(axis=1)
        self._grow(np.arange(len(ids)), params)
        order = np.concatenate(self.order)
        self.ids, self.entry_distance, self.entry_norm = ids[order], np.concatenate(self.entry), self.norm[order]
        # Products of integers below 2^52 are exact in floating point; only larger ones keep the integers.
        self.placed_points = self.points[order]
        self.largest = float(np.abs(self.points).max(initial=0))
        self.vectors = vectors[order] if self.largest ** 2 * max(1, vectors.shape[1]) > 2 ** 52 else None
        self.route = self.points[self.routing]
        self.radius, self.most, self.up, self.begin, self.end, self.leaf = (np.array(x) for x in zip(*self.nodes))
        del self.points, self.norm, self.order, self.entry, self.routing, self.nodes

    def saved(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def loaded(cls, blob: bytes) -> Page:
        page = cls.__new__(cls)
        page.__dict__.update(pickle.loads(blob))
        return page

    def _grow(self, rows: np.ndarray, params: MTree) -> None:
        pending = [(rows, 0.0, None)]  # breadth first: a node's children are appended together
        while pending:
            following = []
            for rows, up, slot in pending:
                routing = rows[((self.points[rows] - self.points[rows].mean(axis=0)) ** 2).sum(axis=1).argmin()]
                distance = np.sqrt(((self.points[rows] - self.points[routing]) ** 2).sum(axis=1))
                if slot is None:
                    slot, _ = self._add(1)
                else:
                    up = math.sqrt(((self.points[routing] - self.points[up]) ** 2).sum())
                self.routing[slot] = routing
                head = (float(distance.max()), float(self.norm[rows].max()), up)
                if len(rows) <= params.leaf_rows:
                    self.nodes[slot] = (*head, self.placed, self.placed + len(rows), True)
                    self.order.append(rows)
                    self.entry.append(distance)
                    self.placed += len(rows)
                else:
                    groups = self._split(rows, params)
                    first, last = self._add(len(groups))
                    self.nodes[slot] = (*head, first, last, False)
                    following += [(g, routing, first + i) for i, g in enumerate(groups)]
            pending = following

    def _add(self, n: int) -> tuple[int, int]:
        first = len(self.nodes)
        self.nodes += [(0.0, 0.0, 0.0, 0, 0, True)] * n
        self.routing += [0] * n
        return first, first + n

    def _split(self, rows: np.ndarray, params: MTree) -> list[np.ndarray]:
        """Groups round far-apart routing objects; a group that would not shrink is cut evenly."""
        points = self.points[rows]
        away = ((points - points[0]) ** 2).sum(axis=1)
        nearest, group = away, np.zeros(len(rows), dtype=np.int64)
        for k in range(1, params.fanout):
            far = int(nearest.argmax())
            if nearest[far] == 0:
                break
            to = ((points - points[far]) ** 2).sum(axis=1)
            closer = to < nearest
            group[closer], nearest = k, np.minimum(to, nearest)
        groups = [rows[group == k] for k in range(params.fanout)]
        groups = [g for g in groups if len(g)]
        if max(map(len, groups)) > 0.9 * len(rows):
            return np.array_split(rows, min(params.fanout, len(rows)))
        return groups

    def _whole_products(self, at, query: np.ndarray) -> np.ndarray:
        """Products in whole numbers of any size, held at the limits of 64 bits."""
        rows = self.placed_points[at] if self.vectors is None else self.vectors[at]
        exact = [sum(int(x) * int(y) for x, y in zip(query, v)) for v in rows]
        return np.array([max(-(2 ** 63), min(2 ** 63 - 1, s)) for s in exact], dtype=np.int64)

    def search(self, query_id, query: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """Up to k (score, id) of at least ``floor``, best first, ties to smaller ids, own id left out."""
        q = query.astype(np.float64)
        own = float(q @ q)
        slack = 1e-6 * (own + float(self.most[0])) + 1e-3
        exact = self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) <= 2 ** 52
        found: list[tuple[int, int]] = []
        least = floor

        def bound(distance, norm):
            return (own + norm - np.maximum(distance, 0) ** 2) / 2 + slack

        to = math.sqrt(((self.route[0] - q) ** 2).sum())
        heap = [(-float(bound(to - self.radius[0], self.most[0])), 0, to)]
        while heap:
            negative, node, to = heapq.heappop(heap)
            if -negative < least:
                break
            a, b = int(self.begin[node]), int(self.end[node])
            if self.leaf[node]:
                near = bound(np.abs(to - self.entry_distance[a:b]), self.entry_norm[a:b]) >= least
                left = np.flatnonzero(near)
                # Gathering most of a leaf's rows costs more than their products; few are gathered.
                at = slice(a, b) if 4 * len(left) > b - a else a + left
                score = self.placed_points[at] @ q if exact else self._whole_products(at, query)
                enough = np.flatnonzero(score >= least)
                if len(enough):
                    found += [(int(s), i) for s, i in zip(score[enough].tolist(), self.ids[at][enough].tolist()) if i != query_id]
                    if len(found) > k:
                        found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                    if len(found) == k:
                        least = max(least, min(s for s, _ in found))
                continue
            children = np.arange(a, b)
            far = np.abs(to - self.up[a:b]) - self.radius[a:b]
            children = children[bound(far, self.most[a:b]) >= least]
            each = np.sqrt(((self.route[children] - q) ** 2).sum(axis=1))
            top = bound(each - self.radius[children], self.most[children])
            for c, d, t in zip(children.tolist(), each.tolist(), top.tolist()):
                if t >= least:
                    heapq.heappush(heap, (-t, c, d))
        return sorted(found, key=lambda x: (-x[0], x[1]))


def _cells(pivots: list[list[int]]):
    by_size: dict[int, np.ndarray] = {}
    for size in {len(p) for p in pivots if len(p)}:
        by_size[size] = np.array([p for p in pivots if len(p) == size], dtype=np.float64).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch["vector"].to_pylist():
                near = by_size.get(len(v))
                cells.append(0 if near is None or not len(v) else int(((near - np.array(v, np.float64)) ** 2).sum(axis=1).argmin()))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["vector"], batch["is_query"], pa.array(cells, pa.int32())],
                names=["vec_id", "vector", "is_query", "cell"])

    return run


def _build(params: MTree, k: int):
    """Pages of one range of cells, and every query of a page with the k-th best score found at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["size"]):
            size = group["size"][0].as_py()
            for at in range(0, group.num_rows, params.page_rows):
                part = group.slice(at, params.page_rows).combine_chunks()
                ids = np.array(part["vec_id"].to_pylist(), dtype=object)
                vectors = np.array(part["vector"].to_pylist(), dtype=np.int64).reshape(len(ids), size)
                page = Page(ids, vectors, params)
                blobs, keys, floors = [page.saved()], [None], [None]
                for i in np.flatnonzero(np.array(part["is_query"].to_pylist(), dtype=bool)):
                    home = page.search(ids[i], vectors[i], k, -math.inf)
                    blobs.append(vectors[i].tobytes())
                    keys.append(ids[i])
                    floors.append(float(home[-1][0]) if len(home) == k else -math.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(blobs), pa.int32()), pa.array([x is None for x in floors]),
                     pa.array(keys, pa.int64()), pa.array(floors, pa.float64()), pa.array(blobs, pa.binary())],
                    names=["size", "is_page", "vec_id", "floor", "blob"])

    return run


def _search(k: int):
    """In each cell of the grid, the queries first, then its pages one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_by_one = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
        state, queries = None, []

        def results():
            rows = [(q, v.tobytes(), s, i) for q, v, _, best in queries for s, i in best]
            q, v, s, i = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.binary()), pa.array(i, pa.int64()),
                                               pa.array(s, pa.int64())], names=["query_id", "query", "vec_id", "score"])

        for row in one_by_one:
            key = tuple(row[c][0].as_py() for c in ("size", "down", "across"))
            if key != state:
                if queries:
                    yield results()
                state, queries = key, []
            blob = row["blob"][0].as_py()
            if not row["is_page"][0].as_py():
                queries.append((row["vec_id"][0].as_py(), np.frombuffer(blob, np.int64), row["floor"][0].as_py(), []))
                continue
            page = Page.loaded(blob)
            for n, (q, v, floor, best) in enumerate(queries):
                best = sorted(best + page.search(q, v, k, floor), key=lambda x: (-x[0], x[1]))[:k]
                queries[n] = (q, v, max(floor, float(best[-1][0])) if len(best) == k else floor, best)
        if queries:
            yield results()

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, params: MTree = MTree()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each row whose id ``every`` divides.

    Reads ``vec_id`` and ``embedding`` only. Components become floor(256 x); candidates of a query are
    all rows of the same number of components but those with its own id. Ties go to the smaller id.
    Vectors that are null or hold a null or non-finite component take no part, nor do rows without id. A
    repeated row is a candidate of its own; a repeated query is answered once. Fewer candidates than k
    give as many rows; no rows give none. Scores beyond 64 bits are held at the limits.
    """
    spark = vectors.sparkSession
    usable = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("vector"))
              .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
              .withColumn("is_query", F.col("vec_id") % every == 0))
    pivots = [r[0] for r in usable.orderBy(F.xxhash64("vec_id", "vector")).select("vector").take(params.pivots)]
    kinds = "vec_id long, vector array<bigint>, is_query boolean, cell int"
    size = F.size("vector").alias("size")
    tree = (usable.mapInArrow(_cells(pivots), kinds).withColumn("size", F.size("vector"))
            .repartitionByRange("size", "cell", "vec_id").sortWithinPartitions("size", "cell", "vec_id")
            .select("vec_id", "vector", "is_query", "size")
            .mapInArrow(_build(params, k), "size int, is_page boolean, vec_id long, floor double, blob binary"))
    tree = staged(tree, "mtree")
    pages, queries = tree.where("is_page"), tree.where("not is_page").dropDuplicates(["size", "vec_id", "blob"])
    counts = tree.groupBy("is_page").count()
    n = {r["is_page"]: r["count"] for r in counts.take(2)}
    across = max(1, math.ceil(n.get(False, 0) / (params.block_queries * params.blocks_held)))
    down = max(1, math.ceil(n.get(True, 0) / params.pages_held))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every_ = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    grid = (pages.withColumn("down", spread("blob", down)).withColumn("across", every_(across))
            .unionByName(queries.withColumn("across", spread("vec_id", across)).withColumn("down", every_(down))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(across * down, 100_000))
    found = (grid.repartition(parts, "size", "down", "across").sortWithinPartitions("size", "down", "across", "is_page")
             .mapInArrow(_search(k), "query_id long, query binary, vec_id long, score long"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
