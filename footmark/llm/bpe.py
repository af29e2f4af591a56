"""Byte-level BPE encoding and decoding by a rank file.

A pre-token's bytes are the leaves of a segment tree; a leaf holds the rank of the pair that starts
there, joined with its position, so that the root is the leftmost pair of the smallest rank. A merge
changes three leaves (the pair's own, the swallowed one's and the left neighbour's) and the nodes above
them: a logarithmic number of updates. Many pre-tokens advance in step, one merge each per round, on
numpy arrays; very long ones run alone on lists. Each distinct pre-token is encoded once per task while
it stays in a bounded memory.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from footmark.llm.common import slices, with_text

NONE = np.int64(1) << np.int64(60)
IN_STEP = 512
REMEMBERED = 150_000

OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary",
           "decoded_sha256": "string"}


class Ranks:
    """The tokens of a rank file, and the rank of every pair of tokens whose bytes make a token."""

    def __init__(self, path: str) -> None:
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as file:
            for line in file:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.token = {rank: token for token, rank in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.pair = pairs
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(list(pairs.values()), dtype=np.int64)[order], NONE)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 32) | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each non-empty piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(piece) > IN_STEP:
                out[i] = self._merge_alone(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, group in by_width.items():
            most = max(1, (1 << 18) // width)
            for at in range(0, len(group), most):
                part = group[at:at + most]
                for i, ids in zip(part, self._merge_in_step([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_in_step(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        rows, bits = len(pieces), width.bit_length() - 1
        size = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        token = self.byte[raw]
        column = np.arange(width)
        after = np.broadcast_to(column + 1, (rows, width)).copy()
        before = np.broadcast_to(column - 1, (rows, width)).copy()
        tree = np.full((rows, 2 * width), NONE, dtype=np.int64)
        pair = self.ranks(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(rows, width - 1)
        usable = (pair < NONE) & (column[:-1] < size[:, None] - 1)
        tree[:, width:-1] = np.where(usable, (pair << bits) | column[:-1], NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        live = np.ones((rows, width), dtype=bool)
        live &= column < size[:, None]
        row = np.flatnonzero(tree[:, 1] < NONE)

        def put(r: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
            node = position + width
            tree[r, node] = value
            for _ in range(bits):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def key(r: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            rank = self.ranks(token[r, left], token[r, right])
            return np.where(rank < NONE, (rank << bits) | left, NONE)

        while len(row):
            top = tree[row, 1]
            at, made = top & (width - 1), top >> bits
            gone = after[row, at]
            follower = after[row, gone]
            token[row, at], after[row, at], live[row, gone] = made, follower, False
            put(row, gone, NONE)
            inner = follower < size[row]
            has = row[inner]
            before[has, follower[inner]] = at[inner]
            value = np.full(len(row), NONE, dtype=np.int64)
            value[inner] = key(has, at[inner], follower[inner])
            put(row, at, value)
            prior = before[row, at]
            inner = prior >= 0
            if inner.any():
                has = row[inner]
                put(has, prior[inner], key(has, prior[inner], at[inner]))
            row = row[tree[row, 1] < NONE]
        flat = token[live].astype(np.int32)
        return np.split(flat, np.cumsum(live.sum(axis=1))[:-1])

    def _merge_alone(self, piece: bytes) -> np.ndarray:
        n, pair = len(piece), self.pair
        width = 1 << (n - 1).bit_length()
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (1 << 60, 0)
        tree = [none] * (2 * width)

        def leaf(i: int):
            j = after[i]
            rank = pair.get((token[i], token[j])) if j < n else None
            return none if rank is None else (rank, i)

        def put(i: int, value) -> None:
            node = i + width
            tree[node] = value
            node >>= 1
            while node:
                low, high = tree[2 * node], tree[2 * node + 1]
                least = low if low <= high else high
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] is not none and tree[1] != none:
            rank, i = tree[1]
            gone = after[i]
            token[i], after[i] = rank, after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return np.array(out, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.token[i] for i in ids.tolist()])


def encode(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids"),
           key: str = "doc_id") -> DataFrame:
    """The named outputs of every row of ``docs`` beside its key column, from its whole text.

    ``ids`` are the token ids, ``decoded`` the bytes decoded from the ids; the digests are of the
    decimal ids joined by one space and of the decoded bytes. ``path`` names a rank file at the same
    place on every executor and ``pattern`` the splitting expression; no special tokens are formed. A
    null text counts as empty, an empty one has no tokens. Rows and keys may repeat or be null: each
    row is encoded by itself. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"{name} {OUTPUTS[name]}" for name in outputs)])
    return with_text(docs, key).mapInArrow(_encoder(path, pattern, outputs, key), schema)


def _encoder(path: str, pattern: str, outputs: tuple[str, ...], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import regex

        split, ranks = regex.compile(pattern).findall, None
        spelled, back = "ids_sha256" in outputs, bool({"decoded", "decoded_sha256"} & set(outputs))
        known: dict[str, tuple[bytes, str, bytes]] = {}
        for batch in slices(batches, "text"):
            ranks = ranks or Ranks(path)
            pieces = [split(text) for text in batch["text"].to_pylist()]
            new = list({p for document in pieces for p in document if p not in known})
            if len(known) + len(new) > REMEMBERED:
                known = {}
                new = list({p for document in pieces for p in document})
            # Only what the outputs need is remembered.
            for piece, ids in zip(new, ranks.encode([p.encode() for p in new])):
                known[piece] = (ids.tobytes(), " ".join(map(str, ids.tolist())) if spelled else "", ranks.decode(ids) if back else b"")
            columns: dict[str, list] = {name: [] for name in outputs}
            for document in pieces:
                parts = [known[p] for p in document]
                if "n_tokens" in columns:
                    columns["n_tokens"].append(sum([len(p[0]) for p in parts]) // 4)
                if "ids" in columns:
                    columns["ids"].append(np.frombuffer(b"".join([p[0] for p in parts]), np.int32))
                if "ids_sha256" in columns:
                    columns["ids_sha256"].append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                if "decoded" in columns or "decoded_sha256" in columns:
                    decoded = b"".join([p[2] for p in parts])
                    if "decoded" in columns:
                        columns["decoded"].append(decoded)
                    if "decoded_sha256" in columns:
                        columns["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch[key], *(pa.array(columns[n], kinds.get(n, pa.string())) for n in outputs)],
                names=[key, *outputs])

    return run


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) with the bytes of each row's ids; null ids give null, no ids an empty value."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None
        for batch in batches:
            ranks = ranks or Ranks(path)
            values = [None if x is None else ranks.decode(np.asarray(x, np.int32)) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(values, pa.binary())], names=[key, "decoded"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded binary")
