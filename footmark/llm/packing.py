"""Packing token sequences: overlong documents are cut into full windows, rests go best fit decreasing.

Texts are tokenized where they lie; from then on only one small row a piece moves. Pieces are dealt out by
row number to groups of a few thousand, each sorted by falling length and streamed through the windows that
the group has open. A segment tree indexed by remaining capacity finds the tightest open window, so a group
costs memory for its open windows alone and there is no group that grows with the data.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import slices, staged, with_text

#: What ``pieces`` can give beside (key, start, length, doc_tokens): the ids themselves, 4 bytes each, or their checksum.
OUTPUTS = {"ids": "binary", "ids_crc32": "long"}
#: Words remembered by a task and their ids in all, and the bytes of text tokenized at once.
REMEMBERED, HELD_IDS, CHUNK_BYTES = 1_000_000, 8_000_000, 4 << 20
#: Pieces of a group, at least: one window of it stays partly empty.
GROUP_PIECES = 4096
_SPACE = re.compile(rb"[ \t-\r]")
#: Words of Latin-1 characters are cut as the tokenizer's own expression cuts them, after lower-casing.
_PLAIN = re.compile("[\x00-\x7FÀ-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Words:
    """Token ids of whole texts, from the ids of their words.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its words
    between ASCII spaces, one after another. Arrow finds the distinct words of a batch; those not seen before
    are cut into the tokenizer's pieces, and the new pieces are encoded together. Numpy lays out the ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.whole.encode_special_tokens = self.model.encode_special_tokens = True  # ordinary text
        # The second one takes pieces that are normalized and cut already, a space between them.
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words: dict[bytes, int] = {}
        self.parts: dict[str, int] = {}
        self.word_ids, self.part_ids = _Lists(), _Lists()

    def _learn_parts(self, parts: list[str], together: int = 2000) -> None:
        """Remember the ids of new pieces, and of whole words outside Latin-1, which the tokenizer cuts itself."""
        plain = [p for p in parts if _PLAIN.fullmatch(p)]
        joined = [" ".join(plain[a:a + together]) for a in range(0, len(plain), together)]
        ids = _flat(self.model.encode_batch_fast(joined, add_special_tokens=False))
        upto = np.flatnonzero(self.ends[ids]) + 1  # each piece ends with the one id that stands for an end
        other = [p for p in parts if not _PLAIN.fullmatch(p)]
        coded = self.whole.encode_batch_fast(other, add_special_tokens=False)
        self.parts.update(zip(plain + other, range(len(self.parts), len(self.parts) + len(parts))))
        self.part_ids.extend(ids, np.diff(upto, prepend=0))
        self.part_ids.extend(_flat(coded), np.array([len(e.ids) for e in coded], np.int64))

    def _learn(self, words: list[bytes]) -> None:
        cut = [_PARTS.findall(w.lower()) if _PLAIN.fullmatch(w) else [w] for w in map(bytes.decode, words)]
        flat = [p for parts in cut for p in parts]
        new = set(flat).difference(self.parts)
        if new:
            self._learn_parts(list(new))
        number = np.fromiter(map(self.parts.__getitem__, flat), np.int64, len(flat))
        upto = np.cumsum([len(parts) for parts in cut])
        ids, ends = self.part_ids.take(number)
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.word_ids.extend(ids, np.diff(ends[upto], prepend=0))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts one after another, and the n + 1 offsets of the texts among them."""
        split = pa.compute.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.words) + len(words) > REMEMBERED or len(self.word_ids.ids) > HELD_IDS:
            self._forget()
        new = [w for w in words if w not in self.words]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        ids, ends = self.word_ids.take(number)
        return ids, ends[offsets]


class _Lists:
    """Many short lists of ids in one array."""

    def __init__(self) -> None:
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists of these numbers one after another, and where each list ends (0 first)."""
        length = self.length[number]
        upto = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.start[number] - upto[:-1], length)
        at += np.arange(upto[-1])
        return self.ids[at], upto


def _flat(encodings: list) -> np.ndarray:
    return np.fromiter(chain.from_iterable(e.ids for e in encodings), np.uint32)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts of a batch, in order and in pieces: their number and one text, or many that are short.

    A text longer than ``CHUNK_BYTES`` comes as several, cut before white space.
    """
    size = pa.compute.binary_length(texts).to_numpy()
    at = 0
    for n in [*np.flatnonzero(size > CHUNK_BYTES).tolist(), len(texts)]:
        if n > at:
            yield at, texts[at:n]
        if n < len(texts):
            text, a = texts[n].as_py().encode(), 0
            while a < len(text):
                space = _SPACE.search(text, a + CHUNK_BYTES)
                end = space.start() if space else len(text)
                yield n, pa.array([text[a:end].decode()])
                a = end
        at = n + 1


def encoded(words: Words, texts: pa.Array) -> list[np.ndarray]:
    """The ids of every text of a batch."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    for first, part in _chunks(texts):
        ids, offsets = words.encode(part)
        for n, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), first):
            out[n] = np.concatenate([out[n], ids[a:b]]) if len(out[n]) else ids[a:b]
    return out


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, outputs: tuple[str, ...] = ("ids",),
           key: str = "doc_id") -> DataFrame:
    """(key, start, length, doc_tokens, *outputs): every row's tokens and ``end_id``, cut into windows and a rest.

    ``start`` counts the row's ids before the piece, ``doc_tokens`` all of them. A null text counts as empty
    and is the end id alone. ``path`` names a tokenizer file at the same place on every executor.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "start long, length long, doc_tokens long",
                        *(f"{name} {OUTPUTS[name]}" for name in outputs)])
    last = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids = [np.concatenate([x, last]).astype("<u4").tobytes() for x in encoded(_words(path), batch["text"])]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            count = -(-sizes // window)
            of = np.repeat(np.arange(len(ids)), count)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(sizes[of] - start, window)
            cut = [ids[n][4 * a:4 * (a + k)] for n, a, k in zip(of.tolist(), start.tolist(), length.tolist())]
            found = {"ids": lambda: pa.array(cut, pa.binary()),
                     "ids_crc32": lambda: pa.array([zlib.crc32(x) for x in cut], pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [batch[key].take(pa.array(of)), pa.array(start), pa.array(length), pa.array(sizes[of]),
                 *(found[name]() for name in outputs)],
                names=[key, "start", "length", "doc_tokens", *outputs])

    return with_text(docs, key).mapInArrow(run, schema)


class OpenWindows:
    """The open windows of a group by remaining capacity: a segment tree, its leaves the capacities.

    A node tells whether any leaf below it holds a window; ``tightest`` climbs from the wanted size to the
    first node with a window on its right and goes down again on the left-most side.
    """

    def __init__(self, window: int):
        self.width = 1 << window.bit_length()
        self.holds = bytearray(2 * self.width)
        self.windows: list[list] = [[] for _ in range(window + 1)]

    def tightest(self, size: int) -> int:
        """The least capacity of at least ``size`` that a window has, or -1."""
        node = self.width + size
        if self.holds[node]:
            return size
        while node > 1 and (node & 1 or not self.holds[node + 1]):
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < self.width:
            node = 2 * node if self.holds[2 * node] else 2 * node + 1
        return node - self.width

    def put(self, capacity: int, window: tuple[int, int]) -> None:
        self.windows[capacity].append(window)
        node = self.width + capacity
        while node and not self.holds[node]:
            self.holds[node] = 1
            node >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        window = self.windows[capacity].pop()
        node = self.width + capacity
        if not self.windows[capacity]:
            self.holds[node] = 0
            while node > 1 and not self.holds[node ^ 1]:
                node >>= 1
                self.holds[node] = 0
        return window


def _placed(window: int):
    """A stream of (group, length, ...) sorted by group and falling length, with sequence_id and offset added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened, windows = None, 0, None
        for batch in batches:
            sequence, offset = [], []
            for group, length in zip(batch["group"].to_pylist(), batch["length"].to_pylist()):
                if group != last:
                    last, opened, windows = group, 0, OpenWindows(window)
                room = windows.tightest(length)
                if room < 0:
                    number, used, room = opened, 0, window
                    opened += 1
                else:
                    number, used = windows.take(room)
                sequence.append((group << 32) + number)
                offset.append(used)
                if room > length:
                    windows.put(room - length, (number, used + length))
            names = [n for n in batch.schema.names if n != "group"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(sequence, pa.int64()),
                                              pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, outputs: tuple[str, ...] = ("ids",),
         key: str = "doc_id") -> DataFrame:
    """``pieces`` with the sequence that each lies in and its offset there; no sequence exceeds ``window``.

    Rows and keys may repeat or be null: each row is packed by itself, and sequences number the groups of
    pieces, not the keys. Every token lies in one piece, every piece in one sequence, pieces without gaps from
    offset 0. No documents, no sequences. Other columns than key and text are not read.
    """
    cut = staged(pieces(docs, path, window, end_id, outputs, key).withColumn("row", F.monotonically_increasing_id()),
                 "pieces")
    groups = max(1, cut.count() // GROUP_PIECES)
    # Row numbers differ, whatever keys and texts do: no group is larger than its share.
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    order = [F.col("group"), F.col("length").desc(), F.col(key), F.col("start"), F.col("row")]
    sorted_pieces = dealt.repartition("group").sortWithinPartitions(*order).drop("row")
    fields = [f for f in sorted_pieces.schema.fields if f.name != "group"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "sequence_id long, offset long"])
    return sorted_pieces.mapInArrow(_placed(window), schema)


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, used, ids): the ids of every sequence of ``pack``, in order of offset, padded to ``window``.

    A sequence whose length is a power of two is left as it is. At most ``window`` ids come together.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), parts.alias("parts"))
    kind = "sequence_id long, used long, ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for used, found in zip(batch["used"].to_pylist(), batch["parts"].to_pylist()):
                out = np.full(used if used & (used - 1) == 0 else window, pad_id, np.int64)
                out[:used] = np.frombuffer(b"".join([p["ids"] for p in found]), "<u4")
                ids.append(out)
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], batch["used"], pa.array(ids, pa.list_(pa.int64()))],
                                             names=["sequence_id", "used", "ids"])

    return joined.mapInArrow(run, kind)
