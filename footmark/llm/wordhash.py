"""Words, lines and shingles of a whole Arrow text column at once, on its UTF-8 bytes.

Everything here works on one Arrow batch: the bytes of all texts lie in one buffer, and numpy
finds words (maximal runs of bytes other than space, tab, LF, VT, FF, CR), hashes them and combines
neighbouring hashes without a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its texts; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset:]
    raw = np.frombuffer(data, dtype=np.uint8)[: offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0]:], offsets - offsets[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z become a-z; no other byte changes."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (n + 1 values)."""
    letter = np.zeros(len(raw) + 2, dtype=bool)
    letter[1:-1] = ~_SPACE[raw]
    begins = letter[1:-1] & ~letter[:-2]
    ends = letter[1:-1] & ~letter[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] |= letter[1:-1][inner]
    ends[inner - 1] |= letter[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """A 64-bit polynomial hash of each word, length included; words never straddle a block."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        upto = max(at + 1, np.searchsorted(end, base + block, side="right"))
        size = end[upto - 1] - base
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((raw[base:base + size].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size), out=total[1:])
        s, e = start[at:upto] - base, end[at:upto] - base
        value = (total[e] - total[s]) * _powers(_INVERSE, size + 1)[s]
        out[at:upto] = mix(value + mix((e - s).astype(np.uint64)))
        at = upto
    return out


def shingles(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    n, k = len(hashes), SHINGLE_WORDS
    combined = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        combined = mix(combined * np.uint64(3) + hashes[j:n - k + 1 + j]) if n >= k else combined
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(combined[a:b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = mix(np.array([whole * np.uint64(3) + h], dtype=np.uint64))[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
