"""Token counts by the best unigram segmentation, with forward scores shared along a trie.

Pre-tokens are inserted byte by byte in a trie. A node stands for a prefix and stores the best score of
any segmentation of that prefix and its number of tokens, computed once from its ancestors when the node
is made; a pre-token's count is what its last node stores. Every prefix shared by many pre-tokens is
thus scored once. Each task keeps its own trie and starts a new one beyond a bounded number of nodes;
counts do not depend on that.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from footmark.llm.common import slices, with_text

MOST_NODES = 400_000
MOST_PIECES = 200_000


def unigram_scores(path: str, shift: float = 2.7) -> dict[bytes, float]:
    """Log-probabilities of a rank file's tokens under a Zipf-Mandelbrot law over their ranks."""
    with open(path, "rb") as file:
        rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    total = math.log(math.fsum(1.0 / (r + 1 + shift) for r in rank.values()))
    return {token: -math.log(r + 1 + shift) - total for token, r in rank.items()}


class ForwardTrie:
    """Prefix nodes with the best forward score and, among equal scores, the fewest tokens."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.scores = scores
        # Vocabulary reversed: walking back from a position ends as soon as no token has that ending.
        self.back: dict[int, int] = {}
        self.back_score: list[float | None] = [None]
        for token, score in scores.items():
            node = 0
            for b in reversed(token):
                step = node << 8 | b
                node = self.back.setdefault(step, len(self.back_score))
                if node == len(self.back_score):
                    self.back_score.append(None)
            self.back_score[node] = score
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def insert(self, piece: bytes) -> int:
        """The number of tokens of a pre-token; -1 if no segmentation exists."""
        child, best, tokens, back, back_score = self.child, self.best, self.tokens, self.back, self.back_score
        node, path = 0, [0]
        for i, b in enumerate(piece):
            step = node << 8 | b
            node = child.get(step, -1)
            if node < 0:
                node = child[step] = len(best)
                top, fewest, ending = -math.inf, -1, 0
                for j in range(i, -1, -1):
                    ending = back.get(ending << 8 | piece[j], -1)
                    if ending < 0:
                        break
                    score = back_score[ending]
                    if score is not None and tokens[path[j]] >= 0:
                        score += best[path[j]]
                        count = tokens[path[j]] + 1
                        if score > top or score == top and count < fewest:
                            top, fewest = score, count
                best.append(top)
                tokens.append(fewest)
            path.append(node)
        return tokens[node]


def count_tokens(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, n_pretokens, n_tokens) for the whole text of every row of ``docs``.

    ``path`` names a rank file at the same place on every executor, ``pattern`` splits texts into
    pre-tokens. A null or empty text has no tokens. Bytes that no token covers would make a pre-token
    uncountable; it then counts one token a byte (rank files with all 256 bytes never meet this). Rows
    and keys may repeat or be null: each row is counted by itself. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, trie = regex.compile(pattern).findall, None
        known: dict[str, int] = {}
        for batch in slices(batches, "text"):
            trie = trie or ForwardTrie(unigram_scores(path))
            pretokens, counts = [], []
            for text in batch["text"].to_pylist():
                pieces = split(text)
                pretokens.append(len(pieces))
                total = 0
                for piece in pieces:
                    n = known.get(piece)
                    if n is None:
                        raw = piece.encode()
                        n = trie.insert(raw)
                        n = known[piece] = n if n >= 0 else len(raw)
                        if len(trie.best) > MOST_NODES or len(known) > MOST_PIECES:
                            trie.clear()
                            known.clear()
                    total += n
                counts.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array(pretokens, pa.int64()), pa.array(counts, pa.int64())],
                names=[key, "n_pretokens", "n_tokens"])

    return with_text(docs, key).mapInArrow(run, f"`{key}` {kind}, n_pretokens long, n_tokens long")
