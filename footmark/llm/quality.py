"""Quality rules: counted base rules and a calibrated logistic regression on hashed n-grams.

Features are hashed word 1- and 2-grams and byte 3- and 5-grams; each family enters as the relative
frequencies of its n-grams, so a score is the bias plus, for every family, the mean weight of the
text's n-grams. The model is fitted on a bounded sample of labelled rows (``sample_rows``, chosen by a
hash of the id), calibrated on a part of it that the weights have not seen, and applied to whole texts
in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm import wordhash
from footmark.llm.common import slices, with_text

SYMBOLS = b"#*$%&|<>"
#: Bytes of text worked on at once: the n-grams of a slice take some fifty times as much.
TEXT_SLICE = 1 << 20


@dataclass(frozen=True)
class QualityRules:
    """Fixed thresholds and the parameters of the fit."""

    least_words: int = 50
    repeat_percent: int = 50
    least_probability: float = 0.35
    sample_rows: int = 2000
    family_bits: int = 16
    calibration_share: float = 0.3
    rounds: int = 60
    step: float = 0.5
    shrink: float = 1e-5


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature, bias, and the calibration p = 1 / (1 + exp(-(slope s + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -500, 500)))


def _families(raw: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray, bits: int):
    """For each family: feature indices of all n-grams of all texts, and each text's n + 1 offsets."""
    def place(values: np.ndarray, family: int) -> np.ndarray:
        return (values >> np.uint64(64 - bits)).astype(np.int64) + (family << bits)

    def inside(n: int, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose window of ``width`` stays in its text, and the texts' offsets among them."""
        count = np.maximum(np.diff(starts) - width + 1, 0)
        upto = np.concatenate([[0], np.cumsum(count)])
        return np.arange(upto[-1]) + np.repeat(starts[:-1] - upto[:-1], count), upto

    yield place(hashes, 0), first
    at, upto = inside(len(hashes), first, 2)
    yield place(wordhash.mix(hashes[at] * np.uint64(3) + hashes[at + 1]), 1), upto
    for family, width in ((2, 3), (3, 5)):
        at, upto = inside(len(raw), offsets, width)
        code = raw[at].astype(np.uint64)
        for j in range(1, width):
            code |= raw[at + j].astype(np.uint64) << np.uint64(8 * j)
        yield place(wordhash.mix(code), family), upto


def _means(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[upto[1:]] - total[upto[:-1]]) / np.maximum(np.diff(upto), 1)


def _fit(params: QualityRules):
    """One task over the bounded sample: the weights, then their calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns, values, good, apart, docs = [], [], [], [], [], 0
        size = 4 << params.family_bits
        for piece in slices(batches, "text", TEXT_SLICE):
            raw, offsets = wordhash.buffers(piece["text"])
            start, end, first = wordhash.words(raw, offsets)
            for index, upto in _families(raw, offsets, wordhash.word_hashes(raw, start, end), first, params.family_bits):
                count = np.diff(upto)
                owner = np.repeat(np.arange(len(count)), count)
                key, times = np.unique(owner * size + index, return_counts=True)
                rows.append((key // size + docs).astype(np.int32))
                columns.append((key % size).astype(np.int32))
                values.append((times / count[key // size]).astype(np.float32))
            good += piece["quality"].to_pylist()
            apart += piece["apart"].to_pylist()
            docs += piece.num_rows
        good, apart = np.array(good, dtype=np.float64), np.array(apart, dtype=bool)
        held = apart if 0 < good[apart].sum() < apart.sum() else ~apart
        if docs == 0 or not 0 < good[~apart].sum() < (~apart).sum():
            return
        row, column, value = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
        rows = columns = values = None  # the parts are as large as the whole
        weights, moment, bias, bias_moment = np.zeros(size), np.zeros(size), 0.0, 0.0
        score = lambda: np.bincount(row, value * weights[column], docs) + bias
        balance = np.where(good > 0, 0.5 / max(good[~apart].mean(), 1e-9), 0.5 / max(1 - good[~apart].mean(), 1e-9))
        for _ in range(params.rounds):  # full-batch AdaGrad
            error = (1 / (1 + np.exp(-np.clip(score(), -500, 500))) - good) * balance * ~apart / (~apart).sum()
            gradient = np.bincount(column, value * error[row], size) + params.shrink * weights
            moment += gradient ** 2
            bias_moment += error.sum() ** 2
            weights -= params.step * gradient / (np.sqrt(moment) + 1e-8)
            bias -= params.step * error.sum() / (np.sqrt(bias_moment) + 1e-8)
        s, y = score()[held], good[held]
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        spread = s.std() or 1.0
        design = np.stack([s / spread, np.ones(len(s))], axis=1)
        line = np.array([1.0, 0.0])
        for _ in range(50):  # Newton steps of the two-parameter calibration
            p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
            hessian = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-6 * np.eye(2)
            line -= np.linalg.solve(hessian, design.T @ (p - target) + 1e-6 * line)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias]),
             pa.array([line[0] / spread]), pa.array([line[1]])], names=["weights", "bias", "slope", "shift"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, params: QualityRules) -> DataFrame:
    """At most ``sample_rows`` labelled documents, the first by a hash of the id, with a fold mark.

    A document labelled twice takes its lowest label; a row without id, label or document gives nothing.
    """
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
              .agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id")
              .limit(params.sample_rows))
    picked = with_text(docs, "doc_id").join(chosen.hint("broadcast"), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(1000))
    return picked.select("doc_id", "text", (F.col("quality") > 0).cast("int").alias("quality"),
                         (fold < int(1000 * params.calibration_share)).alias("apart"))


def fit(docs: DataFrame, labels: DataFrame, params: QualityRules = QualityRules()) -> Model | None:
    """The fitted model; none if the sample lacks good or bad rows. Repeated rows weigh as often as they occur."""
    sample = labelled_sample(docs, labels, params).select("text", "quality", "apart")
    row = sample.repartition(1).mapInArrow(_fit(params), "weights binary, bias double, slope double, shift double").first()
    return row and Model(np.frombuffer(row["weights"], np.float32), row["bias"], row["slope"], row["shift"])


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _judge(params: QualityRules, model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.zeros(256, dtype=bool)
        symbol[list(SYMBOLS)] = True
        for piece in slices(batches, "text", TEXT_SLICE):
            raw, offsets = wordhash.buffers(piece["text"])
            start, end, first = wordhash.words(raw, offsets)
            hashes = wordhash.word_hashes(raw, start, end)
            per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            n_words = np.diff(first)
            chars = per_text((raw & 0xC0) != 0x80) - per_text(wordhash._SPACE[raw])
            whole = raw.tobytes()
            dup = [_dup_lines(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            repeat = _repeated(hashes, first)
            failed = (n_words < params.least_words) | (100 * repeat > params.repeat_percent * n_words)
            p = np.ones(len(n_words))
            if model is not None:
                score = np.full(len(n_words), model.bias)
                for index, upto in _families(raw, offsets, hashes, first, params.family_bits):
                    score += _means(model.weights[index], upto)
                p = model.probability(score)
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], *(pa.array(x, pa.int64()) for x in (n_words, chars, per_text(symbol[raw]), dup, repeat)),
                 pa.array(failed), pa.array(p), pa.array(~failed & (p >= params.least_probability))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "probability", "kept"])

    return run


def _repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the number of words in 3-word windows that occur in it twice or more."""
    n = len(hashes)
    if n < 3:
        return np.zeros(len(first) - 1, dtype=np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window = wordhash.mix(wordhash.mix(hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(3) + hashes[2:])
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    key = window[inside] + wordhash.mix(owner[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(inside), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(n, dtype=bool)
    for j in range(3):
        covered[inside[twice] + j] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[first])


def judge(docs: DataFrame, labels: DataFrame, params: QualityRules = QualityRules(),
          training: DataFrame | None = None) -> DataFrame:
    """(doc_id, five measures, base_failed, probability, kept) for the whole text of every row.

    Words are maximal runs of characters other than space and tab to carriage return. A null or empty
    text has no words and so fails the base rules. The model is fitted on ``labels`` and the documents
    of ``training`` (``docs`` unless given); without labels of both kinds its probability is 1 and the
    base rules decide alone. Rows and ids may repeat or be null: each row is judged by itself. Other
    columns are not read.
    """
    model = fit(docs if training is None else training, labels, params)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_text(docs, "doc_id").mapInArrow(
        _judge(params, model), f"doc_id {kind}, {MEASURES}, base_failed boolean, probability double, kept boolean")


def keep_rows(docs: DataFrame, labels: DataFrame, params: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; a row's verdict depends on its text alone."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    model = fit(docs, labels, params)
    verdict = _judge(params, model)
    name = "kept"
    while name in docs.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bare = pa.RecordBatch.from_arrays([batch["text"], batch["text"]], names=["doc_id", "text"])
                judged = [part["kept"] for part in verdict(iter([bare]))]
                yield batch.append_column(name, pa.concat_arrays(judged))

    schema = StructType([*docs.schema.fields, StructField(name, BooleanType())])
    return docs.mapInArrow(run, schema).where(F.col(f"`{name}`")).drop(name)
