"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Each text gives one value per distinct hashed word, 1 / sqrt(number of distinct words),
and a 1 for the bin of each structure statistic (shares of letters, capitals, digits,
symbols, repeated words and so on) and of its size. The machine adds linear terms and
low-rank interactions of all pairs, computed in linear time as
0.5 * sum over factors of ((sum v x)^2 - sum (v x)^2).

It is fitted on a bounded sample of labelled texts (``sample_rows``); scoring reads
every byte of every text, in blocks. Null and empty texts have no words and fall into
the lowest bins. Without training rows of both classes every score is 1.0. Repeated rows of ``documents`` are scored each
for itself and train once per id. ``score`` is a column and touches no other; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from ordermill.llm.labelled import training_sample
from ordermill.llm.spans import CHARACTER, LOWER, WHITE, Block, Hasher, blocks, mixed, part_of, word_places
from ordermill.llm.stored import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Classes of bytes: capitals, small letters, digits, white space, line ends, sentence
# marks, other symbols, first and later bytes of other characters.
CAPITAL, SMALL, DIGIT, SPACE, LINE, MARK, SYMBOL, WIDE, LATER = range(9)
_CLASSES = 16
# Fixed edges of the bins of a share, and of the logarithm of a size.
_SHARES = np.array([0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
_SIZES = np.array([3.0, 5.0, 6.0, 7.0, 8.0, 9.0, 11.0])
_BINS = len(_SHARES) + 1
STATISTICS = (
    "capitals", "digits", "symbols", "marks", "wide", "spaces", "lines",
    "repeated_next", "distinct_words", "word_length", "words", "size",
)
_WORD_BITS = 20


def _byte_classes() -> np.ndarray:
    kind = np.full(256, SYMBOL, np.int64)
    codes = np.arange(256)
    kind[(codes >= 65) & (codes <= 90)] = CAPITAL
    kind[(codes >= 97) & (codes <= 122)] = SMALL
    kind[(codes >= 48) & (codes <= 57)] = DIGIT
    kind[WHITE] = SPACE
    kind[10] = LINE
    kind[[ord(c) for c in ".,;:'\"?-()"]] = MARK
    kind[codes >= 128] = np.where(CHARACTER, WIDE, LATER)[codes >= 128]
    return kind


@dataclass(frozen=True)
class Settings:
    word_bits: int = 12
    factors: int = 4
    sample_rows: int = 4_096  # bound of the training sample
    rounds: int = 40
    step: float = 0.1
    penalty: float = 1e-4

    @property
    def size(self) -> int:
        return (1 << self.word_bits) + len(STATISTICS) * _BINS


@dataclass(frozen=True)
class Model:
    settings: Settings
    linear: np.ndarray
    factors: np.ndarray
    intercept: float
    trained: bool = True


def _measure(block: Block, hasher: Hasher, kinds: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Add a block's byte and word counts to ``totals``; its distinct (row, word) keys."""
    pieces = len(block.rows)
    piece = np.repeat(np.arange(pieces), np.diff(block.bounds))
    counts = np.bincount(piece * _CLASSES + kinds[block.data], minlength=pieces * _CLASSES)
    totals[block.rows, :_CLASSES] += counts.reshape(pieces, _CLASSES)
    starts, ends = word_places(block, ~WHITE)
    words = mixed(hasher.runs(hasher.sums(LOWER[block.data]), starts, ends))
    part = part_of(block, starts)
    totals[block.rows, _CLASSES] += np.bincount(part, minlength=pieces)
    again = np.flatnonzero((words[1:] == words[:-1]) & (part[1:] == part[:-1]))
    totals[block.rows, _CLASSES + 1] += np.bincount(part[again], minlength=pieces)
    return np.unique((block.rows[part] << _WORD_BITS) | (words >> np.uint64(64 - _WORD_BITS)).astype(np.int64))


def _inputs(texts: pa.Array, hasher: Hasher, kinds: np.ndarray, settings: Settings):
    """Bins of each text (rows x statistics), rows and buckets of the words, value per row."""
    totals = np.zeros((len(texts), _CLASSES + 2), np.int64)
    found, parts = [], []
    for block in blocks(texts, WHITE):
        (found if block.whole else parts).append(_measure(block, hasher, kinds, totals))
    if parts:
        found.append(np.unique(np.concatenate(parts)))
    keys = np.concatenate(found) if found else np.zeros(0, np.int64)
    row = keys >> _WORD_BITS
    bucket = (keys & ((1 << _WORD_BITS) - 1)) >> (_WORD_BITS - settings.word_bits)
    distinct = np.bincount(row, minlength=len(texts))
    size = totals[:, : _CLASSES].sum(axis=1) - totals[:, LATER]
    words, again = totals[:, _CLASSES], totals[:, _CLASSES + 1]
    letters = np.maximum(1, totals[:, CAPITAL] + totals[:, SMALL] + totals[:, WIDE])
    shares = [totals[:, CAPITAL] / letters]
    shares += [totals[:, kind] / np.maximum(1, size) for kind in (DIGIT, SYMBOL, MARK, WIDE, SPACE)]
    shares += [totals[:, LINE] / np.maximum(1, words), again / np.maximum(1, words), distinct / np.maximum(1, words)]
    sizes = [2 * np.log1p(size / np.maximum(1, words)), np.log1p(words), np.log1p(size)]
    binned = [np.searchsorted(_SHARES, share, side="right") for share in shares]
    binned += [np.searchsorted(_SIZES, value, side="right") for value in sizes]
    bins = np.stack(binned, axis=1) + np.arange(len(STATISTICS)) * _BINS + (1 << settings.word_bits)
    return bins, row, bucket, 1 / np.sqrt(np.maximum(1, distinct))


def _features(settings: Settings):
    kind = pa.struct([("places", pa.list_(pa.int32())), ("value", pa.float64())])

    def listed(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, kinds = Hasher(), _byte_classes()
        for texts in arrays:
            bins, row, bucket, value = _inputs(texts, hasher, kinds, settings)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(texts) + 1))
            words = bucket[order]
            yield pa.array(
                [
                    {"places": np.concatenate([words[a:b], bins[i]]).astype(np.int32), "value": value[i]}
                    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))
                ],
                kind,
            )

    return F.arrow_udf(listed, "struct<places:array<int>,value:double>", F.ArrowUDFType.SCALAR_ITER)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings()) -> Model:
    """Fit on ``documents`` (doc_id, text) and ``labels`` (doc_id, ``label``)."""
    sample = training_sample(documents, labels, label, settings.sample_rows)
    first_bin, size = 1 << settings.word_bits, settings.size

    @F.udf(VectorUDT())
    def vector(listed):
        places = np.array(listed["places"])
        words, counts = np.unique(places[places < first_bin], return_counts=True)
        bins = np.sort(places[places >= first_bin])
        return Vectors.sparse(
            size, np.concatenate([words, bins]), np.concatenate([counts * listed["value"], np.ones(len(bins))])
        )

    # Stored in between: a task then runs one Python function at a time.
    listed = stored(sample.select("label", _features(settings)("text").alias("listed")), "features")
    training = listed.select("label", vector("listed").alias("features"))
    training = training.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        classes = training.groupBy("label").count().collect()
        if len(classes) < 2:
            return Model(settings, np.zeros(size), np.zeros((size, settings.factors)), 0.0, trained=False)
        machine = FMClassifier(
            factorSize=settings.factors, maxIter=settings.rounds, stepSize=settings.step,
            regParam=settings.penalty, initStd=0.05, solver="adamW", seed=7, tol=1e-6,
        ).fit(training)
        return Model(settings, machine.linear.toArray(), machine.factors.toArray(), float(machine.intercept))
    finally:
        training.unpersist()


def _scored(model: Model):
    settings, linear, factors, intercept = model.settings, model.linear, model.factors, model.intercept

    def scores(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, kinds = Hasher(), _byte_classes()
        for texts in arrays:
            bins, row, bucket, value = _inputs(texts, hasher, kinds, settings)

            def of_words(column: np.ndarray) -> np.ndarray:
                return np.bincount(row, weights=column[bucket], minlength=len(texts))

            total = intercept + value * of_words(linear) + linear[bins].sum(axis=1)
            for factor in factors.T:
                squares = factor * factor
                plain = value * of_words(factor) + factor[bins].sum(axis=1)
                total += 0.5 * (plain * plain - value * value * of_words(squares) - squares[bins].sum(axis=1))
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))), pa.float64())

    return F.arrow_udf(scores, "double", F.ArrowUDFType.SCALAR_ITER)


def score(model: Model, text: Column) -> Column:
    """Quality of a text column, from 0 to 1."""
    if not model.trained:
        return F.lit(1.0)
    return _scored(model)(text)
