"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

Features are the presence of hashed n-grams of 3 to 5 characters, A-Z lower-cased.
Each is scaled by its log-count ratio r = log(p / q), where p and q are the smoothed
shares of toxic and other training texts that hold it; a logistic regression is
fitted on the scaled features. Training uses a bounded sample of labelled texts
(``sample_rows``); scoring reads every byte of every text, in blocks.

Of the n-grams that tell the classes apart at all, the ``features`` best by chi-squared are kept, at every
size of the sample; of equal ones those with the smaller hash. Different n-grams may share one of the 2^``bucket_bits`` hashes.

Null and empty texts score the intercept alone. Without n-grams, or without training rows of both classes,
every score is 0.0. Repeated rows of ``documents`` are scored each for itself and train once per id; long texts
are read whole, in blocks. ``score`` is a column and touches no other; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from ordermill.llm.labelled import training_sample
from ordermill.llm.spans import CHARACTER, LOWER, Block, Hasher, blocks, mixed, part_of
from ordermill.llm.stored import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (3, 4, 5)
    bucket_bits: int = 20
    features: int = 1 << 13  # n-gram buckets kept at most, those that tell the classes apart best
    sample_rows: int = 16_384  # bound of the training sample
    penalty: float = 1e-3
    rounds: int = 40


@dataclass(frozen=True)
class Model:
    settings: Settings
    buckets: np.ndarray
    weights: np.ndarray  # of each bucket: coefficient times log-count ratio
    intercept: float
    trained: bool = True


def _present(block: Block, hasher: Hasher, wanted: np.ndarray | None, settings: Settings) -> np.ndarray:
    """Distinct (row << bucket_bits | bucket) of a block; only ``wanted`` buckets."""
    data = LOWER[block.data]
    sums = hasher.sums(data)
    starts = np.append(np.flatnonzero(CHARACTER[data]), len(data))
    shift, found = np.uint64(64 - settings.bucket_bits), []
    for order in settings.orders:
        if len(starts) <= order:
            continue
        first, after = starts[:-order], starts[order:]
        buckets = (mixed(hasher.runs(sums, first, after)) >> shift).astype(np.int64)
        keep = np.arange(len(buckets)) if wanted is None else np.flatnonzero(wanted[buckets])
        part = part_of(block, first[keep])
        inside = after[keep] <= block.bounds[part + 1]
        found.append((block.rows[part[inside]] << settings.bucket_bits) | buckets[keep[inside]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _keys(texts: pa.Array, hasher: Hasher, wanted: np.ndarray | None, settings: Settings) -> Iterator[np.ndarray]:
    """The distinct keys of a batch, block by block; none comes twice."""
    parts = []
    for block in blocks(texts, CHARACTER, overlap=4 * (max(settings.orders) - 1)):
        keys = _present(block, hasher, wanted, settings)
        if block.whole:
            yield keys
        else:
            parts.append(keys)
    if parts:  # parts of one text may hold the same n-gram
        yield np.unique(np.concatenate(parts))


def _count(settings: Settings):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, size = Hasher(), 1 << settings.bucket_bits
        totals = np.zeros((2, size), np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column("label")) > 0
            for keys in _keys(batch.column("text"), hasher, None, settings):
                of_toxic = toxic[keys >> settings.bucket_bits]
                for side in (0, 1):
                    totals[side] += np.bincount(keys[of_toxic == bool(side)] & (size - 1), minlength=size)
        seen = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(totals[1][seen]), pa.array(totals[0][seen])], ["bucket", "yes", "no"]
        )

    return counted


def _features(settings: Settings, kept: np.ndarray):
    def listed(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, size = Hasher(), 1 << settings.bucket_bits
        place = np.full(size, -1, np.int32)
        place[kept] = np.arange(len(kept))
        for texts in arrays:
            found = list(_keys(texts, hasher, place >= 0, settings))
            keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
            ends = np.searchsorted(keys, np.arange(len(texts) + 1) << settings.bucket_bits)
            values = place[keys & (size - 1)]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return F.arrow_udf(listed, "array<int>", F.ArrowUDFType.SCALAR_ITER)


def log_count_ratios(sample: DataFrame, yes: int, no: int, settings: Settings = Settings()) -> DataFrame:
    """(bucket, ratio, gain) of every n-gram of ``sample`` (text, label) with ``yes`` and ``no`` texts of each class.

    The ratio is the logarithm of the smoothed share of texts that hold it, toxic against other; the
    gain is chi-squared of its presence against the label, from the same shares.
    """
    counts = (
        sample.mapInArrow(_count(settings), "bucket bigint, yes bigint, no bigint")
        .groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    )
    p, q = (F.col("yes") + 1) / F.lit(yes + 2.0), (F.col("no") + 1) / F.lit(no + 2.0)
    middle = (F.col("yes") + F.col("no") + 1) / F.lit(yes + no + 2.0)
    gain = F.lit(yes * no / (yes + no)) * (p - q) * (p - q) / (middle * (1 - middle))
    return counts.select("bucket", F.log(p / q).alias("ratio"), gain.alias("gain"))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Fit on ``documents`` (doc_id, text) and ``labels`` (doc_id, ``label``)."""
    sample = training_sample(documents, labels, label, settings.sample_rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = {row.label: row["count"] for row in sample.groupBy("label").count().collect()}
        yes, no = totals.get(1.0, 0), totals.get(0.0, 0)
        untrained = Model(settings, np.zeros(0, np.int64), np.zeros(0), 0.0, trained=False)
        if not yes or not no:
            return untrained
        # One row per kept bucket comes to the driver: settings.features at most.
        found = log_count_ratios(sample, yes, no, settings).where(F.col("gain") > 0)
        best = found.orderBy(F.col("gain").desc(), "bucket").limit(settings.features).collect()
        if not best:
            return untrained
        kept = np.array([row.bucket for row in best], np.int64)
        ratios = np.array([row.ratio for row in best])

        @F.udf(VectorUDT())
        def scaled(places):
            places = sorted(places)
            return Vectors.sparse(len(ratios), places, ratios[places])

        # Stored in between: a task then runs one Python function at a time.
        listed = stored(sample.select("label", _features(settings, kept)("text").alias("places")), "features")
        training = listed.select("label", scaled("places").alias("features"))
        regression = LogisticRegression(maxIter=settings.rounds, regParam=settings.penalty, standardization=False).fit(training)
        return Model(settings, kept, regression.coefficients.toArray() * ratios, float(regression.intercept))
    finally:
        sample.unpersist()


def _scored(model: Model):
    settings, buckets, weights, intercept = model.settings, model.buckets, model.weights, model.intercept

    def scores(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, size = Hasher(), 1 << settings.bucket_bits
        table = np.zeros(size)
        table[buckets] = weights
        for texts in arrays:
            sums = np.zeros(len(texts))
            for keys in _keys(texts, hasher, table != 0, settings):
                sums += np.bincount(keys >> settings.bucket_bits, weights=table[keys & (size - 1)], minlength=len(texts))
            yield pa.array(1 / (1 + np.exp(-np.clip(sums + intercept, -500, 500))), pa.float64())

    return F.arrow_udf(scores, "double", F.ArrowUDFType.SCALAR_ITER)


def score(model: Model, text: Column) -> Column:
    """Toxicity of a text column, from 0 to 1."""
    if not model.trained:
        return F.lit(0.0)
    return _scored(model)(text)
