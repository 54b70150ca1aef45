"""Whitened embeddings: principal components by the exact characteristic polynomial.

Each entry c becomes the integer x = floor(256 * c). The fit list holds each distinct integer vector
once, n in all. Its scatter n * sum(x x') - S S' is summed in integers, so n^2 times the
covariance V is known exactly. The characteristic polynomial of that matrix is
computed modulo enough 31-bit primes, one Spark row each, by reduction to Hessenberg form, and
put together by the Chinese remainder theorem. Its largest roots are isolated by Descartes' rule and
halved to 128 bits; inverse iteration in decimal numbers gives a unit vector of each
root's null space. A component's largest entry is positive.

Rows whose vector is null or holds null, NaN or infinite entries are dropped; ids may be null or repeat,
and repeated rows give repeated results. A vector shorter than the longest counts as padded with
zeros. Components whose eigenvalue is 0 have null ``whitened`` and, where all are 0, null
``explained``; ``identity_error`` looks at the others and is 0.0 without any. Equal eigenvalues get
orthogonal vectors of their common space. ``deviation`` is null where it does not fit a long. Tables without such
rows give no rows, and other columns are left out, whatever their names.

The driver sees d * d sums, whatever the number of rows; the fit list is stored in the shared folder.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ordermill.llm import charpoly
from ordermill.llm.stored import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
_LIMB = 40  # sums travel as two parts, of which the lower has so many bits
_EXACT = 1 << 53  # float products and sums below this are exact


@dataclass(frozen=True)
class Scatter:
    """Of the fit list: its size, per-dimension sums, and n * sum(x x') - S S'."""

    n: int
    sums: list[int]
    matrix: list[list[int]]


@dataclass(frozen=True)
class Components:
    scatter: Scatter
    eigenvalues: list[float]  # of the covariance, falling
    explained: list[float | None]
    vectors: np.ndarray  # one row per component


def integers(vector: Column) -> Column:
    """floor(256 * c) of each entry, as longs; null where an entry is null or not finite."""
    value = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(finite, F.transform(value, lambda c: F.floor(c * SCALE)))


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of longs, padded with zeros."""
    lengths = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten(), np.int64)
    out = np.zeros((len(vectors), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def _products(x: np.ndarray):
    """Integer sums of products of columns: floats where they are exact, else Python's integers."""
    widest = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if widest * widest * len(x) < _EXACT:
        return (x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
    wide = x.astype(object)
    return wide.T @ wide


def _partial_sums(size: int):
    """(place, high, low): sums of products at i * size + j, i <= j, and those of entries at size * size + i."""
    rows, columns = np.triu_indices(size)
    places = np.concatenate([rows * size + columns, size * size + np.arange(size)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(places), object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for start in range(0, len(x), 4096):
                part = x[start : start + 4096]
                entries = part.astype(object).sum(axis=0) if int(np.abs(part.astype(np.float64)).max(initial=0)) >= 1 << 50 else part.sum(axis=0)
                totals += np.concatenate([_products(part)[rows, columns], entries]).astype(object)
        high = pa.array([Decimal(int(v) >> _LIMB) for v in totals], pa.decimal128(38, 0))
        low = pa.array([int(v) & ((1 << _LIMB) - 1) for v in totals], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), high, low], ["place", "high", "low"])

    return summed


def scatter(fit: DataFrame) -> Scatter | None:
    """The scatter of ``fit`` (x array<bigint>), or None where it has no entries."""
    about = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("size")).first()
    n, size = about["n"], about["size"]
    if not n or not size:
        return None
    partial = fit.mapInArrow(_partial_sums(size), "place bigint, high decimal(38,0), low bigint")
    total = partial.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low"))
    found = {row.place: (int(row.high) << _LIMB) + int(row.low) for row in total.collect()}  # d * d rows
    sums = [found[size * size + i] for i in range(size)]
    matrix = [[n * found[min(i, j) * size + max(i, j)] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    return Scatter(n, sums, matrix)


def _remainders(matrix: list[list[int]]):
    whole = np.array(matrix, object)

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            primes = batch.column(0).to_pylist()
            found = [charpoly.polynomial_modulo(whole, p) for p in primes]
            yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["prime", "coefficients"])

    return computed


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), constant first; one prime per row of a DataFrame."""
    size = len(matrix)
    bits = charpoly.coefficient_bits(sum(matrix[i][i] for i in range(size)), size)
    primes = charpoly.largest_primes(bits // 30 + 1)  # the product of c primes has more than 30 c bits
    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(tasks)
    rows = listed.mapInArrow(_remainders(matrix), "prime bigint, coefficients array<bigint>").collect()
    return charpoly.combined(sorted((row.prime, row.coefficients) for row in rows))


def components(spark: SparkSession, of: Scatter, count: int) -> Components:
    """The ``count`` largest eigenvalues of the covariance, and their unit vectors."""
    factor = charpoly.content(of.matrix)
    matrix = [[v // factor for v in row] for row in of.matrix]
    polynomial = characteristic_polynomial(spark, matrix)
    roots = charpoly.largest_roots(polynomial, count)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    vectors: list[np.ndarray] = []
    for group in sorted({g for _, g in roots}):
        same = [root for root, g in roots if g == group]
        vectors += charpoly.null_vectors(matrix, same[0], len(same))
    signed = []
    for vector in vectors:
        vector = vector / max(vector, key=abs) * abs(max(vector, key=abs))
        signed.append([float(v) for v in vector])
    with localcontext(Context(prec=60)):
        eigenvalues = [float(root * factor / of.n / of.n) for root, _ in roots]
        explained = [float(root / trace) if trace else None for root, _ in roots]
    return Components(of, eigenvalues, explained, np.array(signed))


def _whitener(fitted: Components):
    """Of rows of longs: (deviation, whitened values)."""
    n, size = fitted.scatter.n, len(fitted.scatter.sums)
    sums = np.array(fitted.scatter.sums, object)
    small = max((abs(v) for v in fitted.scatter.sums), default=0) < 1 << 62
    used = [k for k, e in enumerate(fitted.eigenvalues) if e > 0]
    # Unit vectors over the standard deviation; x is centred before it is multiplied.
    directions = (fitted.vectors[used].T / np.sqrt([fitted.eigenvalues[k] for k in used])) if used else np.zeros((size, 0))

    def whiten(vectors: pa.Array) -> tuple[list[int | None], np.ndarray]:
        x = _matrix(vectors, size)
        bound = (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) * n + max((abs(v) for v in fitted.scatter.sums), default=0)
        if small and bound * bound * size < 1 << 63:
            centred = n * x - sums.astype(np.int64)
            deviation = (centred * centred).sum(axis=1).tolist()
        else:
            centred = n * x.astype(object) - sums
            deviation = [v if v < 1 << 63 else None for v in (centred * centred).sum(axis=1)]
        values = np.full((len(x), len(fitted.eigenvalues)), np.nan)
        values[:, used] = (centred / n).astype(np.float64) @ directions
        return deviation, values

    return whiten


_ROWS = pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])


def _whitened(fitted: Components):
    def computed(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        whiten, count = _whitener(fitted), len(fitted.eigenvalues)
        for vectors in arrays:
            deviation, values = whiten(vectors)
            flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * count, pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], fields=list(_ROWS))

    return F.arrow_udf(computed, "struct<deviation:bigint,whitened:array<double>>", F.ArrowUDFType.SCALAR_ITER)


def identity_error(fit: DataFrame, fitted: Components) -> float:
    """Largest entry, by absolute value, of the whitened fit list's covariance minus the identity."""
    used = [k for k, e in enumerate(fitted.eigenvalues) if e > 0]
    if not used:
        return 0.0
    values = fit.select(_whitened(fitted)("x")["whitened"].alias("w")).select(*(F.col("w")[k].alias(f"w{k}") for k in used))
    pairs = [(a, b) for i, a in enumerate(used) for b in used[i:]]
    row = values.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whitened(embeddings: DataFrame, count: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row of
    ``embeddings`` (vec_id, embedding) and each of its ``count`` first components."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", integers(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    fit = stored(rows.select("x").distinct(), "fit-list")
    of = scatter(fit)
    if of is None:
        columns = "0 AS component, 0L AS n, 0L AS deviation, 0D AS whitened, 0D AS explained, 0D AS identity_error"
        return rows.where("false").selectExpr("vec_id", *columns.split(", "))
    fitted = components(spark, of, count)
    error = identity_error(fit, fitted)
    numbered = F.posexplode("r.whitened").alias("place", "whitened")
    listed = rows.select("vec_id", _whitened(fitted)("x").alias("r")).select("vec_id", F.col("r.deviation").alias("deviation"), numbered)
    explained = F.array(*(F.lit(v).cast("double") for v in fitted.explained))
    return listed.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(of.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
