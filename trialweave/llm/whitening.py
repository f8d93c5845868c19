"""Whitening of embeddings from a covariance that is found by polarisation.

Components c become whole numbers x = floor(1024 * c) + OFFSET. Two passes over the vectors
give exact sums: first n and the sum S of each dimension, then, of the centred numbers
y = n * x - S, the sum of squares for every dimension and for every sum of two dimensions.
As the square of (y_i + y_j) is y_i**2 + y_j**2 + 2 * y_i * y_j, a difference of those sums of
squares is twice the cross sum, so squares alone recover every covariance:

    cov(i, j) = (Q(i, j) - Q(i) - Q(j)) / (2 * n**3)

All of that is in whole numbers; only the finished fraction is rounded to a double. The
matrix, one number per pair of dimensions and so bounded by MAX_DIMS, is assembled on the
driver for `eigh`. Projection is a narrow pass; the covariance of what it wrote gives the
identity error.

Tasks add up squares themselves and hand over one row per pair of dimensions, whatever the
number of vectors; equal vectors are nothing special.

Vectors that are null or hold a null or non-finite entry take no part, nor do their rows
come back. A component that a shorter vector lacks counts as c = 0; an empty vector is all
zeros. Whole numbers stop at +-2**61. A component whose eigenvalue is zero to double
precision has no whitened value (null) and is left out of the identity error; where no
component is left (one vector, equal vectors) that error is null, and `explained` too if
there is no variance at all. Rows that repeat an id, or have none, are rows of their own.
Eigenvectors have their largest entry positive (the first of equals). An empty table, or one
without a usable vector, gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import map_arrow
from trialweave.session import write_table

SCALE = 1_024
OFFSET = 100_000
COMPONENTS = 8
#: The matrix of so many dimensions still fits the driver.
MAX_DIMS = 2_048
#: Whole numbers are held at this size.
LARGEST = 1 << 61
#: Vectors whose squares are added up at once: sums of so many products of 26-bit halves fit 64 bits.
ROWS = 1_024
HALF = 26
#: Exact sums leave a task as digits of 60 bits.
DIGIT_BITS = 60
DIGITS = 5


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The rows that take part, written: id, x."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    stop = lambda c: F.greatest(F.least(c, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    x = F.transform(v, lambda c: F.floor(stop(c.cast("double") * SCALE)) + F.lit(OFFSET).cast("bigint"))
    return write_table(vectors.where(v.isNotNull() & finite).select(F.col(id_col).alias("id"), x.alias("x")), "whiten-vectors")


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension."""
    n = rows.count()
    sums = (
        rows.select(F.posexplode("x").alias("i", "x"))
        .groupBy("i")
        .agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count("*").alias("m"))
        .limit(MAX_DIMS + 1)
        .collect()
    )
    if len(sums) > MAX_DIMS:
        raise ValueError(f"vectors of more than {MAX_DIMS} dimensions")
    return n, [int(r["s"]) + (n - r["m"]) * OFFSET for r in sorted(sums)]


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; what a shorter one lacks is c = 0."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(len(column), dims)
    out = np.full((len(column), dims), OFFSET, np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = values
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: 64-bit numbers if they are below 2**50, else whole numbers of any size."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if largest < 1 << 50:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(z: np.ndarray) -> np.ndarray:
    """Exact sum of squares of each column, as whole numbers of any size."""
    if z.dtype == object:
        return (z * z).sum(axis=0)
    high, low = z >> HALF, z & ((1 << HALF) - 1)
    added = lambda a, b: np.einsum("ij,ij->j", a, b).astype(object)
    return (added(high, high) << 2 * HALF) + (added(high, low) << HALF + 1) + added(low, low)


def polarised(y: np.ndarray) -> np.ndarray:
    """Sums of squares of every dimension and every sum of two: (0,0), (0,1) .. (0,d-1), (1,1) .."""
    parts = []
    for i in range(y.shape[1]):
        pairs = y[:, i:] + y[:, i : i + 1]
        pairs[:, 0] = y[:, i]
        parts.append(squares(pairs))
    return np.concatenate(parts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _pair_sums(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _slices(batches):
            own = polarised(centred(matrix_of(part.column("x"), len(sums)), n, sums))
            total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(sums))
            mask = (1 << DIGIT_BITS) - 1
            digits = [pa.array([int(v) >> DIGIT_BITS * k & mask for v in total], pa.int64()) for k in range(DIGITS)]
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *digits], ["i", "j", *[f"d{k}" for k in range(DIGITS)]])

    return run


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The matrix over all rows, each entry the correctly rounded exact fraction."""
    schema = "i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))
    digits = [F.sum(F.col(f"d{k}").cast("decimal(28,0)")).alias(f"d{k}") for k in range(DIGITS)]
    found = map_arrow(rows.select("x"), _pair_sums(n, sums), schema).groupBy("i", "j").agg(*digits)
    q = {(r["i"], r["j"]): sum(int(r[f"d{k}"]) << DIGIT_BITS * k for k in range(DIGITS)) for r in found.collect()}
    out = np.zeros((len(sums), len(sums)))
    for (i, j), both in q.items():
        out[i, j] = out[j, i] = both / n**3 if i == j else (both - q[i, i] - q[j, j]) / (2 * n**3)
    return out


def principal(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    if not len(matrix):
        return np.zeros(0), matrix
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)


def _project(n: int, sums: list[int], scaled: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            y = centred(matrix_of(part.column("x"), len(sums)), n, sums)
            if y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2.0**62:
                deviation = [sum(int(v) * int(v) for v in row) for row in y]
            else:
                deviation = (y * y).sum(axis=1).tolist()
            white = (y.astype(np.float64) / n) @ scaled
            yield pa.record_batch(
                [
                    part.column("id"),
                    pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)),
                    pa.array(white.tolist(), pa.list_(pa.float64())),
                ],
                ["id", "deviation", "white"],
            )

    return run


def identity_error(white: DataFrame, used: list[int], n: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened values minus the identity."""
    if not used:
        return None
    at = lambda k: F.col("white")[k]
    means = white.agg(*[F.avg(at(k)) for k in used]).first()
    pairs = [(a, b) for a in range(len(used)) for b in range(a, len(used))]
    sums = white.agg(*[F.sum((at(used[a]) - means[a]) * (at(used[b]) - means[b])) for a, b in pairs]).first()
    return max(abs(s / n - (a == b)) for s, (a, b) in zip(sums, pairs, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    `deviation` is decimal(38,0), null beyond that.
    """
    rows = whole_vectors(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    n, sums = dimension_sums(rows)
    matrix = covariance(rows, n, sums) if n and sums else np.zeros((0, 0))
    values, basis = principal(matrix, components)
    trace = float(np.trace(matrix))
    real = values > len(sums) * np.finfo(float).eps * max(values, default=0.0)
    scaled = basis / np.sqrt(np.where(real, values, 1.0))
    kind = rows.schema["id"].dataType.simpleString()
    white = write_table(map_arrow(rows, _project(n, sums, scaled), f"id {kind}, deviation decimal(38,0), white array<double>"), "whitened")
    error = identity_error(white, [k for k in range(len(values)) if real[k]], n)
    listed = spark.createDataFrame(
        [(k, k + 1, bool(real[k]), float(e) / trace if trace else None) for k, e in enumerate(values)],
        "_k int, component int, _real boolean, explained double",
    )
    names = F.broadcast(listed)  # one row per component
    return (
        white.select("id", "deviation", F.posexplode("white").alias("_k", "_w"))
        .join(names, "_k")
        .select(
            F.col("id").alias(id_col),
            "component",
            F.lit(n).cast("bigint").alias("n"),
            "deviation",
            F.when(F.col("_real"), F.col("_w")).alias("whitened"),
            "explained",
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
