"""Whitening of embeddings by their principal components.

Whole-number sums of the rows and of the products of their centred entries come from
every partition; what reaches the driver is one number per dimension and pair of
dimensions. There the scatter is factored by Cholesky with pivoting, and one-sided Jacobi
rotations make the columns of the triangular factor orthogonal: their squared
norms are the eigenvalues and the columns, normalised, the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from tidemill.llm.common import parts, stored

#: Entries become whole numbers: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Larger whole numbers than this have no place in a double.
LARGEST = 1 << 52


def whole_vectors(batch: pa.RecordBatch, dimensions: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of a batch that take part, and their entries as whole numbers, one row each."""
    rows, vectors = [], []
    column = batch.column(batch.num_columns - 1)
    for row, vector in enumerate(column):
        values = vector.values
        if values is None or not len(values) or values.null_count or (dimensions is not None and len(values) != dimensions):
            continue
        entries = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(entries).all():
            scaled = np.floor(SCALE * entries)
            if np.abs(scaled).max() >= LARGEST:
                raise ValueError(f"an entry times {SCALE} does not fit a whole number of 52 bits")
            rows.append(row)
            vectors.append(scaled.astype(np.int64) + OFFSET)
    return np.array(rows, np.int64), vectors


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and entry sums of the rows of a partition, by their length."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in parts(batches):
        for x in whole_vectors(batch)[1]:
            n, total = found.get(len(x), (0, 0))
            found[len(x)] = (n + 1, total + x)
    for size, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total, pa.int64())],
            names=["size", "at", "n", "total"],
        )


def _products(dimensions: int, centre: np.ndarray):
    """Sums of products of centred entries of a partition: exact, as all of them are whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((dimensions, dimensions), object)
        seen = False
        for batch in parts(batches):
            vectors = whole_vectors(batch, dimensions)[1]
            if vectors:
                seen = True
                scatter += exact_products(np.array(vectors) - centre)
        if seen:
            left, right = np.tril_indices(dimensions)
            sums = [Decimal(int(value)) for value in scatter[left, right]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(sums, pa.decimal128(38, 0))],
                names=["left", "right", "total"],
            )

    return run


def exact_products(centred: np.ndarray) -> np.ndarray:
    """``centred.T @ centred`` in whole numbers without rounding or overflow."""
    largest = int(np.abs(centred).max(initial=0))
    if largest * largest * len(centred) < 1 << 53:
        doubles = centred.astype(np.float64)
        return (doubles.T @ doubles).astype(np.int64).astype(object)
    whole = centred.astype(object)
    return whole.T @ whole


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``factor`` (lower triangular, a column per rank) and ``order`` with ``matrix[order][:, order] = factor @ factor.T``."""
    size = len(matrix)
    left = np.array(matrix, np.float64)
    order = np.arange(size)
    factor = np.zeros((size, size))
    largest = left.diagonal().max(initial=0.0)
    for k in range(size):
        pivot = k + int(np.argmax(left.diagonal()[k:]))
        if left[pivot, pivot] <= largest * size * np.finfo(float).eps:
            return factor[:, :k], order
        for swapped in (left, factor, order[:, None]):
            swapped[[k, pivot]] = swapped[[pivot, k]]
        left[:, [k, pivot]] = left[:, [pivot, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rounds(columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs that share none."""
    seats = list(range(columns + columns % 2))
    half = len(seats) // 2
    for _ in range(max(len(seats) - 1, 0)):
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < columns]
        if pairs:
            yield tuple(np.array(side) for side in zip(*pairs, strict=True))
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi_columns(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated against each other until every two of them are orthogonal."""
    columns = np.array(factor, np.float64)
    tolerance = len(columns) * np.finfo(float).eps
    for _ in range(most_sweeps):
        rotated = False
        for a, b in rounds(columns.shape[1]):
            x, y = columns[:, a], columns[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if not turn.any():
                continue
            rotated = True
            half = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1), 0)
            tangent = np.where(turn, np.where(half < 0, -1, 1) / (np.abs(half) + np.hypot(half, 1)), 0)
            cosine = 1 / np.hypot(tangent, 1)
            sine = cosine * tangent
            columns[:, a], columns[:, b] = cosine * x - sine * y, sine * x + cosine * y
        if not rotated:
            break
    return columns


@dataclass(frozen=True)
class Components:
    """Principal components of the whole-number vectors of a table, largest eigenvalue first."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray  # a row per component
    eigenvalues: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The means, rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)


def components_of(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors, a row each, and eigenvalues of a positive semidefinite matrix, falling; null directions are left out.

    The largest entry of a component is positive.
    """
    factor, order = pivoted_cholesky(scatter)
    columns = jacobi_columns(factor)
    values = (columns * columns).sum(0)
    falling = np.argsort(-values, kind="stable")
    vectors = np.zeros((len(falling), len(scatter)))
    vectors[:, order] = (columns[:, falling] / np.sqrt(values[falling])).T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]) if len(vectors) else np.zeros(0)
    return vectors * signs[:, None], values[falling]


def fit(table: DataFrame, vector: str = "embedding") -> Components | None:
    """Components of all vectors that take part; ``None`` if there are none.

    Two passes: sums, then products of entries centred by the rounded mean. The
    rest of the mean, half a unit at most, is taken off in whole numbers, so that the
    scatter is that of the exactly centred entries, rounded once, whatever the
    partitions.
    """
    entries = table.select(F.col(vector).cast("array<double>").alias("vector"))
    found = entries.mapInArrow(_sums, "size int, at int, n bigint, total bigint").groupBy("size", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    commonest = found.where("at = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if commonest is None:
        return None
    d, n = commonest["size"], commonest["n"]
    totals = {row["at"]: int(row["total"]) for row in found.where(F.col("size") == d).collect()}
    sums = tuple(totals[at] for at in range(d))
    known = Components(n, sums, np.zeros((0, d)), np.zeros(0), 0.0)
    rest = np.array([s - n * int(c) for s, c in zip(sums, known.centre, strict=True)], object)
    products = (
        entries.mapInArrow(_products(d, known.centre), "left int, right int, total decimal(38,0)")
        .groupBy("left", "right")
        .agg(F.sum("total").alias("total"))
        .collect()
    )
    scatter = np.zeros((d, d))
    for row in products:
        left, right = row["left"], row["right"]
        # n times the scatter of the centred entries is whole: round it once, when it is divided
        scatter[left, right] = scatter[right, left] = (n * int(row["total"]) - int(rest[left]) * int(rest[right])) / (n * n)
    vectors, values = components_of(scatter)
    return Components(n, sums, vectors, values, float(np.trace(scatter)))


def _projected(model: Components, most: int):
    """Per row that takes part: its key, squared deviation times n squared, and its whitened entries."""
    centre = model.centre
    rest = [s - model.n * int(c) for s, c in zip(model.sums, centre, strict=True)]
    offsets = np.array([r / model.n for r in rest])
    weights = (model.vectors[:most] / np.sqrt(model.eigenvalues[:most])[:, None]).T
    squares = sum(r * r for r in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows, vectors = whole_vectors(batch, len(centre))
            if not len(rows):
                continue
            centred = np.array(vectors) - centre
            whole = centred.astype(object) if int(np.abs(centred).max()) ** 2 * centred.shape[1] >= 1 << 62 else centred
            lengths = (whole * whole).sum(1)
            crossed = [sum(map(int.__mul__, row, rest)) for row in centred.tolist()]
            deviations = [
                Decimal(model.n * model.n * int(a) - 2 * model.n * b + squares) for a, b in zip(lengths, crossed, strict=True)
            ]
            whitened = (centred - offsets) @ weights
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(deviations, pa.decimal128(38, 0)),
                    pa.array(list(whitened), pa.list_(pa.float64())),
                ],
                names=["key", "deviation", "whitened"],
            )

    return run


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """One row per vector that takes part and component up to ``most``: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` (decimal) is the sum over dimensions of ``(n * x - S)`` squared, exact;
    ``whitened`` the centred row projected on the component over the root of its eigenvalue;
    ``explained`` the component's share of the variance; ``identity_error`` how far the
    covariance of what was whitened is from the identity, at most.

    Vectors that are null or empty or hold null or non-finite entries take no part, nor do those of
    another length than most (of lengths alike frequent, the longer one counts). Repeated rows and null keys stay rows of their own.
    Directions without any variance have no component: equal vectors alone, or one, or an empty table, give no
    rows. Entries of 2^52 / 1024 or more raise an error. Columns other than the two are ignored, whatever their names.
    """
    spark = table.sparkSession
    kind = table.schema[key].dataType
    model = fit(table, vector)
    schema = StructType(
        [StructField("key", kind), StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))]
    )
    held = 0 if model is None else min(most, len(model.vectors))
    if not held:
        names = [StructField(key, kind), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0))]
        names += [StructField(name, DoubleType()) for name in ("whitened", "explained", "identity_error")]
        return spark.createDataFrame([], StructType(names))
    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = stored(rows.mapInArrow(_projected(model, held), schema), "whitened")
    pairs = [(a, b) for a in range(held) for b in range(a + 1)]
    entry = lambda at: F.element_at("whitened", at + 1)
    found = rows.select(*(F.covar_pop(entry(a), entry(b)) for a, b in pairs)).first()
    error = max(abs(value - (a == b)) for value, (a, b) in zip(found, pairs, strict=True))
    shares = F.array(*(F.lit(float(value / model.trace)) for value in model.eigenvalues[:held]))
    listed = rows.select("key", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return listed.select(
        F.col("key").alias(key),
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
