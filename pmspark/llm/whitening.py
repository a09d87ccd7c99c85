"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Two passes over the vectors give their number and sums, then the scatter of the vectors less their mean: each task adds
up its rows and puts out one d by d matrix, and those are added row by row of the matrix, so what meets in a task and what reaches
the driver depends on the dimension, not on the rows. There the scatter becomes F F', F being triangular but for the order of its
rows, with the pivot of the largest remaining variance first, so a scatter without full rank ends early. Plane
rotations of F's columns make them orthogonal (Hestenes); forming F'F, whose small eigenvalues would drown, is never
needed: the columns' squared norms are the scatter's eigenvalues and the columns over their norms its eigenvectors. A third pass projects.

Defined results: a vector that is null, or has no entries, one that is null or not finite, or fewer than the longest of the
usable ones, is dropped; a null id is a value like any other, and repeated rows each count and each have their rows; directions without
variance (all of them where there is one vector, or all are equal) are no components; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import Shared, cut, in_batches, matrix, table

COMPONENTS = 8
#: Whole numbers are taken from here on as this; floor(1024 c) of an embedding is about 10 bits.
WIDEST = 1 << 40


class Whitening(NamedTuple):
    """n vectors, their sums, unit eigenvectors (columns) and eigenvalues of their covariance by falling eigenvalue, and its trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """Rows less their mean; of whole numbers the difference is exact before it is divided."""
        return (rows * self.n - self.sums) / self.n


def finite(vector: Column) -> Column:
    """True for a vector all of whose entries are numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows of whole vectors, and their dimension."""
    good = df.where(finite(F.col(vector)) & (F.size(vector) > 0))
    dimension = good.agg(F.max(F.size(vector))).first()[0] or 0
    return good.where(F.size(vector) == dimension), dimension


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """F with F F' = scatter, a column for each pivot; rows keep the order of the scatter's."""
    left, columns = np.diag(scatter).astype(float), []
    least = left.max(initial=0) * len(left) * np.finfo(float).eps
    for _ in range(len(left)):
        p = int(left.argmax())
        if left[p] <= least:
            break
        column = scatter[:, p] - sum((c * c[p] for c in columns), np.zeros(len(left)))
        column = np.where(left == -np.inf, 0, column) / np.sqrt(left[p])
        columns.append(column)
        left = np.where(left == -np.inf, left, left - column**2)
        left[p] = -np.inf
    return np.stack(columns, axis=1) if columns else np.zeros((len(left), 0))


def rotated(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor's columns, turned by plane rotations until they are orthogonal, the longest first."""
    f, r = factor.copy(), factor.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):  # a round of a tournament: every column meets one other
            p, q = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = f[:, p], f[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, off.max(initial=0))
            turn = off > 1e-16
            z = (b - a)[turn] / (2 * c[turn])
            t = np.where(z < 0, -1, 1) / (np.abs(z) + np.hypot(1, z))
            cos = 1 / np.hypot(1, t)
            x, y = x[:, turn], y[:, turn]
            f[:, p[turn]], f[:, q[turn]] = cos * x - cos * t * y, cos * t * x + cos * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst < 1e-15 * np.sqrt(len(f)):
            break
    return f[:, np.argsort(-(f * f).sum(0), kind="stable")]


def _added(partials: DataFrame) -> np.ndarray:
    """Sums of the arrays ``part`` of each ``i`` by task, in a fixed order: i as the row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = part.values.to_numpy()
                sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([*sums.values()], pa.list_(pa.float64()))], ["i", "part"])

    whole = partials.repartition("i").sortWithinPartitions("i", "task").select("i", "part").mapInArrow(add, "i int, part array<double>")
    return np.array([r["part"] for r in sorted(whole.collect(), key=lambda r: r["i"])])


def _by_task(df: DataFrame, vector: str, of_rows) -> np.ndarray:
    """The sum over all rows of ``of_rows(rows)``, a matrix whose size depends on the dimension alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_rows(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            task = pa.array(np.full(len(total), TaskContext.get().partitionId()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), task, pa.array(list(total), pa.list_(pa.float64()))], ["i", "task", "part"])

    return _added(in_batches(df).select(vector).mapInArrow(read, "i int, task bigint, part array<double>"))


def fit_whitening(df: DataFrame, vector: str = "embedding") -> Whitening:
    """The whitening of the vectors of df, all whole and of one dimension (see ``usable``)."""
    first = _by_task(df, vector, lambda rows: np.append(rows.sum(0), len(rows))[None])
    if not first.size:
        return Whitening(0, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    fit = Whitening(int(first[0, -1]), first[0, :-1], np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums = fit.n, fit.sums

    def scatter(rows: np.ndarray) -> np.ndarray:
        y = (rows * n - sums) / n
        return y.T @ y

    total = _by_task(df, vector, scatter)
    f = rotated(pivoted_cholesky(total)) if np.isfinite(total).all() else np.zeros((len(sums), 0))
    norms = np.sqrt((f * f).sum(0))
    return fit._replace(components=f / norms, eigenvalues=norms**2 / n, trace=float(np.trace(total)) / n)


def whitened(df: DataFrame, fit: Whitening, vector: str = "embedding", components: int = COMPONENTS, name: str = "whitened") -> DataFrame:
    """df with its vectors' projections on the first components, over the roots of their eigenvalues, as array ``name``."""
    k = min(components, len(fit.eigenvalues))
    shared = Shared(df.sparkSession, (fit.n, fit.sums, fit.components[:, :k] / np.sqrt(fit.eigenvalues[:k])))
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, onto = shared.get()
        for batch in batches:
            rows = matrix(batch.column(batch.schema.get_field_index(vector)))
            found = ((rows * n - sums) / n) @ onto if len(rows) else np.zeros((0, k))
            yield batch.append_column(name, pa.array(list(found), pa.list_(pa.float64())))

    return in_batches(df).mapInArrow(project, schema)


def identity_error(white: DataFrame, components: int, name: str = "whitened") -> float | None:
    """The largest absolute entry of the covariance of ``white``'s arrays, less the identity; Spark's co-moments are centred."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    entries = white.agg(*(F.covar_pop(F.col(name)[i], F.col(name)[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max((abs(v - (i == j)) for v, (i, j) in zip(entries, pairs, strict=True)), default=None)


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")))
    limit = float(WIDEST)
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c * 1024))) + 100_000)
    rows, _ = usable(rows.select("vec_id", whole.alias("x")).withColumn("embedding", F.col("x").cast("array<double>")), "embedding")
    fit = fit_whitening(rows)
    k = min(COMPONENTS, len(fit.eigenvalues))
    if not k:
        return spark.createDataFrame([], SCHEMA)
    away = lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(fit.n)), s)
    sums = F.array(*(F.lit(int(s)).cast("bigint") for s in fit.sums))
    square = F.aggregate(F.zip_with("x", sums, away), F.lit(0).cast("bigint"), lambda a, y: F.try_add(a, F.try_multiply(y, y)))
    white = cut(whitened(rows.select("vec_id", square.alias("deviation"), "embedding"), fit).drop("embedding"))
    explained = F.array(*(F.lit(float(e / fit.trace)) for e in fit.eigenvalues[:k]))
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(identity_error(white, k)).cast("double").alias("identity_error"),
    )


QUERIES = {"op11_whitening": op11_whitening}
