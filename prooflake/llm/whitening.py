"""Whitening of embeddings by moments that are merged pairwise.

An entry c becomes the integer floor(``SCALE`` c) plus ``SHIFT``; the shift drops out of everything but the sums, so workers
keep the floor alone.  The fit list is each distinct vector once.  Every partition of it gives its count, its exact sums
and its scatter about its own mean; Chan's formula merges two of these, and treeReduce merges them all, so what
reaches the driver is a few matrices of dimension squared, however many rows there are.  The driver takes the
eigenvectors of the covariance.  A second pass over the fit list projects, and the same moments of the whitened values are
held against the identity.

Defined cases: vectors that are null, empty or hold null or non-finite entries take no part, nor do those with an entry
of ``HUGE`` or more in size, whose floor isn't exact; if lengths differ, the most frequent one counts (of equals the
longest) and other vectors take no part; repeated rows and null ids give rows of their own, but a vector is fitted once;
components whose variance is nothing but rounding are left out, so equal vectors, a single one or an empty table give no
rows; a deviation beyond a long is null; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed by the contract.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries of this size and more: 64 times that is no longer an exact double with a fraction.
HUGE = float(1 << 46)
LONG = 1 << 63


@dataclass
class Moments:
    """Count, exact sums (Python integers, or doubles for whitened values) and scatter about the mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Moments:
        """Of the rows of a matrix."""
        n, dims = values.shape
        if not n:
            return Moments(0, np.zeros(dims, object), np.zeros((dims, dims)))
        if values.dtype == np.int64 and n * int(np.abs(values).max(initial=0)) >= LONG // 2:
            values = values.astype(object)
        sums = values.sum(axis=0)
        centred = ((n * values - sums) / n).astype(np.float64)  # of integers, exact but for one division
        return Moments(n, sums.astype(object), centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the scatters and that of the two means."""
        if not self.n or not other.n:
            return self if self.n else other
        apart = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)], np.float64)
        between = np.outer(apart, apart) * (self.n / (self.n + other.n) * other.n)
        return Moments(self.n + other.n, self.sums + other.sums, self.scatter + other.scatter + between)

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dims`` entries."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(col), dims)


def moments(vectors: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments:
    """Moments of all rows of the column ``y``, mapped by ``of``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments(0, np.zeros(0, object), np.zeros((0, 0)))
        for b in batches:
            values = matrix(b.column("y"), dims)
            if len(values):
                held = held.merged(Moments.of(of(values) if of else values))
        sums = [str(x) if isinstance(x, int) else float(x).hex() for x in held.sums]
        yield pa.RecordBatch.from_arrays([pa.array([held.n]), pa.array([sums], pa.list_(pa.string())), pa.array([held.scatter.tobytes()], pa.binary())], names=["n", "sums", "scatter"])

    def read(row) -> Moments:
        number = float.fromhex if of else int
        sums = np.array([number(x) for x in row.sums], object)
        return Moments(row.n, sums, np.frombuffer(row.scatter, np.float64).reshape(len(sums), len(sums)))

    parts = vectors.mapInArrow(part, "n long, sums array<string>, scatter binary").rdd.map(read)
    if not parts.getNumPartitions():
        return Moments(0, np.zeros(0, object), np.zeros((0, 0)))
    return parts.treeReduce(Moments.merged, depth=2 if parts.getNumPartitions() < 1000 else 3)


@dataclass
class Whitening:
    """What the fit gives: all of a size that doesn't depend on the rows."""

    n: int
    sums: list[int]  # of the floors, without the shift
    values: np.ndarray  # eigenvalues kept, falling
    vectors: np.ndarray  # their unit eigenvectors as columns
    trace: float

    def off_mean(self, y: np.ndarray) -> np.ndarray:
        """n y - S, in integers: 64 bits where they suffice."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < LONG:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def project(self, y: np.ndarray) -> np.ndarray:
        centred = self.off_mean(y).astype(np.float64) / self.n
        return centred @ (self.vectors / np.sqrt(self.values))

    def deviation(self, y: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n y - S)^2, exactly; null beyond a long."""
        d = self.off_mean(y)
        most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0)))) if d.size else 0
        if d.dtype == np.int64 and most * most * max(1, y.shape[1]) < LONG:
            return pa.array((d * d).sum(axis=1))
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        return pa.array([v if v < LONG else None for v in exact], pa.int64())


def floors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(ident, y): the floors of the vectors that take part."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(HUGE)), F.lit(False)))
    valid = rows.where(v.isNotNull() & (F.size(v) > 0) & fine)
    return valid.select(F.col(ident).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))).alias("y"))


def fit(vectors: DataFrame, dims: int, most: int = COMPONENTS) -> Whitening:
    """Of the distinct vectors given."""
    m = moments(vectors, dims)
    if not m.n:
        return Whitening(0, [], np.zeros(0), np.zeros((dims, 0)), 0.0)
    cov = m.covariance()
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1], columns[:, ::-1]
    real = int((values > max(values[0], 0.0) * dims * np.finfo(np.float64).eps).sum()) if values[0] > 0 else 0
    k = min(most, real)
    return Whitening(m.n, [int(s) for s in m.sums], values[:k].copy(), columns[:, :k].copy(), float(np.trace(cov)))


def whiten(spark: SparkSession, rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """((vec_id, component, n, deviation, whitened, explained, identity_error), fit, identity error)."""
    keep = Scratch(spark, "whitening")
    own = keep.keep(floors(rows, ident, vector), "floors")
    size = own.groupBy(F.size("y").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    dims = size["d"] if size else 0
    own = own.where(F.size("y") == dims)
    distinct = keep.keep(own.select("y").distinct(), "fit")
    found = fit(distinct, dims, most)
    k = len(found.values)
    error = float(np.abs(moments(distinct, dims, found.project).covariance() - np.eye(k)).max()) if k else 0.0
    explained = found.values / found.trace if k else np.zeros(0)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not k or not b.num_rows:
                continue
            y = matrix(b.column("y"), dims)
            at = pa.array(np.repeat(np.arange(b.num_rows), k))
            columns = [
                b.column("vec_id").take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(b.num_rows * k, found.n)),
                found.deviation(y).take(at),
                pa.array(found.project(y).ravel()),
                pa.array(np.tile(explained, b.num_rows)),
                pa.array(np.full(b.num_rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return own.mapInArrow(out, schema), found, error


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
