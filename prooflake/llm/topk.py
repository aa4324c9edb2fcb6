"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Components are integers floor(256 x).  Vectors are stored in blocks.  In a block each dimension has a posting list: the
vectors by descending quantised component, cut into segments of equal level (``LEVELS`` a dimension); a posting holds the component too.  Against a query a
posting of dimension d is worth at least 0 beyond the least that d can give, whatever the sign of the query's weight
(for negative weights the list is read from its other end), so each segment has an impact: the most that its postings
can be worth.  Segments of all dimensions are processed by descending impact; their postings add what they are worth
to their vectors' accumulators.

Proof of stopping: a vector's score is at most its accumulator plus the impact of the next segment of each dimension in
which its posting wasn't read, for lists are read in order.  Its score is at least its accumulator.  A vector whose
upper bound lies below the k-th best lower bound, of this block or of exact scores (of some candidates of the block, or
found before), can't be among the best k.  Processing stops when few possible members are left, and exactly
these are scored again in integers.  Ties at the k-th score stay possible members.

Vectors lie in buckets, a few for each core, and queries in groups of ``GROUP``; one shuffle brings each bucket together with
each group.  A task holds a group of queries with their k best so far and one block of vectors at a time; a bucket gives k
rows a query.  Nothing is broadcast but a row for each partition.

Defined cases: null and empty vectors and vectors with null or non-finite components take no part; a missing component
counts as 0; repeated rows are candidates of their own, a query's own id never is; of an id with several different
vectors the least in the order of arrays is the query; a null id takes no part; fewer than k candidates give all; an
empty table gives no rows; further columns of the input are ignored; scores beyond 64 bits are given as the nearest
64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

SCALE = 256
K_BEST = 5
VECTORS, QUERIES = 8192, 512
#: Queries of a group, which a task holds, and buckets of vectors for each core; every group is sent to every bucket.
GROUP, BUCKETS = 64 * QUERIES, 4
#: Levels of the quantised impact of a dimension.
LEVELS = 16
#: Possible members that are scored exactly at once: so many, or this part of a block.
FEW, FEW_PART = 64, 8
#: Parts of the postings after which the bounds are looked at.
STEPS = (0.6, 0.7, 0.8, 1)
#: Candidates of a block that are scored exactly first, about: the more, the earlier the proof.
SEEDS = 1024


def quantised(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part, and their integer vectors."""
    rows, out = [], []
    for i, v in enumerate(column):
        if not v.is_valid:
            continue
        x = v.values
        if x.null_count:
            continue
        x = np.asarray(x.to_numpy(zero_copy_only=False), np.float64) * SCALE
        if np.isfinite(x).all():
            rows.append(i)
            out.append(np.floor(x))
    return np.array(rows, np.int64), out


def _matrix(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    """Integer matrix, zero-padded; Python integers where 64 bits could overflow."""
    width = max([width, *map(len, vectors)])
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    if m.size and np.abs(m).max() > 1 << 26:
        return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return m.astype(np.int64)


class ImpactBlock:
    """One block's postings, by dimension and level.  ``read`` counts the postings that searches have processed."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix, self.read = ids, matrix, 0
        self.exact_only = matrix.dtype == object or not matrix.size
        if self.exact_only:
            return
        self.low, self.high = matrix.min(axis=0), matrix.max(axis=0)
        self.most = int(np.abs(matrix).max())
        self.matrix_float = matrix.astype(np.float64)
        self.unit = (self.high - self.low) // LEVELS + 1
        self.level = ((matrix - self.low) // self.unit).astype(np.uint8)
        self.postings = np.ascontiguousarray(np.argsort(self.level, axis=0, kind="stable").T.astype(np.intp))  # by dimension, ascending level
        self.values = np.ascontiguousarray(np.take_along_axis(self.matrix_float.T, self.postings, axis=1))
        count = np.stack([(self.level == k).sum(axis=0) for k in range(LEVELS)], axis=1)  # (dimension, level)
        self.count, self.first = count, np.cumsum(count, axis=1) - count
        self.least = self.low[:, None] + np.arange(LEVELS) * self.unit[:, None]
        self.most_of = np.minimum(self.least + self.unit[:, None] - 1, self.high[:, None])

    def possible(self, q: np.ndarray, own: int, k: int, known: float = -np.inf) -> np.ndarray:
        """Places of the vectors that can be among the best k of a query; ``known``: a score that k others reach."""
        other = self.ids != own
        if self.exact_only or q.dtype == object or int(np.abs(q).max(initial=0)) * self.most * max(1, len(q)) >= 1 << 52:
            return np.flatnonzero(other)  # sums beyond exact floats: all of them
        few = max(k, FEW, len(self.ids) // FEW_PART)
        if len(self.ids) <= few:
            return np.flatnonzero(other)
        w = q[:, None]
        upper = np.where(w >= 0, w * self.most_of, w * self.least)
        seen = self.count > 0
        floor = np.where(q >= 0, q * self.low, q * self.high)  # the least that a dimension gives
        base = float(floor.sum())
        impact = (upper - floor[:, None]).astype(np.float64)
        dims, levels = np.nonzero(seen & (w != 0))
        by = np.argsort(-impact[dims, levels], kind="stable")
        dims, levels = dims[by], levels[by]
        count = self.count[dims, levels]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        first = self.first[dims, levels]
        score, places, start = np.zeros(len(self.ids)), np.flatnonzero(other), 0
        some = places[:: max(1, len(places) // SEEDS)]
        if len(some) >= k:  # exact scores of a few candidates: k of them reach the k-th best
            known = max(known, float(np.partition(self.matrix_float[some] @ q.astype(np.float64), len(some) - k)[len(some) - k]))
        for step in STEPS:
            end = len(dims) if step == 1 else int(np.searchsorted(upto, total * step))
            # what a step reads of a list is one run of segments
            lo, hi = np.full(len(q), len(self.ids)), np.zeros(len(q), np.int64)
            np.minimum.at(lo, dims[start:end], first[start:end])
            np.maximum.at(hi, dims[start:end], (first + count)[start:end])
            for d, a, z, weight, least in zip(range(len(q)), lo.tolist(), hi.tolist(), q.tolist(), floor.tolist(), strict=True):
                if a < z:
                    score[self.postings[d][a:z]] += weight * self.values[d][a:z] - least
            self.read += int(count[start:end].sum())
            start = end
            reach = score[places]
            if end < len(dims):
                # what the next segment of each dimension can still give to vectors that weren't in the segments read
                rest = np.zeros(len(q))
                np.maximum.at(rest, dims[end:], impact[dims[end:], levels[end:]])
                top, bottom = np.full(len(q), -1), np.full(len(q), LEVELS)
                np.maximum.at(top, dims[end:], levels[end:])
                np.minimum.at(bottom, dims[end:], levels[end:])
                own_level = self.level if len(places) == len(self.ids) else self.level[places]
                open_ = np.where(q >= 0, own_level <= top, own_level >= bottom)
                part = open_.astype(np.float32) @ rest.astype(np.float32)
                part = part + rest.sum() * len(q) * 2.0**-22  # 32-bit sums, rounded up
                reach = reach + (part if len(part) == len(places) else part[places])
            bound = known - base
            if len(places) >= k:
                bound = max(bound, float(np.partition(score[places], len(places) - k)[len(places) - k]))
            places = places[reach >= bound]
            if len(places) <= few:
                break
        return places

    def search(self, q: np.ndarray, own: int, k: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The exact best k (ids, scores) of a query but its own id, of those that reach ``known``; ties: smaller ids."""
        d = self.matrix.shape[1]
        q = np.concatenate((q, np.zeros(max(0, d - len(q)), q.dtype)))[:d]
        alive = self.possible(q, own, k, known)
        score = self.matrix[alive] @ q
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best]


def _pack(size: int):
    """Blocks (part, before, n, ids, vectors, width): ``before`` counts the vectors before it in its partition.

    Vectors are bytes of 16 or 32-bit integers where these hold them, otherwise of float64 integers, exact up to 2^53.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        part, before = TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            width = max(map(len, vectors))
            m = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            most = np.abs(m).max()
            kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([m.astype(kind).tobytes()]), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "before", "n", "ids", "vectors", "width"])

        for b in batches:
            rows, found = quantised(b.column("embedding"))
            own = b.column("vec_id").to_pylist()
            for i, v in zip(rows.tolist(), found, strict=True):
                if own[i] is None or not len(v):
                    continue
                ids.append(own[i])
                vectors.append(v)
                if len(ids) == size:
                    yield out()
                    before += size
                    ids, vectors = [], []
        if ids:
            yield out()

    return run


def _unpack(ids, vectors, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(vectors) // (len(ids) * width)]
    m = np.frombuffer(vectors, kind).reshape(-1, width).astype(np.float64)
    return ids, _matrix(list(m)) if np.abs(m).max(initial=0) > 1 << 26 else m.astype(np.int64)


_LONG = (-(1 << 63), (1 << 63) - 1)


def _search(k: int):
    """Rows come by (bucket, group), queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, queries = None, []
        best: dict[int, list] = {}  # of the queries of this group: the k best so far as (-score, id)

        def out() -> pa.RecordBatch:
            query = [own for own, top in best.items() for _ in top]
            vec = [i for top in best.values() for _, i in top]
            score = [min(max(-s, _LONG[0]), _LONG[1]) for top in best.values() for s, _ in top]
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            for at in range(b.num_rows):
                r = {name: b.column(name)[at].as_py() for name in b.schema.names}
                if place != (r["bucket"], r["group"]):
                    if best:
                        yield out()
                    place, queries, best = (r["bucket"], r["group"]), [], {}
                ids, matrix = _unpack(r["ids"], r["vectors"], r["width"])
                if not r["kind"]:
                    queries.append((ids.tolist(), matrix))
                    continue
                block = ImpactBlock(ids, matrix)
                for owns, q in queries:
                    for own, x in zip(owns, q, strict=True):
                        top = best.get(own, [])
                        i, s = block.search(x, own, k, -top[k - 1][0] if len(top) >= k else -np.inf)
                        best[own] = sorted(top + list(zip((-s).tolist(), i.tolist(), strict=True)))[:k]
        if best:
            yield out()

    return K.lean(run)


def _dealt(blocks: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks with the number of the run of ``size`` vectors that they begin in, and how many such runs there are."""
    starts, total = [], 0
    for part, n in blocks.groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # a row a partition
        starts.append((part, total))
        total += n
    start = blocks.sparkSession.createDataFrame(starts, "part int, start long")
    run = F.floor((F.col("start") + F.col("before")) / size).cast("int")
    return blocks.join(F.broadcast(start), "part").withColumn(name, run).drop("start"), max(1, -(-total // size))


def top_k(spark: SparkSession, vectors: DataFrame, k: int = K_BEST, queries_of: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by ``queries_of``."""
    finite = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(F.expr(finite), F.lit(False)))
    ddl = "part int, before long, n long, ids binary, vectors binary, width int"
    q = source.where(F.col("vec_id") % queries_of == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(_pack(QUERIES), ddl)
    keep = Scratch(spark, "topk")
    q, v = keep.keep(q, "queries"), keep.keep(source.mapInArrow(_pack(VECTORS), ddl), "vectors")
    # buckets of whole blocks, a few for each core
    n = v.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    v, buckets = _dealt(v, VECTORS * max(1, -(-n // (VECTORS * BUCKETS * spark.sparkContext.defaultParallelism))), "bucket")
    q, groups = _dealt(q, GROUP, "group")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    both = v.withColumn("group", all_of(groups)).withColumn("kind", F.lit(1)).unionByName(q.withColumn("bucket", all_of(buckets)).withColumn("kind", F.lit(0)))
    met = both.repartition("bucket", "group").sortWithinPartitions("bucket", "group", "kind", "part", "before")
    found = met.select("bucket", "group", "kind", "ids", "vectors", "width").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors of each query, against all rows."""
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
