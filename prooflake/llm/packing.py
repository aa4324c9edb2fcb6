"""Best-fit-decreasing packing of tokenised documents into windows.

Documents are cut into full windows and one remainder.  Best fit decreasing depends on the remainders' lengths alone,
so it runs on their histogram, at most window - 1 numbers whatever the corpus size: equal lengths are placed in runs
of equal windows, and a segment tree over remaining capacities finds the tightest open window.  Every piece then finds
its window from its place among the pieces of its length, which prefix sums over (length, input partition) give.

Defined cases: a null text is empty, a document of the end id alone; repeated rows are documents of their own; an
empty table gives no rows; further columns of the input are ignored; very long texts give many full windows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch
from .wordcache import WordCache

VOCABULARY = "byte_bpe_50k.json"


class CapacityTree:
    """Segment tree over remaining capacities 0..top: which have open windows."""

    def __init__(self, top: int):
        self.n = 1 << top.bit_length()
        self.any = [False] * (2 * self.n)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]

    def _mark(self, c: int) -> None:
        k, v = c + self.n, bool(self.groups[c])
        while k and self.any[k] != v:
            self.any[k] = v
            k >>= 1
            v = self.any[2 * k] or self.any[2 * k + 1]

    def put(self, capacity: int, first: int, count: int) -> None:
        if count and capacity:
            self.groups[capacity].append((first, count))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        out = self.groups[capacity].pop()
        self._mark(capacity)
        return out

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open window."""
        k = least + self.n
        if self.any[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.n:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.n
            k >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first index, first window, pieces a window, offset) and the number of windows.

    Equal to placing the lengths one by one, longest first, each into the tightest window that holds it: a window
    that took a piece is the tightest for the next equal one for as long as it holds it.
    """
    tree, runs, opened = CapacityTree(window), [], 0
    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        while left:
            c = tree.tightest(length)
            if c is None:
                c, first, count = window, opened, -(-left // (window // length))
                opened += count
            else:
                first, count = tree.take(c)
            q = c // length
            full = min(count, left // q)
            if full:
                runs.append((length, at, first, q, window - c))
                tree.put(c - q * length, first, full)
                left, at, first, count = left - full * q, at + full * q, first + full, count - full
            if count and 0 < left < q:
                runs.append((length, at, first, left, window - c))
                tree.put(c - left * length, first, 1)
                left, at, first, count = 0, at + left, first + 1, count - 1
            tree.put(c, first, count) if c < window else None
    return runs, opened


_WORKER: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)

        def encode(words: list[bytes]) -> list[bytes]:
            out = t.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
            return [np.array(e.ids, np.uint32).tobytes() for e in out]

        special = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        _WORKER[path] = t, WordCache(encode), special
    return _WORKER[path]


def _pieces(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache, special = _tokenizer(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            ids_col = batch.column("doc_id")
            for lo, hi, data, offsets in K.calls(batch.column("text")):
                ids, bounds = cache.batch(data, offsets)
                raw = data.tobytes()
                odd = any(s in raw for s in special)  # their strings are tokens of their own to the library
                cols: tuple[list, ...] = ([], [], [], [], [])
                for i in range(hi - lo):
                    own = ids[bounds[i] : bounds[i + 1]]
                    if odd and any(s in (t := raw[offsets[i] : offsets[i + 1]]) for s in special):
                        own = np.array(tokenizer.encode(t.decode("utf-8"), add_special_tokens=False).ids, np.uint32)
                    own = np.append(own, np.uint32(end_id))
                    for a in range(0, len(own), window):
                        for c, v in zip(cols, (lo + i, a, min(window, len(own) - a), zlib.crc32(own[a : a + window].tobytes()), len(own)), strict=True):
                            c.append(v)
                length = np.array(cols[2], np.int64)
                order = np.argsort(length, kind="stable")
                kinds, first, n = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(seen[kinds], n)
                seen[kinds] += n
                yield pa.RecordBatch.from_arrays(
                    [ids_col.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(np.full(len(length), part, np.int32)), pa.array(rank)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"],
                )

    return run


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece."""
    keep = Scratch(spark, "packing")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
    pieces = keep.keep(source.mapInArrow(_pieces(vocabulary, window, end_id), schema), "pieces")
    counts = keep.keep(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `window` rows
    full = histogram.pop(window, 0)
    runs, opened = best_fit_plan(histogram, window)
    runs = sorted([*runs, (window, 0, opened, 1, 0)] if full else runs)
    plan = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))  # a few runs per length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # `first` has a row for each length and input partition: it is never sent whole to a task
    placed = pieces.join(first.hint("merge"), ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank")).alias("at"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        wide = np.int64(1) << np.int64(44)
        keys = p[:, 0] * wide + p[:, 1] if len(p) else p[:, 0]
        for b in batches:
            length, at = b.column("length").to_numpy(), b.column("at").to_numpy()
            r = p[np.searchsorted(keys, length * wide + at, "right") - 1]
            k = at - r[:, 1]
            seq, off = r[:, 2] + k // r[:, 3], r[:, 4] + k % r[:, 3] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    import public_tokenizers

    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary or public_tokenizers.path(VOCABULARY))
