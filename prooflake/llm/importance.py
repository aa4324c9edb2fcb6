"""Importance resampling towards a target distribution: scores by array, draw by merged sorted runs.

Features are hashed into ``BUCKETS`` counts of the documents and of the target; a bucket's gain is the scaled logarithm of
their smoothed ratio, and a document's weight the sum of its features' gains: one look-up in an array of fixed size for each
feature.  A Gumbel value that depends on the seed and the id alone is added, so the highest scores are a draw without
replacement in proportion to the weights.

The draw is exact and ordered.  Every partition sorts its eligible rows into runs of at most ``RUN_ROWS``, which are cut at
common splitters and written to shared storage as blocks of (range, run).  The counts by range say where each range's
ranks begin and which range holds the last draw; later ranges are never read again.  Each range left is
merged from its runs by a tournament tree that hands out ranks and stops at the draw's end.  Splitters come from a
sample and are whole keys (score, id, row), so they cut ties too; they matter for balance only.  The driver holds one
splitter and one count for ``RANGE_ROWS`` eligible rows.

Defined cases: a null text has no words; words are counted as often as they occur; repeated rows count in the corpus and
are drawn as rows of their own, equal scores and ids in any order; a null id is hashed as an empty one and comes after
others of its score; documents without words or below the least number of words have no rank; without a target text
all target counts are 0; an empty table gives no rows; further columns of the input are ignored; whole texts are read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

#: Fixed by the contract.
BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Rows of a run, rows of a merge range, and sampled keys for each range.
RUN_ROWS, RANGE_ROWS, SAMPLE = 1 << 18, 250_000, 10
#: Bytes of a word that are hashed for all words at once; the rest of a longer one follows alone.
COLUMNS = 48
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NO_ID = np.iinfo(np.int64).max


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


CRC = _crc_table()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the first word of each row (one more at the end)."""
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left = np.concatenate(([False], inside[:-1])) if len(data) else inside
    right = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~left | edge[:-1]))
    ends = np.flatnonzero(inside & (~right | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def crc_over(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each slice: byte by byte, all slices at once."""
    size = ends - starts
    by = np.argsort(-size, kind="stable")
    st, at, falling = state[by], starts[by], -size[by]
    for j in range(min(COLUMNS, int(size.max(initial=0)))):
        m = int(np.searchsorted(falling, -j))  # slices longer than j
        st[:m] = CRC[(st[:m] ^ data[at[:m] + j]) & 0xFF] ^ (st[:m] >> np.uint32(8))
    for i in range(int(np.searchsorted(falling, -COLUMNS))):
        rest = data[at[i] + COLUMNS : at[i] - falling[i]].tobytes()
        st[i] = zlib.crc32(rest, int(st[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(st)
    out[by] = st
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, each one's row, and the words of each row."""
    starts, ends, bounds = words(data, offsets)
    lower, n_words = K.LOWER[data], np.diff(bounds)
    row = np.repeat(np.arange(len(n_words)), n_words)
    last = np.repeat(bounds[1:], n_words) - np.arange(len(starts))  # words from here to the row's end
    state = crc_over(np.full(len(starts), 0xFFFFFFFF, np.uint32), lower, starts, ends)
    found, rows = [state ^ np.uint32(0xFFFFFFFF)], [row]
    here = np.arange(len(starts))
    for k in range(1, longest):
        going = last[here] > k
        here, state = here[going], state[going]
        state = CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
        state = crc_over(state, lower, starts[here + k], ends[here + k])
        found.append(state ^ np.uint32(0xFFFFFFFF))
        rows.append(row[here])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(rows), n_words


def counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features in each bucket over all texts: ``buckets`` numbers a task, added up by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offsets in K.calls(b.column("text")):
                held += np.bincount(features(data, offsets, buckets, longest)[0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = texts.select("text").mapInArrow(K.lean(part), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to source, by bucket."""
    b = float(len(source))
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def gumbel(ids: list[int | None], seed: int) -> np.ndarray:
    h = np.array([int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) for i in ids], np.float64)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, hi, data, offsets in K.calls(b.column("text")):
                bucket, row, n_words[lo:hi] = features(data, offsets, len(gain), longest)
                n_features[lo:hi] = np.bincount(row, minlength=hi - lo)
                np.add.at(weight[lo:hi], row, gain[bucket])
            score = weight + gumbel(b.column("doc_id").to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n_words, n_features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.lean(part), "doc_id long, n_words long, n_features long, weight long, score long")


# ---- the draw

Key = tuple[int, int, int]  # falling score, id, row


class Tournament:
    """Loser tree over sorted runs of keys: each node keeps the loser of its match, the winner goes on."""

    def __init__(self, runs: list[list[Key]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        winners = [-1] * self.size + [k if k < len(runs) else -1 for k in range(self.size)]
        self.losers = [-1] * self.size
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1]

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a >= 0
        x, y = self.at[a], self.at[b]
        if x == len(self.runs[a]) or y == len(self.runs[b]):
            return x < len(self.runs[a])
        return self.runs[a][x] <= self.runs[b][y]

    def __iter__(self) -> Iterator[Key]:
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (self.size + w) // 2
            while node:  # only the matches on the way to the root are played again
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _cuts(keys: tuple[np.ndarray, np.ndarray, np.ndarray], splitters: list[Key]) -> list[int]:
    """Places of the splitters in a sorted run: one bisection by each part of the key."""
    out = []
    for key in splitters:
        lo, hi = 0, len(keys[0])
        for part, x in zip(keys, key, strict=True):
            lo, hi = lo + int(np.searchsorted(part[lo:hi], x, "left")), lo + int(np.searchsorted(part[lo:hi], x, "right"))
        out.append(lo)
    return out


def sorted_runs(eligible: DataFrame, splitters: list[Key], run_rows: int = RUN_ROWS) -> DataFrame:
    """(range, n, keys): the part of a sorted run that lies in a range, as three rows of long integers."""

    def blocks(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held, axis=1)
        keys = keys[:, np.lexsort(keys[::-1])]
        edges = [0, *_cuts((keys[0], keys[1], keys[2]), splitters), keys.shape[1]]
        some = [k for k in range(len(edges) - 1) if edges[k] < edges[k + 1]]
        parts = [np.ascontiguousarray(keys[:, edges[k] : edges[k + 1]]) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([p.shape[1] for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["range", "n", "keys"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            held.append(np.stack((-b.column("score").to_numpy(), ids, b.column("row").to_numpy())))
            n += b.num_rows
            if n >= run_rows:
                yield from blocks(held)
                held, n = [], 0
        if n:
            yield from blocks(held)

    return eligible.select("score", "doc_id", "row").mapInArrow(part, "range int, n long, keys binary")


def ranked(spark: SparkSession, eligible: DataFrame, draw: int, total: int, keep: Scratch, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(row, rank) of the ``draw`` first of ``total`` rows (score, doc_id, row) by falling score, then id."""
    ranges = -(-total // range_rows)
    splitters: list[Key] = []
    if ranges > 1:
        picked = eligible.sample(min(1.0, SAMPLE * ranges / total), seed=SEED).select("score", "doc_id", "row").collect()
        picked = sorted((-r.score, NO_ID if r.doc_id is None else r.doc_id, r.row) for r in picked)
        splitters = sorted({picked[len(picked) * k // ranges] for k in range(1, ranges)} if picked else ())
    runs = keep.keep(sorted_runs(eligible, splitters, run_rows), "runs")
    size = {r.range: r.n for r in runs.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row a range
    begin, before = {}, 0
    for k in sorted(size):
        begin[k] = before
        before += size[k]
    last = max((k for k, b in begin.items() if b < draw), default=-1)
    first = [begin[k] for k in sorted(begin) if k <= last]
    number = [k for k in sorted(begin) if k <= last]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        start = first[bisect.bisect_left(number, int(group["range"].iloc[0]))]
        lists = [list(zip(*np.frombuffer(x, np.int64).reshape(3, -1).tolist(), strict=True)) for x in group["keys"]]
        rows = [key[2] for _, key in zip(range(draw - start), Tournament(lists), strict=False)]
        return pd.DataFrame({"row": np.array(rows, np.int64), "rank": start + 1 + np.arange(len(rows), dtype=np.int64)})

    return runs.where(F.col("range") <= last).groupBy("range").applyInPandas(merge, "row long, rank long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those that aren't drawn."""
    keep = Scratch(spark, "importance")
    gain = gains(counts(docs, buckets, longest), counts(target, buckets, longest))
    rows = keep.keep(scored(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = rows.where(F.col("n_words") >= least_words)
    total = eligible.count()
    draw = percent * total // 100
    if not draw:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    ranks = keep.keep(ranked(spark, eligible, draw, total, keep, run_rows, range_rows), "ranks")
    return rows.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    return resample(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
