"""Exact Jaccard self-join of documents by word n-grams, as a blocked sparse product of their incidence matrix.

Rows of the matrix are the distinct shingle sets (copies of a set are one row), columns are shingles.  Columns come in
one global order: rare before frequent, by hash among equals.  Two sets of similarity t share one of the first
n - ceil(t n) + 1 columns of each, so only these entries are multiplied.  A survey of all texts finds the frequent
columns (any shingle that repeats among the sets of one slice counts); the most frequent ones, a bounded table, go to
the end of the order, which affects cost and never the result.

The product is taken by columns: a task takes the columns that it was dealt, a block at a time, and adds up how many
of them each pair of rows shares; pairs outside the size bound are never counted.  The tasks' counts are summed, and
pairs whose shared first columns are too few are discarded: what lies beyond can't make up for them.  What is left is
verified on the whole sets, each row's partner with the most shared columns first, the other pairs only if that didn't
connect them.  The sets of the rows concerned are read once.

A column of k > LARGE rows isn't expanded to k^2 pairs.  Its rows are paired with its first row; where they still lie
in several components after that, rows of all columns of like size are taken together, and picked rows (some eight of
a column, then all that lie outside its largest component) meet all others in blocks of bounded size.  This product is
over whole sets, so its counts decide; of its links a block emits only those that join components.  At the end every
pair of rows that could be a link either was verified or has both rows in one component, hence components are exact.

Shingles are 64-bit hashes of lower-cased words; sets are told apart by a 64-bit hash of their sorted shingles.

Defined cases: null and blank texts have an empty set and link with nothing (component: the document itself); texts of
fewer than n words have one shingle, the whole sequence; repeated rows give a row each; a null doc_id takes no part
and has a null component; an empty table gives no rows; further columns of the input are ignored.
"""


from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels as K
from .components import components
from .scratch import Scratch

WORDS = 5
PERCENT = 75
#: Shingles that one survey slice compares.
SLICE = 2_000_000
#: Frequent columns that are moved to the end of the order, and how often one must be seen for that.
FREQUENT, SEEN = 1 << 20, 3
#: Bits of the filter that tells which texts to read again: 16 a wanted row, up to 2^27 (16 MB).
FILTER_BITS = (16, 27)
#: Columns of more rows aren't expanded to all pairs.
LARGE = 128
#: Blocks of the product over whole sets: about so many rows and shingles.
BLOCK, ELEMENTS = 1024, 400_000
#: A large column is finished by pairing the rows outside its largest component with all others if they are so many at
#: most, or in the last round; before, some eight of its rows meet all others.
MINOR = 128
ROUNDS = 4
#: Pairs that a task holds before it adds them up, and bytes of sets in one record batch.
HELD, BATCH_BYTES = 1 << 20, 4 << 20


def set_hash(g: np.ndarray) -> int:
    return int(K.mix(np.array([K.mix(g * K.U(0xC2B2AE3D27D4EB4F)).sum(dtype=K.U) + K.U(len(g))], K.U)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, n: int, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch's rows, or of those in ``rows``."""
    text = batch.column("text")
    if rows is not None:
        text = text.take(pa.array(rows))
    for lo, _, data, offsets in K.calls(text):
        for i, g in enumerate(K.shingle_sets(data, offsets, n), lo):
            yield (i if rows is None else int(rows[i])), g


def _survey(n: int):
    """Each document's set size and hash, and shingles that several sets of a slice have."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("key", pa.int64()), ("seen", pa.int64())])

    def repeats(held: list[np.ndarray]) -> pa.RecordBatch:
        a = np.sort(np.concatenate(held)) if held else np.zeros(0, K.U)
        at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(a)))
        twice = count > 1
        key, seen = a[at[twice]].view(np.int64), count[twice]
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(key), pa.array(seen)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sigs: set[int] = set()
        total = 0
        for batch in batches:
            size, sig = [], []
            known = batch.column("doc_id").is_valid().to_pylist()
            for i, g in _sets(batch, n):
                size.append(len(g))
                s = set_hash(g) if len(g) and known[i] else None
                sig.append(s)
                if s is not None and s not in sigs:
                    sigs.add(s)
                    held.append(g)
                    total += len(g)
                    if total > SLICE:
                        yield repeats(held)
                        held, sigs, total = [], set(), 0
            none = pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sig, pa.int64()), none, none], schema=schema)
        yield repeats(held)

    return K.lean(run)


def prefix(g: np.ndarray, keys: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The first columns of a set in the global order; ``keys``: the frequent ones, ``place``: their order."""
    p = len(g) - -(-percent * len(g) // 100) + 1
    if not len(keys):
        return g[:p]
    at = np.searchsorted(keys, g)
    at[at == len(keys)] = 0
    late = keys[at] == g
    early = g[~late]
    if len(early) >= p:
        return early[:p]
    last = at[late]
    return np.concatenate((early, g[late][np.argsort(place[last], kind="stable")][: p - len(early)]))


def _entries(n: int, percent: int, frequent):
    schema = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, place = frequent.value
        done: set[int] = set()
        for batch in batches:
            known = batch.column("doc_id").is_valid().to_pylist()
            cols, sigs, sizes, size = [], [], [], []
            for i, g in _sets(batch, n):
                if not len(g) or not known[i] or (s := set_hash(g)) in done:
                    continue
                done.add(s)
                cols.append(prefix(g, keys, place, percent))
                sigs.append(s)
                sizes.append(len(g))
                size.append(len(cols[-1]))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols).view(np.int64)), pa.array(np.repeat(np.array(sigs, np.int64), size)), pa.array(np.repeat(np.array(sizes, np.int32), size))], schema=schema)

    return K.lean(run)


#: Rows of the product by columns: counts of a pair (a, b), a pair of a large column's first row, a large column's row.
COUNT, STAR, ROW = 0, 1, 2
_PRODUCT = "kind int, key long, a long, b long, na int, nb int, n int"


class PairCounts:
    """How many columns pairs of rows (a, b) share, of the pairs within the size bound."""

    def __init__(self, percent: int, kind: int):
        self.percent, self.kind, self.parts, self.held = percent, kind, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        near = 100 * np.minimum(na, nb).astype(np.int64) >= self.percent * np.maximum(na, nb).astype(np.int64)
        if near.any():
            self.parts.append((a[near], b[near], na[near], nb[near], np.ones(int(near.sum()), np.int32)))
            self.held += len(self.parts[-1][0])

    def full(self) -> bool:
        """Adds up what is held; true if it should be emitted."""
        if self.held > HELD:
            self._sum()
        return self.held > HELD // 2

    def _sum(self) -> None:
        if self.parts:
            a, b, na, nb, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            self.parts = [(a[at], b[at], na[by][at], nb[by][at], np.add.reduceat(n[by], at))]
            self.held = len(at)

    def take(self) -> Iterator[pa.RecordBatch]:
        self._sum()
        for a, b, na, nb, n in self.parts:
            yield _rows(self.kind, np.zeros(len(a), np.int64), a, b, na, nb, n)
        self.parts, self.held = [], 0


def _rows(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    cols = [np.full(len(a), kind, np.int32), key, a, b, na, nb, n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "key", "a", "b", "na", "nb", "n"])


def _columns(percent: int, large: int):
    """The product by columns, from entries sorted by (key, sig); a task holds a bounded part of a column at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, stars = PairCounts(percent, COUNT), PairCounts(percent, STAR)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        rest = none  # the rows so far of the last column
        wide: tuple | None = None  # (key, first row, its size, last row) of a large column that goes on

        def of_wide(k, s, n) -> pa.RecordBatch:
            stars.add(np.full(len(s), wide[1]), s, np.full(len(s), wide[2], np.int32), n)
            return _rows(ROW, k, s, s, n, n, np.zeros(len(s)))

        def expand(k, s, n, at, size) -> Iterator[pa.RecordBatch]:
            """All pairs of the columns that start at ``at`` and have at most ``large`` rows."""
            for m in np.unique(size[(size > 1) & (size <= large)]).tolist():
                x, y = np.triu_indices(m, 1)
                own = at[size == m]
                step = max(1, HELD // len(x))
                for lo in range(0, len(own), step):
                    i = own[lo : lo + step, None]
                    i, j = (i + x).ravel(), (i + y).ravel()
                    counts.add(s[i], s[j], n[i], n[j])
                    if counts.full():
                        yield from counts.take()

        for b in batches:
            k, s, n = (np.concatenate((r, b.column(c).to_numpy())) for r, c in zip(rest, ("key", "sig", "n"), strict=True))
            fresh = np.ones(len(k), bool)  # copies of a set that several tasks read are one row
            fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            if wide and len(k):
                fresh[0] = (k[0], s[0]) != (wide[0], wide[3])
            k, s, n = k[fresh], s[fresh], n[fresh]
            if wide:
                end = int(np.searchsorted(k, wide[0], "right"))
                if end:
                    yield of_wide(k[:end], s[:end], n[:end])
                    wide = (*wide[:3], s[end - 1])
                    k, s, n = k[end:], s[end:], n[end:]
                if len(k):
                    wide = None
            rest = none
            if not len(k):
                continue
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(at, len(k)))
            for i in at[size > large].tolist():
                wide = (k[i], s[i], n[i], 0)
                end = int(np.searchsorted(k, k[i], "right"))
                yield _rows(ROW, k[i : i + 1], s[i : i + 1], s[i : i + 1], n[i : i + 1], n[i : i + 1], np.zeros(1))
                yield of_wide(k[i + 1 : end], s[i + 1 : end], n[i + 1 : end])
                wide = (*wide[:3], s[end - 1]) if end == len(k) else None
            if not wide:
                rest = k[at[-1] :], s[at[-1] :], n[at[-1] :]
                at, size = at[:-1], size[:-1]
            yield from expand(k, s, n, at, size)
            if stars.full():
                yield from stars.take()
        k, s, n = rest
        yield from expand(k, s, n, np.zeros(1, np.int64), np.array([len(k)]))
        yield from counts.take()
        yield from stars.take()

    return K.lean(run)


def _spot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(ids.view(K.U)) >> K.U(64 - bits)).astype(np.int64)


def _filter_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            seen[_spot(b.column("doc_id").to_numpy(), bits)] = True
        words = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        for lo in range(0, len(at), HELD):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + HELD]), pa.array(words[at[lo : lo + HELD]])], names=["at", "word"])

    return K.lean(run)


def _fetch(n: int, wanted, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value.view(np.uint8)
        for batch in batches:
            ids = batch.column("doc_id")
            spot = _spot(ids.fill_null(0).to_numpy(), bits)
            rows = np.flatnonzero((words[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
            out, held = [], 0
            for i, g in _sets(batch, n, rows):
                if len(g):
                    out.append((ids[i].as_py(), set_hash(g), g.tobytes()))
                    held += 8 * len(g)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return K.lean(run)


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("ga"), b.column("gb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), K.U), np.frombuffer(y.as_buffer(), K.U)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return K.lean(run)


def _parts(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sig, component, shingles one after another and their bounds, of a block of rows (sig, c, grams)."""
    sets = [np.frombuffer(g.as_buffer(), K.U) for g in rows.field("grams")]
    return rows.field("sig").to_numpy(), rows.field("c").to_numpy().copy(), np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def _block_product(percent: int):
    """Of blocks (x, y) of rows (sig, c, grams): links (a, b, ca, cb) between components, one for each that they join.

    The product of the two incidence blocks is taken a row of x at a time: the postings of its columns in the other
    block are added up, and what lies below the size-derived bounds is never a pair.
    """

    def links(xs, ys) -> Iterator[tuple[int, int, int, int]]:
        xsig, xc, xkeys, xoff = _parts(xs)
        ysig, yc, ykeys, yoff = _parts(ys)
        n = np.diff(yoff)
        by = np.argsort(ykeys, kind="stable")
        key, owner = ykeys[by], np.repeat(np.arange(len(ysig)), n)[by]
        first_x, first_y = xc.copy(), yc.copy()
        for i in range(len(xsig)):
            own = xkeys[xoff[i] : xoff[i + 1]]
            lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
            count = hi - lo
            upto = np.cumsum(count)
            shared = np.bincount(owner[np.repeat(lo - (upto - count), count) + np.arange(upto[-1])], minlength=len(ysig))
            small, big = np.minimum(n, len(own)), np.maximum(n, len(own))
            hit = (100 * small >= percent * big) & (100 * shared >= percent * (n + len(own) - shared)) & (yc != xc[i])
            while hit.any():
                j = int(np.argmax(hit))
                yield int(xsig[i]), int(ysig[j]), int(first_x[i]), int(first_y[j])
                joined, into = yc[j], xc[i]
                yc[yc == joined] = into
                xc[xc == joined] = into
                hit &= yc != into

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for xs, ys in zip(b.column("x"), b.column("y"), strict=True):
                if found := list(links(xs.values, ys.values)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "ca", "cb"])

    return K.lean(run)


@dataclass
class Joined:
    """documents: doc_id, n_shingles, set_id, component_id, group_id, first.  links: verified pairs that connect sets.

    group_id tells components apart where ids repeat; first: the row has the smallest id of its group, and of the sets
    with that id the one with the smallest set_id (rows without a set or an id are all first).
    """

    documents: DataFrame
    links: DataFrame


def _jumped(up: DataFrame, times: int) -> DataFrame:
    """Follow (node, component) pointers, 2^times steps in all."""
    for _ in range(times):
        up = up.join(up.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return up


def _relabel(df: DataFrame, label: DataFrame, column: str, as_: str) -> DataFrame:
    """Add the label of a set; a set without links is its own."""
    known = label.select(F.col("node").alias(column), F.col("component").alias("__c"))
    return df.join(known, column, "left").withColumn(as_, F.coalesce("__c", column)).drop("__c")


def _moved(label: DataFrame, ends: DataFrame, up: DataFrame) -> DataFrame:
    """``label`` with the ends (a, b, ca, cb) of further links, and components replaced as ``up`` says."""
    nodes = label.union(ends.select(F.col("a").alias("node"), F.col("ca").alias("component"))).union(ends.select("b", "cb")).distinct()
    top = up.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return nodes.join(top, "component", "left").select("node", F.coalesce("next", "component").alias("component"))


def _sets_of(docs: DataFrame, need: DataFrame, n: int, keep: Scratch) -> DataFrame:
    """(sig, grams) of the rows (doc_id, sig) in ``need``, from one pass over the texts."""
    spark = keep.spark
    bits = min(max(FILTER_BITS[0], (16 * need.count()).bit_length()), FILTER_BITS[1])
    words = need.mapInArrow(_filter_words(bits), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    of = np.zeros((1 << bits) // 64, np.int64)
    of[words.column("at").to_numpy()] = words.column("word").to_numpy()
    wanted = spark.sparkContext.broadcast(of)
    sets = docs.mapInArrow(_fetch(n, wanted, bits), "doc_id long, sig long, grams binary").join(need, ["doc_id", "sig"]).select("sig", "grams")
    sets = keep.keep(sets, "sets")
    wanted.destroy()
    return sets


def ngram_join(spark: SparkSession, docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> Joined:
    """Components of the documents whose n-gram sets have a Jaccard similarity of at least ``percent`` / 100."""
    keep = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = keep.keep(docs.mapInArrow(_survey(n), "doc_id long, n long, sig long, key long, seen long"), "survey")
    top = survey.where("key IS NOT NULL").groupBy("key").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= SEEN).orderBy(F.desc("seen"), "key").limit(FREQUENT).toArrow()
    meta = survey.where("n IS NOT NULL").select("doc_id", "n", "sig")
    classes = keep.keep(meta.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep")), "classes")

    keys = top.column("key").to_numpy().view(K.U)
    order = np.argsort(keys)
    place = (len(keys) - 1 - np.arange(len(keys)))[order].astype(np.int32)  # the most frequent last
    frequent = spark.sparkContext.broadcast((keys[order], place))  # at most FREQUENT numbers
    entries = docs.mapInArrow(_entries(n, percent, frequent), "key long, sig long, n int")
    product = keep.keep(entries.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(_columns(percent, LARGE), _PRODUCT), "product")
    frequent.destroy()
    keep.release()

    # the tasks' counts summed, against the size-derived bound; large columns of both rows may be shared uncounted
    large = product.where(F.col("kind") == ROW).select("key", F.col("a").alias("sig"), F.col("na").alias("n"))
    uncounted = large.groupBy("sig").agg(F.count(F.lit(1)).alias("u"))
    ua, ub = (uncounted.select(F.col("sig").alias(x), F.col("u").alias(f"u{x}")) for x in "ab")
    pairs = product.where(F.col("kind") <= STAR).groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("common"))
    needed = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    beyond = F.expr(f"({percent} * greatest(na, nb) + 99) div 100 - 1")
    reach = F.col("common") + F.least(F.coalesce("ua", F.lit(0)), F.coalesce("ub", F.lit(0)))
    pairs = pairs.where(F.col("common") >= needed - beyond).unionByName(pairs.where(F.col("common") < needed - beyond).join(ua, "a").join(ub, "b").where(reach >= needed - beyond).drop("ua", "ub"))
    pairs = keep.keep(pairs.select("a", "b", "common"), "pairs")
    rows = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(large.select("sig")).distinct()
    need = keep.keep(classes.join(rows, "sig").select(F.col("rep").alias("doc_id"), "sig"), "need")
    sets = _sets_of(docs, need, n, keep)

    def verified(of: DataFrame, tag: str) -> DataFrame:
        """Those of the distinct pairs (a, b) that are links."""
        ga, gb = (sets.select(F.col("sig").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
        return keep.keep(of.select("a", "b").join(gb, "b").join(ga, "a").mapInArrow(_linked(percent), "a long, b long"), tag)

    # labels say which rows are known to be connected: equal labels are, different ones may be.  They save pairs only;
    # the components come from all links at the end.  First each row with the smaller one that it shares most with.
    best = pairs.groupBy("b").agg(F.max(F.struct("common", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = [verified(best, "links-best")]
    label = keep.keep(_jumped(links[0].select(F.col("b").alias("node"), F.col("a").alias("component")), 2), "label-best")
    rest = _relabel(_relabel(pairs.join(best, ["a", "b"], "left_anti"), label, "a", "ca"), label, "b", "cb").where("ca <> cb")
    links.append(verified(rest, "links-rest"))

    def settled(tag: str) -> DataFrame:
        """The components of all links so far: labels, joined by the links between them."""
        ends = functools.reduce(DataFrame.union, links)
        ends = keep.keep(_relabel(_relabel(ends, label, "a", "ca"), label, "b", "cb").select("a", "b", "ca", "cb"), f"ends-{tag}")
        across = components(ends.where("ca <> cb").select("ca", "cb"), keep, f"star-{tag}")
        out = keep.keep(_moved(label, ends, across), f"label-{tag}")
        keep.drop(f"ends-{tag}")
        return out

    label = settled("small")
    turn, open_ = 0, large
    while turn < ROUNDS:
        rows = _relabel(open_, label, "sig", "c")
        each = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("key")
        of_key = each.agg(F.sum("k").alias("rows"), F.max(F.struct("k", "c")).alias("most"), F.count(F.lit(1)).alias("several")).where("several > 1")
        rows = rows.join(of_key.select("key", "rows", F.col("most.c").alias("main"), (F.col("rows") - F.col("most.k")).alias("minor")), "key")
        # nested choices: columns of like size choose the same rows
        rows = rows.withColumn("scale", F.greatest(F.lit(0), F.floor(F.log2(F.col("rows") / 8))).cast("int"))
        chosen = F.pmod(F.xxhash64("sig", F.lit(turn)), F.expr("shiftleft(1L, scale)")) == 0
        finish = F.lit(turn == ROUNDS - 1) | (F.col("minor") <= MINOR)
        rows = keep.keep(rows.select("key", "sig", "n", "c", "main", "scale", finish.alias("finish"), chosen.alias("first")), f"open-{turn}")
        if rows.isEmpty():
            break
        # once for all columns of like size with the same largest component, in blocks
        of = ["scale", "main", "finish"]
        pick = F.when(F.col("finish"), F.col("c") != F.col("main")).otherwise(F.col("first"))
        many = rows.groupBy(*of, "sig", "c", "n").agg(F.max(pick).alias("pick"))
        sizes = many.groupBy(*of).agg(F.expr(f"greatest(count(*) div {BLOCK}, sum(n) div {ELEMENTS}) + 1").alias("blocks"))
        many = many.join(sizes, of).withColumn("block", F.pmod(F.xxhash64("sig"), "blocks")).join(sets, "sig")
        group = F.collect_list(F.struct("sig", "c", "grams"))  # a block is of bounded size
        x, y = many.where("pick").groupBy(*of, "block").agg(group.alias("x")).drop("block"), many.groupBy(*of, "block").agg(group.alias("y")).drop("block")
        found = keep.keep(x.join(y, of).select("x", "y").mapInArrow(_block_product(percent), "a long, b long, ca long, cb long"), f"found-{turn}")
        up = found.groupBy(F.greatest("ca", "cb").alias("node")).agg(F.min(F.least("ca", "cb")).alias("component"))
        label = keep.keep(_moved(label, found, keep.keep(_jumped(up, 3), f"up-{turn}")), f"label-{turn}")
        links.append(found.select("a", "b"))
        open_ = rows.where("NOT finish AND NOT first").select("key", "sig", "n")
        turn += 1
    if turn:
        label = settled("all")
    keep.drop("product", "pairs", "need", "sets", *(f"open-{k}" for k in range(turn + 1)))

    least = label.join(classes.select(F.col("sig").alias("node"), "rep"), "node")
    heads = least.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("head"))
    least = least.join(heads, "component").select(F.col("node").alias("sig"), "component", "head")
    found = classes.join(least, "sig", "left").select("sig", F.coalesce("head.rep", "rep").alias("component_id"), F.coalesce("component", "sig").alias("group_id"), (F.coalesce("head.node", "sig") == F.col("sig")).alias("head"))
    found = keep.keep(found, "found")
    first = F.coalesce(F.col("head") & (F.col("doc_id") == F.col("component_id")), F.lit(True))
    documents = meta.join(found, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("sig").alias("set_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "group_id", first.alias("first"))
    a, b = (classes.select(F.col("sig").alias(x), F.col("rep").alias(f"doc_{x}")) for x in "ab")
    return Joined(documents, functools.reduce(DataFrame.union, links).join(a, "a").join(b, "b").select("doc_a", "doc_b").distinct())


def set_ids(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """``docs`` with a column ``set_id``: the same id as in ``Joined.documents``, null without words."""
    schema = StructType([*docs.schema, StructField("set_id", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [set_hash(g) if len(g) else None for _, g in _sets(b, n)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], names=[*b.schema.names, "set_id"])

    return docs.mapInArrow(K.lean(run), schema)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return ngram_join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).documents.select("doc_id", "n_shingles", "component_id")
