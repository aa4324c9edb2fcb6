"""Quality rules with a character n-gram language model.

Base counts (words, symbols, repeated lines, words in repeated three-word windows) come from each whole text.  The
model is modified Kneser-Ney over 4-grams of characters, one per language, counted by Spark over all documents, those
that fail the base rules too: workers add up the n-grams of their texts, one aggregation joins these sums, and continuation counts, discounts and
interpolated probabilities are relational steps over the n-gram table.  Characters are UTF-16 units, so that four of
them are 64 bits without a collision: a character beyond U+FFFF is two.  For scoring, Spark sorts the n-grams into arrays
in files of the shared folder (``pages``), which tasks search by bisection: neither the driver nor a worker holds them all.
A document is rejected if a base rule fails or its log-perplexity lies outside its language's band: the quartiles of
all documents of the language that pass the base rules, widened by multiples of their distance.

Defined cases: null and blank texts have no words and fail the base rules; a null language is a language of its own;
languages with fewer than ``BAND_MIN`` passing documents share one band; repeated rows count as often as they occur; an
empty table gives no rows; further columns of the input are ignored by the query and kept by the filter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .pages import Pages, store
from .scratch import Scratch

ORDER = 4
MIN_WORDS = 50
#: Base rule: more than half of the words in repeated windows.
REPEAT_PERCENT = 50
#: Not a rule of the operator: tests pick texts with so many symbols per 100 characters at most.
SYMBOL_PERCENT = 1
#: The band reaches so many quartile distances beyond the quartiles; languages with fewer documents share one band.
BAND_REACH, BAND_MIN = 4.0, 20
#: Up to so many languages, what is kept of each is sent to all tasks.
FEW_LANGUAGES = 10_000
BIN = 0.005
#: n-grams of more than one character that occur so often at most are left to the lower order: a text's own oddities
#: must not make it probable.
PRUNE = 2
BOS = 0xFFFF
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
NO_LANG = "\x00"


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends, bounds = K.words(data, offsets)
    rows = np.arange(len(offsets) - 1)
    out = {"n_words": np.diff(bounds)}
    out["word_chars"] = _per_row(((data & 0xC0) != 0x80) & ~K.SPACE[data], offsets)
    out["n_symbols"] = _per_row(SYMBOL[data], offsets)
    # lines
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:][data == 10] = True
    first = np.flatnonzero(cut[: len(data)])
    last = np.append(first[1:], len(data))
    has = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[has], last[has]
    last = last - (data[last - 1] == 10)
    row = np.searchsorted(offsets, first, "right") - 1
    line = K.mix(K.slice_hash(data, first, last) + row.astype(K.U) * K.U(0x9E3779B97F4A7C15))
    again = pd.Series(line).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(row[again], minlength=len(rows)).astype(np.int64)
    # repeated windows of three words
    of = np.repeat(rows, out["n_words"])
    cover = np.zeros(len(starts) + 2, bool)
    if len(starts) >= 3:
        g = K.gram_hash(K.slice_hash(data, starts, ends), 3)
        g = K.mix(g + of[:-2].astype(K.U) * K.U(0x9E3779B97F4A7C15))
        at = np.flatnonzero(of[:-2] == of[2:])
        code, _ = pd.factorize(g[at])
        twice = at[np.bincount(code)[code] > 1] if len(at) else at
        for k in range(3):
            cover[twice + k] = True
    out["n_repeat_words"] = _per_row(cover[: len(starts)], bounds)
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each UTF-16 unit, packed in 64 bits, and each row's bounds among them."""
    width = ((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0)
    text = K.LOWER[data].tobytes().decode("utf-8", "replace")
    if "\uffff" in text:  # the unit that stands before a text's first one: here two units that no other character has
        at = np.flatnonzero((data[:-2] == 0xEF) & (data[1:-1] == 0xBF) & (data[2:] == 0xBF))
        width[at] += 1
        text = text.replace("\uffff", "\udfff\udfff")
    unit = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(K.U)
    bounds = np.concatenate(([0], np.cumsum(width)))[offsets]
    place = np.arange(len(unit)) - np.repeat(bounds[:-1], np.diff(bounds))
    key = unit.copy()
    for k in range(1, ORDER):
        before = np.full(len(unit), BOS, K.U)
        before[k:] = unit[: len(unit) - k]
        before[place < k] = BOS
        key |= before << K.U(16 * k)
    return key.view(np.int64), bounds


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    lang = pd.Series(batch.column("lang").to_pandas()).fillna(NO_LANG)
    for name, rows in lang.groupby(lang, sort=True).indices.items():
        yield name, np.sort(rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pd.Series]] = {}
    size = 0

    def added(parts: list[pd.Series]) -> pd.Series:
        s = pd.concat(parts)
        return s.groupby(level=0).sum() if len(parts) > 1 else s

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            s = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s.index.to_numpy(np.int64)), pa.array(s.to_numpy(np.int64))], names=["lang", "key", "n"])

    for batch in batches:
        for lang, rows in _languages(batch):
            for _, _, data, offsets in K.calls(batch.column("text").take(pa.array(rows))):
                key, _ = grams(data, offsets)
                code, uniq = pd.factorize(key)
                if len(uniq):
                    held.setdefault(lang, []).append(pd.Series(np.bincount(code), index=uniq))
                    size += len(uniq)
            if size > 1_500_000:
                held = {k: [added(v)] for k, v in held.items()}
                size = sum(len(v[0]) for v in held.values())
                if size > 1_000_000:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def _discounted(level: DataFrame, few: bool) -> DataFrame:
    """(lang, key, n, ctx, left, total, gamma) of one order's counts: discounted count, context total, mass left over.

    ``few``: there are at most FEW_LANGUAGES.
    """
    n = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.expr("n1 / (n1 + 2 * n2)")
    d = [F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.lit(float(k)) - F.lit(k + 1.0) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))) for k in (1, 2, 3)]
    discounts = level.groupBy("lang").agg(*n).select("lang", *[F.greatest(F.lit(0.1), F.least(F.coalesce(x, F.lit(0.7)), F.lit(k - 0.1))).alias(f"d{k}") for k, x in enumerate(d, 1)])
    own = level.withColumn("ctx", F.shiftrightunsigned("key", 16)).join(F.broadcast(discounts) if few else discounts, "lang")
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    w = Window.partitionBy("lang", "ctx")
    own = own.select("lang", "key", "ctx", "n", (F.col("c") - cut).alias("left"), F.sum("c").over(w).alias("total"), F.sum(cut).over(w).alias("cuts"))
    return own.withColumn("gamma", F.col("cuts") / F.col("total"))


def kneser_ney(counts: DataFrame, keep: Scratch) -> list[DataFrame]:
    """Tables (lang, key, n, ctx, p, q) of orders 1 to 4 from (lang, key, c) of order 4.

    n: occurrences; c: occurrences, or below the highest order the number of characters seen before the n-gram; p: the
    interpolated probability; q: that of the next lower order.
    """
    levels = [counts.withColumn("n", F.col("c"))]
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << (16 * k)) - 1
        levels.insert(0, keep.keep(levels[0].groupBy("lang", F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")), f"counts{k}"))
    done: list[DataFrame] = []
    few = levels[0].select("lang").distinct().count() <= FEW_LANGUAGES
    for k, level in enumerate(levels, 1):
        own = _discounted(level, few)
        if k == 1:  # the lowest order is mixed with the uniform distribution over the characters seen and one more
            own = own.withColumn("q", 1 / (F.count(F.lit(1)).over(Window.partitionBy("lang")) + 1))
        else:
            suffix = F.col("key").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1))
            own = own.withColumn("suffix", suffix).join(done[-1].select("lang", F.col("key").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
        p = F.col("left") / F.col("total") + F.col("gamma") * F.col("q")
        done.append(keep.keep(own.select("lang", "key", "n", "ctx", p.alias("p"), "q"), f"order{k}"))
    return done


#: Parts of the pages: log p of the n-grams of order k is part k, log gamma of the contexts of order k part GAMMA + k.
GAMMA = 10


class Model:
    """Per language and order sorted n-grams with log p, and per order above 1 sorted contexts with log gamma."""

    def __init__(self, pages: Pages):
        self.pages = pages

    def log_p(self, key: np.ndarray, lang: str) -> np.ndarray:
        """log p of the last character of each 4-gram, backing off where the model doesn't hold an n-gram."""
        out, todo = np.zeros(len(key)), np.arange(len(key))
        for order in range(ORDER, 0, -1):
            own = key[todo] & np.int64(-1 if order == ORDER else (1 << 16 * order) - 1)
            hit, v = self.pages.find(lang, order, own)
            out[todo[hit]] += v[hit]
            todo = todo[~hit]
            if not len(todo):
                return out
            if order > 1:
                ctx = (own[~hit].view(K.U) >> K.U(16)).view(np.int64)
                out[todo] += self.pages.find(lang, GAMMA + order, ctx)[1]
        out[todo] += np.log(1 / 0x110000)
        return out

    def log_perplexity(self, data: np.ndarray, offsets: np.ndarray, lang: str) -> np.ndarray:
        key, bounds = grams(data, offsets)
        code, uniq = pd.factorize(key)  # each distinct n-gram is searched once
        total = np.concatenate(([0.0], np.cumsum(self.log_p(uniq, lang)[code]))) if len(key) else np.zeros(1)
        n = np.diff(bounds)
        return np.where(n > 0, -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1), 0.0)


def train(docs: DataFrame, keep: Scratch) -> Model:
    """The model of all documents."""
    counted = docs.select("lang", "text").mapInArrow(_count, "lang string, key long, n long")
    counts = keep.keep(counted.groupBy("lang", "key").agg(F.sum("n").alias("c")), "counts4")
    tables = kneser_ney(counts, keep)
    often = [t if k == 1 else t.where(F.col("n") > PRUNE) for k, t in enumerate(tables, 1)]
    entries = [t.select("lang", F.lit(k).alias("part"), "key", F.log("p").cast("float").alias("v")) for k, t in enumerate(often, 1)]
    # what the n-grams that stay leave to the lower order, over what that order gives the others
    for k, t in enumerate(often[1:], 2):
        gamma = F.greatest(1 - F.sum("p"), F.lit(1e-6)) / F.greatest(1 - F.sum("q"), F.lit(1e-6))
        entries.append(t.groupBy("lang", F.col("ctx").alias("key")).agg(F.log(gamma).cast("float").alias("v")).select("lang", F.lit(GAMMA + k).alias("part"), "key", "v"))
    pages = store(keep.keep(functools.reduce(DataFrame.union, entries), "entries"), keep.path("pages"))
    keep.drop("entries", "counts4", *(f"counts{k}" for k in range(1, ORDER)), *(f"order{k}" for k in range(1, ORDER + 1)))
    return Model(pages)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(batch: pa.RecordBatch, model: Model) -> dict[str, np.ndarray]:
    """Base counts and log-perplexity of a batch's rows."""
    out = {k: np.zeros(batch.num_rows, np.int64) for k in COUNTS} | {"log_ppl": np.zeros(batch.num_rows)}
    for lang, rows in _languages(batch):
        for lo, hi, data, offsets in K.calls(batch.column("text").take(pa.array(rows))):
            at = rows[lo:hi]
            for k, v in base_counts(data, offsets).items():
                out[k][at] = v
            out["log_ppl"][at] = model.log_perplexity(data, offsets, lang)
    return out


def _measured(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _measure(b, model.value)
            lang = b.column("lang").fill_null(NO_LANG)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lang, *(pa.array(m[k]) for k in COUNTS), pa.array(m["log_ppl"]), pa.array(base_failed(m))], names=["doc_id", "lang", *COUNTS, "log_ppl", "base_failed"])

    return run


_MEASURED = "doc_id long, lang string, " + ", ".join(f"{k} long" for k in COUNTS) + ", log_ppl double, base_failed boolean"


def bands(measured: DataFrame) -> DataFrame:
    """(lang, lo, hi): log-perplexity band of each language, from a histogram of all documents that pass the base rules.

    Languages with fewer than BAND_MIN such documents share the row with a null lang: their quartiles together, shrunk
    towards those of all documents.
    """
    bins = measured.where("NOT base_failed").groupBy("lang", F.floor(F.col("log_ppl") / F.lit(BIN)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    large = F.sum("n").over(Window.partitionBy("lang")) >= BAND_MIN
    own = F.struct(F.when(large, F.lit("own")).otherwise(F.lit("small")).alias("kind"), F.when(large, F.col("lang")).alias("lang"))
    every = F.struct(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("lang"))
    bins = bins.select("bin", "n", own.alias("own")).select("bin", "n", F.explode(F.array("own", every)).alias("of")).groupBy("of", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("of")
    bins = bins.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))

    def quantile(q: float, edge: int):
        return F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), (F.col("bin") + edge) * BIN))

    # outer edges of the quartiles' bins: documents that all measure the same lie inside
    q = bins.groupBy("of").agg(quantile(0.25, 0).alias("q1"), quantile(0.75, 1).alias("q3"), F.first("all").alias("n")).select("of.kind", "of.lang", "q1", "q3", "n")
    pooled = q.where("kind = 'all'").select(F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    share = F.when(F.col("kind") == "small", F.col("n") / (F.col("n") + BAND_MIN)).otherwise(F.lit(1.0))
    q = q.where("kind <> 'all'").crossJoin(F.broadcast(pooled)).select("lang", *((share * F.col(x) + (1 - share) * F.col(y)).alias(x) for x, y in (("q1", "a1"), ("q3", "a3"))))
    wide = F.lit(BAND_REACH) * (F.col("q3") - F.col("q1"))
    return q.select("lang", (F.col("q1") - wide).alias("lo"), (F.col("q3") + wide).alias("hi"))


class Quality:
    """A trained model with its bands, and what all documents measure."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.keep = Scratch(spark, "quality")
        self.model = spark.sparkContext.broadcast(train(docs, self.keep))  # the pages' index: a row for 65,536 n-grams
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
        self.measured = self.keep.keep(source.mapInArrow(_measured(self.model), _MEASURED), "measured")
        self.bands = self.keep.keep(bands(self.measured), "bands")

    def verdicts(self) -> DataFrame:
        small = self.bands.where("lang IS NULL").select(F.col("lo").alias("small_lo"), F.col("hi").alias("small_hi"))  # one row at most
        inside = F.coalesce(F.col("log_ppl").between(F.coalesce("lo", "small_lo"), F.coalesce("hi", "small_hi")), F.lit(True))
        judged = self.measured.join(self.bands, "lang", "left").join(F.broadcast(small), F.lit(True), "left")
        return judged.withColumn("kept", ~F.col("base_failed") & inside)

    def filter(self, docs: DataFrame) -> DataFrame:
        """The documents that are kept, with all their columns; texts aren't shuffled."""
        band = {r.lang: (r.lo, r.hi) for r in self.bands.collect()}  # one row a language with BAND_MIN documents
        model, small = self.model, band.get(None, (-np.inf, np.inf))
        numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # whatever the caller's names are
        of = [docs.columns.index(c) for c in ("lang", "text")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = pa.RecordBatch.from_arrays([b.column(k) for k in of], names=["lang", "text"])
                m = _measure(own, model.value)
                lim = [band.get(x, small) for x in own.column("lang").fill_null(NO_LANG).to_pylist()]
                lim = np.array(lim, float).reshape(-1, 2)
                ok = ~base_failed(m) & (m["log_ppl"] >= lim[:, 0]) & (m["log_ppl"] <= lim[:, 1])
                yield b.filter(pa.array(ok))

        return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, log-perplexity and verdict of every document."""
    v = Quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).verdicts()
    return v.select("doc_id", *COUNTS, "base_failed", "kept", F.round("log_ppl", 6).alias("log_ppl"))
