"""Line deduplication with levelled sorted runs of line hashes [DataFrame functions only].

A line's key is the line without white space at its ends and with A-Z in lower case, told apart by 128 bits of hash.
Documents come in batches of falling ids.  The index of lines seen so far is a list of runs: tables of (h, g, n, holder)
that are bucketed and sorted by the hash, so that a batch is shuffled once and meets each run in a merge join without
moving the run.  Keys that no run has are fresh: their largest document of the batch is their holder, for later batches
have smaller ids only.  Known keys add their count.  Either way the batch is appended as a run of its own, and ``FANOUT``
runs of a level are compacted into one run of the next, so a line is rewritten once a level.  What the runs add up to says
which keys ``AT_LEAST`` documents have; their lines go everywhere but in the holder.

Lines, hashes and counts are shuffled, texts only once, for the join with the places of their dropped lines.  Counts are
added up before each shuffle, and a key is one row of a batch, so a line that all documents have is no hot key in a run.

Defined cases: a null or empty text is one empty line; a line is what stands between two ``\\n`` or an end of the text, so a
text that ends in one has an empty last line; documents are told apart by id: rows with equal ids are one document when
documents are counted, and each of them keeps the lines it holds; all rows with a null id are one document, smaller than
the others; repeats within the holder stay; lengths are in code points after stripping; whole texts are read; an empty
table gives no rows; further columns of the input, whatever their names, stay in ``row`` and change nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed by the contract: code points of a key, and documents that have it.
LEAST_CHARS, AT_LEAST = 40, 5
#: Batches of a whole table, and runs of a level that are compacted into one.
BATCHES, FANOUT = 4, 2
_ENDS = " \t\n\x0b\x0c\r"
_RUN = ["h", "g", "n", "holder"]


def line_key(line: Column) -> Column:
    """The line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_ENDS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keys(text: Column, least: int) -> Column:
    """Array of (pos, h, g) of the lines of at least ``least`` code points."""
    cores = F.transform(_lines(text), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(_ENDS)).alias("core")))
    long = F.filter(cores, lambda x: F.length(x["core"]) >= least)
    lower = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), line_key(x["core"]).alias("key")))
    return F.transform(lower, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h"), F.xxhash64(F.lit(1), x["key"]).alias("g")))


class LineRuns:
    """Levels of sorted runs (h, g, n, holder) on shared storage; a key may lie in several runs, its counts add up."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def _write(self, df: DataFrame) -> str:
        """A run of rows that lie together by bucket already, as joins of runs give them."""
        name = f"line_run_{uuid.uuid4().hex}"
        df.select(*_RUN).write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> str:
        """Append a batch of (h, g, n, top), one row a key, as a run; the name of its table.

        Merge-anti-join: a key that no run has keeps its largest document as the holder, a known one has null there.
        """
        met = batch.repartition(self.buckets, "h", "g")
        seen = F.lit(False)
        for k, run in enumerate(self.runs()):
            met = met.join(self.spark.table(run).select("h", "g", F.lit(True).alias(f"in{k}")), ["h", "g"], "left")
            seen = seen | F.coalesce(F.col(f"in{k}"), F.lit(False))
        name = self._write(met.withColumn("holder", F.when(~seen, F.col("top"))))
        self._place(name, 0)
        return name

    def _place(self, name: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(self._write(self._merged(old)), level + 1)
            self._drop(old)

    def _merged(self, runs: list[str]) -> DataFrame:
        """The runs as one: a merge join of two needs no shuffle, their buckets are the same."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            met = a.join(b.select("h", "g", F.col("n").alias("m"), F.col("holder").alias("other")), ["h", "g"], "full")
            return met.select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("holder", "other").alias("holder"))

        return reduce(two, [self.spark.table(x) for x in runs])

    def totals(self) -> DataFrame:
        """(h, g, n, holder), a row a key."""
        runs = self.runs()
        return self._merged(runs) if len(runs) > 1 else self.spark.table(runs[0])

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")  # external: the files go with the scratch folder

    def forget(self) -> None:
        self._drop(self.runs())
        self.levels = []


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of a document's batch: falling ids, null ids last; the cuts are near quantiles and matter for balance only."""
    shares = [1 - k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares).alias("cuts")).first()["cuts"] if shares else None
    below = sum(((F.col("doc_id").cast("long") <= c).cast("int") for c in cuts or []), F.lit(0))
    return F.coalesce(below, F.lit(batches - 1))


def dedup_lines(spark: SparkSession, docs: DataFrame, least: int = LEAST_CHARS, at_least: int = AT_LEAST, batches: int = BATCHES) -> DataFrame:
    """(doc_id, row, n_lines, n_dropped, kept): one row per document; ``row`` is the caller's, ``kept`` the text that stays."""
    keep = Scratch(spark, "line-dedup")
    # two steps: beside explode, the text's hash would be taken again for each line
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id(F.col("text")).alias("x"), _batch_of(docs, batches).alias("batch"), keys(F.col("text"), least).alias("ks"))
    known.select("doc_id", "x", "batch", F.explode("ks").alias("k")).select("doc_id", "x", "batch", "k.*").write.partitionBy("batch").parquet(keep.path("lines"))
    lines = spark.read.schema("doc_id long, x long, pos int, h long, g long, batch int").parquet(keep.path("lines"))
    index = LineRuns(spark, keep.path("runs"))
    for k in range(batches):
        of_doc = lines.where(F.col("batch") == k).select("h", "g", "doc_id").distinct()
        index.add(of_doc.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")))
    going = keep.keep(index.totals().where(F.col("n") >= at_least).select("h", "g", "holder"), "going")
    index.forget()
    gone = lines.join(going, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    gone = keep.keep(gone.groupBy(F.col("doc_id").alias("of"), F.col("x").alias("of_x")).agg(F.collect_set("pos").alias("gone")), "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id(F.col("text")).alias("x"), F.struct("*").alias("row"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["of"]) & (rows["x"] == gone["of_x"]), "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))

    def without(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # the array of lines is bound once: in a lambda it would be made again for each line
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.transform(F.array(_lines(text)), without)[0])
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", "row", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents after boilerplate that five or more of them share is gone."""
    out = dedup_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
