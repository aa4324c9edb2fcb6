"""An index of the keys seen so far, which a batch reads only where it may hit.

Keys lie in ``buckets`` folders by hash, each append a version of its own with a Bloom filter for every bucket that it
writes.  Of a batch, keys that no filter of their bucket may hold are new without a look at any key; the others are
anti-joined with the keys of their buckets alone, so what is read follows the batch and the filters' few errors, not the
index.  Filters are ``WORDS`` longs a bucket and append; ``compact`` makes one of all appends.  Appends are versions: one that
fails leaves nothing, and two at a time can't both succeed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import kept
from ..sources.versions import Versions

#: 64-bit words of a filter, and bits set for each key.
WORDS, BITS = 256, 4


class KeyIndex:
    """Keys are one or more columns; nulls are values like others."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.table, self.filters = Versions(spark, f"{root}/keys", ("__bucket",)), Versions(spark, f"{root}/filters")
        self.touched: list[int] = []  # buckets that the last batch read

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """Adds ``__bucket`` and ``__bits``, the places of a key in its bucket's filter."""
        known = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys] + [F.col(k).isNull() for k in self.keys]
        bits = F.array(*(F.pmod(F.xxhash64(F.lit(b), *known), F.lit(64 * WORDS)).cast("int") for b in range(BITS)))
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*known), F.lit(self.buckets)).cast("int")).withColumn("__bits", bits)

    def _filters_of(self, hashed: DataFrame) -> DataFrame:
        """(bucket, words) of all rows."""
        bit = hashed.select(F.col("__bucket").alias("bucket"), F.explode("__bits").alias("at"))
        words = bit.groupBy("bucket", F.expr("at div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits"))
        table = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # at most WORDS entries
        return table.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("words"))

    @staticmethod
    def _may_hold(words: Column) -> Column:
        return F.forall("__bits", lambda b: F.get(words, F.floor(b / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)) != 0)

    def new(self, batch: DataFrame) -> DataFrame:
        """The keys of the batch, each once, that the index doesn't hold."""
        hashed = self._hashed(batch.select(*self.keys).distinct())
        self.touched = []
        if not self.table.versions():
            return hashed.select(*self.keys)
        filters = self.filters.read().groupBy("bucket").agg(F.collect_list("words").alias("all"))  # one an append
        asked = hashed.join(filters, F.col("__bucket") == F.col("bucket"), "left").withColumn("__may", F.exists("all", self._may_hold)).drop("bucket", "all", "__bits")
        asked = kept(asked.withColumn("__may", F.coalesce("__may", F.lit(False))), "asked")
        self.touched = sorted(r[0] for r in asked.where("__may").select("__bucket").distinct().collect())  # at most all buckets
        known = self.table.read().where(F.col("__bucket").isin(self.touched))  # other buckets' folders aren't read
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"k.{k}")) for k in ("__bucket", *self.keys)]
        rest = asked.where("__may").alias("a").join(known.alias("k"), same, "left_anti")
        return asked.where("NOT __may").select(*self.keys).unionByName(rest.select(*self.keys))

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in the batch's new keys, and give them back."""
        fresh = kept(self.new(batch), "fresh")
        hashed = self._hashed(fresh)
        self.filters.commit(self._filters_of(hashed), append=True)  # first: a filter without its keys only costs a look
        self._commit(hashed)
        return fresh

    def _commit(self, hashed: DataFrame, append: bool = True) -> None:
        self.table.commit(hashed.drop("__bits").repartition("__bucket"), append=append)

    def compact(self) -> None:
        """One folder of keys and one filter a bucket in place of those of all appends."""
        hashed = kept(self._hashed(self.table.read().select(*self.keys)), "compacted")
        self._commit(hashed, append=False)
        self.filters.commit(self._filters_of(hashed))
