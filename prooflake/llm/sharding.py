"""Contiguous, byte-balanced shards from global prefix sums [DataFrame functions only].

Rows are put in the order (text hash, doc_id) by range partitioning, so copies of a text are neighbours and a hot text
spreads over as many partitions as it needs.  Each partition's total gives its start in the global prefix sum; the
sum is cut at equal targets.  Only one row per partition meets in one place; texts are never shuffled.

Defined cases: a null text counts as empty (size 16); ties in the order are broken by doc_id; repeated rows are rows
of their own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Copies of a text stay in one shard if together they are at most this fraction of a shard's target.
GROUP_SLACK = 0.005


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 16 for the row."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(16)).cast("long")


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = 40, slack: float = GROUP_SLACK) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot, first_byte): shards are contiguous in (text hash, doc_id)."""
    keep = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            row_size(F.col("text")).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "rows",
    )
    dealt = keep.keep(rows.repartitionByRange("h", "doc_id").withColumn("part", F.spark_partition_id()), "dealt")
    # one row per partition: the only place where everything before a row matters
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    copies = Window.partitionBy("part", "h")
    placed = (
        dealt.withColumn("upto", F.sum("size").over(inside))
        .withColumn("rn", F.count(F.lit(1)).over(inside))
        .withColumn("copies_first", F.min(F.col("upto") - F.col("size")).over(copies))
        .withColumn("copies_bytes", F.sum("size").over(copies))
        .join(starts, "part")
    )
    together = F.col("copies_bytes") * F.lit(shards) <= F.col("total") * F.lit(slack)
    first = F.col("bytes_before") + F.col("upto") - F.col("size")
    twice_mid = F.when(together, 2 * (F.col("bytes_before") + F.col("copies_first")) + F.col("copies_bytes")).otherwise(2 * first + F.col("size"))
    cut = placed.withColumn("__m", twice_mid).select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(shards - 1), F.expr(f"(__m * {int(shards)}) div (2 * total)")).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("rn") - 1).alias("at"),
        first.alias("first_byte"),
    )
    cut = keep.keep(cut, "cut")
    heads = cut.groupBy("shard").agg(F.min("at").alias("head"))  # at most one row per shard
    return cut.join(F.broadcast(heads), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("head")).cast("long").alias("slot"), "first_byte"
    )


def op10_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in 40 contiguous shards of near equal bytes."""
    out = shard_by_bytes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
