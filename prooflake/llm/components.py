"""Connected components by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    n = e.select("u", "v").union(e.select("v", "u"))
    m = n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return n.join(m, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    o = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = o.groupBy("u").agg(F.min("v").alias("m"))
    moved = o.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v")))


def components(links: DataFrame, keep: Scratch, tag: str) -> DataFrame:
    """(node, component) of every node that has a link; links has two long columns; component is the least node."""
    a, b = links.columns[:2]
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    state, turn = None, 0
    while True:
        e = keep.keep(_small_star(_large_star(e).distinct()).distinct(), f"{tag}-{turn}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if turn:
            keep.drop(f"{tag}-{turn - 1}")
        if now == state or not now[0]:
            break
        state, turn = now, turn + 1
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
