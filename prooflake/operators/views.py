"""Counts that follow a changing buffer: rows come and go as signed changes, and only the changes are aggregated.

A view is a versioned table of (keys, n).  A change adds a folder of its own sums; what the view says is the sum of all
folders, and after ``fold_every`` folders they are folded into one.  A change costs what it holds, a fold what the view has
keys; the buffer itself isn't read again.  Counts may fall below zero for a while, when a removal arrives before its row;
such keys aren't shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions


class CountView:
    """Number of rows by ``keys`` under insertions and removals."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], fold_every: int = 8):
        self.table, self.keys, self.fold_every = Versions(spark, root), keys, fold_every

    def change(self, rows: DataFrame, sign: int | Column = 1) -> int:
        """Take in rows with the view's keys: +1 comes, -1 goes; the version that holds them."""
        n = sign if isinstance(sign, Column) else F.lit(sign)
        delta = rows.select(*self.keys, n.cast("long").alias("n")).groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")
        number = self.table.commit(delta, append=True)
        if len(self.table.entry(number)["folders"]) > self.fold_every:
            number = self.table.commit(self.sums(number), base=number)
        return number

    def sums(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def read(self, version: int | None = None) -> DataFrame:
        """(keys, n) of the keys that some rows have."""
        return self.sums(version).where("n > 0")


def novelty(shapes: DataFrame) -> DataFrame:
    """(n_shapes, n_novel) of (shape, baseline, n): shapes there are, and those that the baseline doesn't have."""
    per = shapes.groupBy("shape").agg(F.bool_or("baseline").alias("old"))
    return per.agg(F.count(F.lit(1)).alias("n_shapes"), F.count_if(~F.col("old")).alias("n_novel"))
