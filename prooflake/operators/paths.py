"""The k best paths through a table of weighted steps, level by level.

A level is one join of the paths that are open with the steps, and the k best of each end stay: a path's beginning must
itself be among the k best to where it leads, so nothing better is lost.  Work is levels x nodes x k x steps a node, whatever the
number of paths.  Ties go to the path that is smaller as an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept


def best_paths(edges: DataFrame, start: str, end: str, k: int, most: int) -> DataFrame:
    """(rank, cost, path): the k cheapest ways from ``start`` to ``end`` in at most ``most`` steps of (a, b, cost).

    A way ends where it first reaches ``end``; other nodes may come again.  Costs are integers, not negative.
    """
    best = F.row_number().over(Window.partitionBy("node").orderBy("cost", "path"))
    top = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cost", "path"))  # at most most * k rows
    first = edges.sparkSession.createDataFrame([(start, 0, [start])], "node string, cost long, path array<string>")
    steps = edges.select(F.col("a").alias("node"), F.col("b").alias("next"), F.col("cost").alias("more"))
    open_paths, ended = first, []
    for level in range(most):
        grown = open_paths.join(steps, "node").select(F.col("next").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), F.concat("path", F.array("next")).alias("path"))
        level_best = kept(grown.withColumn("r", best).where(F.col("r") <= k).drop("r"), f"paths-{level}")
        ended.append(level_best.where(F.col("node") == end))
        open_paths = level_best.where(F.col("node") != end)
    every = ended[0]
    for e in ended[1:]:
        every = every.unionByName(e)
    return every.withColumn("rank", top.cast("long")).where(F.col("rank") <= k).select("rank", "cost", "path")


def transitions(rows: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """(a, b, n): how often a row of kind b follows one of kind a with the same keys."""
    follows = F.lead(kind).over(Window.partitionBy(*keys).orderBy(*order))
    pairs = rows.select(F.col(kind).alias("a"), follows.alias("b")).where("b IS NOT NULL")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
