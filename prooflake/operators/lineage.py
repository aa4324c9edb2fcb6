"""Ancestors of rows that cite earlier ones, however deep, to a fixpoint.

``lineage`` follows one citation a row: each round a row's pointer jumps over what its target has covered already, so
paths double and a chain of a million takes twenty rounds of one join; rows that have reached their root leave the
active side.  ``closure`` gives all pairs of any citations, round by round from the pairs that the last round added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import kept


def lineage(nodes: DataFrame, ident: str = "id", parent: str = "parent", mask: str | None = None) -> DataFrame:
    """(ident, root, depth, mask): the row at the end of a row's citations, how many lie between, and all masks or-ed.

    A parent that no row has counts as none.  Ids are unique; a cycle raises a ValueError.
    """
    own = F.col(mask).cast("long") if mask else F.lit(0).cast("long")
    rows = nodes.select(F.col(ident).alias("id"), F.col(parent).alias("at"), own.alias("mask"))
    known = rows.select(F.col("id").alias("at"), F.lit(True).alias("known"))
    rows = rows.join(known, "at", "left").withColumn("at", F.when(F.col("known"), F.col("at")))
    start = rows.select("id", "at", F.when(F.col("at").isNull(), F.col("id")).alias("root"), F.col("at").isNotNull().cast("long").alias("depth"), "mask")
    state = kept(start, "lineage")
    left, limit, rounds = state.where("at IS NOT NULL").count(), 1, 0
    total = state.count()
    while left:
        if limit > 2 * total:  # a path has no more rows than there are
            raise ValueError("citations form a cycle")
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("root").alias("end"), F.col("depth").alias("more"), F.col("mask").alias("seen"))
        jumped = state.where("at IS NOT NULL").join(ahead, "at").select("id", F.col("next").alias("at"), F.col("end").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("mask").bitwiseOR(F.col("seen")).alias("mask"))
        state = kept(state.where("at IS NULL").unionByName(jumped), f"lineage-{rounds}")
        left, limit, rounds = state.where("at IS NOT NULL").count(), limit * 2, rounds + 1
    return state.select(F.col("id").alias(ident), "root", "depth", "mask")


def closure(edges: DataFrame, by: list[str], child: str = "id", parent: str = "p") -> DataFrame:
    """All (by, child, parent) pairs that edges lead through, one or more of them; edges may form any graph."""
    cols = [*by, child, parent]
    reach = kept(edges.select(*cols).distinct(), "closure")
    fresh, rounds = reach, 0

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*by, F.col(child).alias(parent), F.col(parent).alias("__far"))
        return a.join(b, [*by, parent]).select(*by, child, F.col("__far").alias(parent))

    while not fresh.isEmpty():
        found = joined(fresh, reach).union(joined(reach, fresh)).distinct()
        fresh = kept(found.join(reach, cols, "left_anti").select(*cols), f"closure-new-{rounds}")
        reach = kept(reach.unionByName(fresh), f"closure-{rounds}")
        rounds += 1
    return reach
