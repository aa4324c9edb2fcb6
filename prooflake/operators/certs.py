"""Relational checks over steps (cid, id, rule, ...) and premises (cid, id, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import closure


def premise_join(steps: DataFrame, premises: DataFrame) -> DataFrame:
    """(cid, id, rule, p, premise_rule): each step with the latest earlier step of every cited id."""
    cited = premises.join(steps.select("cid", "id", "rule", "pos"), ["cid", "id"])
    earlier = steps.select("cid", F.col("id").alias("p"), F.col("rule").alias("premise_rule"), F.col("pos").alias("p_pos"))
    met = cited.join(earlier, ["cid", "p"]).where("p_pos < pos")
    return met.groupBy("cid", "id", "rule", "p").agg(F.max_by("premise_rule", "p_pos").alias("premise_rule"))


def dangling(steps: DataFrame, premises: DataFrame) -> DataFrame:
    """Citations of ids that no step has."""
    return premises.join(steps.select("cid", F.col("id").alias("p")).distinct(), ["cid", "p"], "left_anti").select("cid", "id", "p")


def declared(citations: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Citations with what ``names`` (``by`` and ``since``) says of the name they cite, and whether it is declared at all."""
    return citations.join(names, by, "left").withColumn("declared", F.col("since").isNotNull())


def live_steps(steps: DataFrame, premises: DataFrame) -> DataFrame:
    """Steps that the last step depends on: shapes without dead steps come from these."""
    last = steps.groupBy("cid").agg(F.max_by("id", "pos").alias("id"))
    reach = closure(premises.select("cid", "id", "p"), ["cid"])
    found = last.unionByName(last.join(reach, ["cid", "id"]).select("cid", F.col("p").alias("id"))).distinct()
    return steps.join(found, ["cid", "id"], "left_semi")


def equal_pairs(steps: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    """Pairs of two different steps of a trace with equal ``left`` of one and ``right`` of the other: an equi-join."""
    a = steps.select(*by, F.col("pos").alias("a"), F.col(left).alias("__k"))
    b = steps.select(*by, F.col("pos").alias("b"), F.col(right).alias("__k"))
    return a.join(b, [*by, "__k"]).where("a <> b").drop("__k")
