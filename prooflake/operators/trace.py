"""Ordered event traces: a trace is the rows of some id columns, a step is a row, its rule is one column's value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TraceSpec:
    ids: tuple[str, ...]
    order: tuple[str, ...]
    rule: str


def positions(df: DataFrame, spec: TraceSpec) -> DataFrame:
    """Adds ``pos`` (from 0), the trace length ``n`` and ``rule``."""
    w = Window.partitionBy(*spec.ids)
    ordered = w.orderBy(*spec.order)
    return df.withColumn("pos", (F.row_number().over(ordered) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rule", F.col(spec.rule))


def shapes(df: DataFrame, spec: TraceSpec) -> DataFrame:
    """One row per trace: its length, rules in order and their joined shape.

    The order columns travel with each rule, so one aggregation does without sorting whole partitions first.
    """
    step = F.struct(*spec.order, F.col(spec.rule).alias("__rule"))
    rules = F.transform(F.array_sort(F.collect_list(step)), lambda x: x["__rule"])
    out = df.groupBy(*spec.ids).agg(rules.alias("rules"))
    return out.withColumn("n", F.size("rules").cast("long")).withColumn("shape", F.array_join("rules", "-")).withColumn("first_rule", F.get("rules", F.lit(0))).withColumn("last_rule", F.element_at("rules", -1))
