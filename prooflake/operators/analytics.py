"""Sequence analytics over steps (trace ids, pos, rule) and traces (n, rules, shape, first_rule, last_rule)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def six(c: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def rule_counts(steps: DataFrame) -> DataFrame:
    """(pos, rule, n)."""
    return steps.groupBy("pos", "rule").agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, n_rules: int) -> DataFrame:
    """(pos, n, entropy): entropy of the rules at each position over the logarithm of the number of rules."""
    w = Window.partitionBy("pos")  # at most n_rules rows each, after the count
    q = F.col("n") / F.sum("n").over(w).cast("double")
    return counts.withColumn("q", q).groupBy("pos").agg(F.sum("n").alias("n"), six(-F.sum(F.col("q") * F.log("q")) / math.log(n_rules)).alias("entropy"))


def ranked(counts: DataFrame, k: int, by: str = "pos") -> DataFrame:
    """The k most frequent rules of each position, ties by name: (pos, rank, rule, n)."""
    w = Window.partitionBy(by).orderBy(F.desc("n"), "rule")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, F.col("rank").cast("long").alias("rank"), "rule", "n")


def modal(counts: DataFrame) -> DataFrame:
    """(pos, rule, mass): the most frequent rule of each position and its share."""
    best = F.min(F.struct((-F.col("n")).alias("less"), "rule"))  # of equals the first by name
    top = counts.groupBy("pos").agg(best.alias("best"), F.sum("n").alias("all"))
    return top.select("pos", F.col("best.rule").alias("rule"), six(-F.col("best.less") / F.col("all")).alias("mass"))


def pivot(steps: DataFrame, rules: list[str]) -> DataFrame:
    """One row per position, one column per rule, zeros where a rule doesn't occur."""
    return steps.groupBy("pos").agg(*(F.count_if(F.col("rule") == r).alias(r) for r in rules))


def length_histogram(traces: DataFrame, width: int = 60) -> DataFrame:
    """(n, count, bar): bars in proportion to the most frequent length."""
    h = traces.groupBy("n").agg(F.count(F.lit(1)).alias("count"))
    most = F.max("count").over(Window.partitionBy(F.lit(0)))  # one row per length
    return h.withColumn("bar", F.repeat(F.lit("#"), F.floor(F.lit(width) * F.col("count") / most).cast("int")))


def fractions(traces: DataFrame, **tests: Column) -> DataFrame:
    """One row: the share of traces that pass each test."""
    return traces.agg(F.count(F.lit(1)).alias("n_traces"), *(six(F.count_if(t) / F.count(F.lit(1))).alias(k) for k, t in tests.items()))


def skeleton(traces: DataFrame, first: str, last: str) -> DataFrame:
    a, b = F.col("first_rule") == first, F.col("last_rule") == last
    return fractions(traces, starts=a, ends=b, sandwich=a & b)


def contains(traces: DataFrame, rules: list[str]) -> DataFrame:
    return fractions(traces, **{f"has_{r}": F.array_contains("rules", r) for r in rules})


def ends(traces: DataFrame, k: int = 5) -> DataFrame:
    """(which, rank, rule, n): the most frequent first and last rules."""
    both = traces.select(F.explode(F.array(F.struct(F.lit("first").alias("which"), F.col("first_rule").alias("rule")), F.struct(F.lit("last").alias("which"), F.col("last_rule").alias("rule")))).alias("x")).select("x.*")
    return ranked(both.groupBy("which", "rule").agg(F.count(F.lit(1)).alias("n")), k, "which")


def top_shapes(traces: DataFrame, k: int) -> DataFrame:
    """The k most frequent shapes, ties by name."""
    return traces.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape").limit(k)
