"""Quality analytics: contamination, drift, probe funnels, novelty and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import six


def rate(part: Column, whole: Column) -> Column:
    """A ratio; null where there is nothing."""
    return six(part / F.nullif(whole, F.lit(0)))


def contamination(df: DataFrame, by: str, rejected: Column) -> DataFrame:
    """(by, n, rejected, rate) and a row OVERALL, in one aggregation with grouping sets."""
    marked = df.select(F.col(by), rejected.cast("long").alias("__r"))
    out = marked.groupingSets([[F.col(by)], []], by).agg(F.count(F.lit(1)).alias("n"), F.sum("__r").alias("rejected"), F.grouping(by).alias("__g"))
    return out.select(F.when(F.col("__g") == 1, "OVERALL").otherwise(F.col(by)).alias(by), "n", "rejected", rate(F.col("rejected"), F.col("n")).alias("rate"))


def rule_drift(traces: DataFrame, rejected: Column, ratio: float = 2, least: int = 3) -> DataFrame:
    """(rule, n, rejected, rate, ratio, flag): each trace counts once for each of its rules."""
    marked = traces.select(rejected.cast("long").alias("r"), F.array_distinct("rules").alias("rules"))
    overall = marked.agg((F.sum("r") / F.count(F.lit(1))).alias("overall"))
    each = marked.select("r", F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("rejected"))
    out = each.join(F.broadcast(overall))  # one row
    x = F.col("rejected") / F.col("n") / F.greatest(F.lit(0.001), F.col("overall"))
    return out.select("rule", "n", "rejected", rate(F.col("rejected"), F.col("n")).alias("rate"), six(x).alias("ratio"), ((x >= ratio) & (F.col("rejected") >= least)).alias("flag"))


def by_group(traces: DataFrame, key: str, rejected: Column) -> DataFrame:
    return traces.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(rejected).alias("rejected"), rate(F.count_if(rejected), F.count(F.lit(1))).alias("rate"))


def probe_funnel(steps: DataFrame, ids: list[str], target: str, ready: Column, ok: Column) -> DataFrame:
    """One row: how many walks reach the target rule and its precondition, and how steps go once it holds.

    ``ready`` and ``ok`` are tests of one step: it establishes the precondition; it applies.
    """
    w = Window.partitionBy(*ids).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = steps.withColumn("in", F.coalesce(F.max(ready.cast("int")).over(w), F.lit(0)) == 1).withColumn("hit", F.col("rule") == target).withColumn("ok", ok)
    walks = s.groupBy(*ids).agg(F.max("hit").alias("reach"), F.max("in").alias("pre"), F.count_if("in").alias("open"), F.count_if(F.col("in") & F.col("hit")).alias("sampled"), F.count_if(F.col("in") & F.col("hit") & F.col("ok")).alias("applied"))
    total = [F.count(F.lit(1)).alias("walks"), F.count_if("reach").alias("reached"), F.count_if("pre").alias("ready"), *(F.sum(c).alias(c) for c in ("open", "sampled", "applied"))]
    out = walks.agg(*total)
    return out.select("walks", "reached", "ready", "open", "sampled", "applied", rate(F.col("reached"), F.col("walks")).alias("reach_rate"), rate(F.col("ready"), F.col("walks")).alias("ready_rate"), rate(F.col("sampled"), F.col("open")).alias("sampled_rate"), rate(F.col("applied"), F.col("sampled")).alias("applied_rate"))


def probe_class(reach: Column, pre: Column, sampled: Column, applied: Column, low: float = 0.05) -> Column:
    """Verdict of a funnel: A the precondition is rare, B the rule is rarely drawn or applied, the first that holds."""
    a, b = pre < low, (sampled < low) | (applied < low)
    return F.when(reach < low, "low").when(a & b, "Both").when(a, "A").when(b, "B").otherwise("Neither")


def novel(traces: DataFrame, baseline: DataFrame) -> DataFrame:
    """Traces whose shape the baseline doesn't have."""
    return traces.join(baseline.select("shape").distinct(), "shape", "left_anti")


def cumulative(first_seen: DataFrame, at: str) -> DataFrame:
    """(at, new, total) from one row per key with the time it was first seen."""
    per = first_seen.groupBy(at).agg(F.count(F.lit(1)).alias("new"))
    w = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)  # one row per round
    return per.withColumn("total", F.sum("new").over(w))


def rolling(per_round: DataFrame, at: str, value: str, last: int) -> DataFrame:
    """Mean of the last rounds, one row per round."""
    w = Window.orderBy(at).rowsBetween(1 - last, 0)
    return per_round.select(at, value, six(F.avg(value).over(w)).alias("mean"))
