"""Sequence analytics on traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from .tables import BASELINE, CONTAINS, END, RULES, START, STEPS, TRACES, r6, steps, table, traces

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {STEPS} SELECT user_id, d, pos, rule FROM steps")
def positions(spark, sf):
    """Every event with its place in its trace."""
    return steps(spark, sf).select("user_id", "d", "pos", "rule")


@query(f"WITH {STEPS} SELECT pos, rule, count(*) AS n FROM steps GROUP BY pos, rule")
def pos_rule_freq(spark, sf):
    """Occurrences of each rule at each position."""
    return A.rule_counts(steps(spark, sf))


@query(
    f"""WITH {STEPS}, f AS (SELECT pos, rule, count(*) AS c FROM steps GROUP BY pos, rule),
q AS (SELECT pos, c, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY pos) AS q FROM f)
SELECT pos, CAST(sum(c) AS BIGINT) AS n, {r6("-sum(q * ln(q)) / ln(5)")} AS entropy FROM q GROUP BY pos"""
)
def pos_entropy(spark, sf):
    """Normalised entropy of the rules at each position."""
    return A.entropy(A.rule_counts(steps(spark, sf)), len(RULES))


@query(
    f"""WITH {STEPS}, f AS (SELECT pos, rule, count(*) AS c FROM steps GROUP BY pos, rule),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY c DESC, rule) AS k, sum(c) OVER (PARTITION BY pos) AS t FROM f)
SELECT pos, rule, {r6("c / CAST(t AS DOUBLE)")} AS mass FROM r WHERE k = 1"""
)
def pos_modal(spark, sf):
    """Most frequent rule of each position, and its share."""
    return A.modal(A.rule_counts(steps(spark, sf)))


@query(
    f"""WITH {STEPS}, f AS (SELECT pos, rule, count(*) AS n FROM steps GROUP BY pos, rule),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, rule) AS rank FROM f) SELECT pos, rank, rule, n FROM r WHERE rank <= 3"""
)
def pos_top3(spark, sf):
    """Three most frequent rules of each position."""
    return A.ranked(A.rule_counts(steps(spark, sf)), 3)


@query(f"WITH {STEPS} SELECT pos, {', '.join(f"count(*) FILTER (WHERE rule = '{r}') AS {r}" for r in RULES)} FROM steps GROUP BY pos")
def pos_rule_pivot(spark, sf):
    """Counts by position, a column per rule."""
    return A.pivot(steps(spark, sf), RULES)


@query(f"WITH {TRACES} SELECT count(*) AS n_traces, count(DISTINCT shape) AS n_shapes FROM traces")
def unique_shapes(spark, sf):
    """Traces and distinct shapes."""
    return traces(spark, sf).agg(F.count(F.lit(1)).alias("n_traces"), F.countDistinct("shape").alias("n_shapes"))


@query(
    f"""WITH {TRACES}, h AS (SELECT n, count(*) AS "count" FROM traces GROUP BY n)
SELECT n, "count", repeat('#', CAST(floor(60 * "count" / CAST(max("count") OVER () AS DOUBLE)) AS INT)) AS bar FROM h"""
)
def length_hist(spark, sf):
    """Histogram of trace lengths."""
    return A.length_histogram(traces(spark, sf))


@query(
    f"""WITH {TRACES} SELECT count(*) AS n_traces, {r6(f"count(*) FILTER (WHERE first_rule = '{START}') / CAST(count(*) AS DOUBLE)")} AS starts,
{r6(f"count(*) FILTER (WHERE last_rule = '{END}') / CAST(count(*) AS DOUBLE)")} AS ends,
{r6(f"count(*) FILTER (WHERE first_rule = '{START}' AND last_rule = '{END}') / CAST(count(*) AS DOUBLE)")} AS sandwich FROM traces"""
)
def skeleton_fractions(spark, sf):
    """Share of traces that start, end and both as the skeleton does."""
    return A.skeleton(traces(spark, sf), START, END)


@query(f"WITH {TRACES} SELECT count(*) AS n_traces, {', '.join(r6(f"count(*) FILTER (WHERE list_contains(rules, '{r}')) / CAST(count(*) AS DOUBLE)") + f' AS has_{r}' for r in CONTAINS)} FROM traces")
def contains_fractions(spark, sf):
    """Share of traces that contain each of some rules."""
    return A.contains(traces(spark, sf), CONTAINS)


@query(
    f"""WITH {TRACES}, b AS (SELECT 'first' AS which, first_rule AS rule FROM traces UNION ALL SELECT 'last', last_rule FROM traces),
c AS (SELECT which, rule, count(*) AS n FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY which ORDER BY n DESC, rule) AS rank FROM c)
SELECT which, rank, rule, n FROM r WHERE rank <= 5"""
)
def first_last_rule(spark, sf):
    """Most frequent first and last rules."""
    return A.ends(traces(spark, sf))


@query(f"WITH {TRACES} SELECT shape, count(*) AS n FROM traces GROUP BY shape ORDER BY n DESC, shape LIMIT 15")
def shape_topk(spark, sf):
    """Fifteen most frequent shapes."""
    return A.top_shapes(traces(spark, sf), 15)


@query(f"WITH {TRACES} SELECT shape FROM traces WHERE d <= DATE '{BASELINE}' UNION SELECT shape FROM traces WHERE n >= 5")
def shape_union(spark, sf):
    """Distinct shapes of the baseline and of long traces."""
    t = traces(spark, sf)
    return t.where(F.col("d") <= BASELINE).select("shape").union(t.where("n >= 5").select("shape")).distinct()


@query(f"WITH {TRACES} SELECT shape FROM traces WHERE d > DATE '{BASELINE}' EXCEPT SELECT shape FROM traces WHERE d <= DATE '{BASELINE}'")
def shape_except(spark, sf):
    """Shapes that the baseline doesn't have."""
    t = traces(spark, sf)
    return t.where(F.col("d") > BASELINE).select("shape").subtract(t.where(F.col("d") <= BASELINE).select("shape"))


@query(f"WITH {TRACES} SELECT shape FROM traces WHERE d > DATE '{BASELINE}' INTERSECT SELECT shape FROM traces WHERE d <= DATE '{BASELINE}'")
def shape_intersect(spark, sf):
    """Later shapes that the baseline has too."""
    t = traces(spark, sf)
    return t.where(F.col("d") > BASELINE).select("shape").intersect(t.where(F.col("d") <= BASELINE).select("shape"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, sf):
    """Documents by source."""
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
