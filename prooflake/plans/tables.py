"""Tables of a scale folder as traces and buffers, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trace import TraceSpec, positions, shapes

#: Constants that the Spark plans and their SQL share.
RULES = ["click", "error", "purchase", "signup", "view"]
START, END, CONTAINS = "view", "purchase", ["click", "error", "signup"]
DRAWS = 5000
BASELINE, PHASE = "2024-01-05", "2024-01-15"
SEEDS, CAP, MAX_CHARS, SAMPLE, TEMPERATURE, EARLY = 23, 3, 320, 5, 2.0, 6
SPEC = TraceSpec(("user_id", "d"), ("ts", "event_id"), "event_type")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("d", F.to_date("ts"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return positions(events(spark, sf), SPEC)


def traces(spark: SparkSession, sf: str) -> DataFrame:
    return shapes(events(spark, sf), SPEC)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels: the buffer and its verdicts."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


STEPS = """steps AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id, ts, value, event_type AS rule,
  CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
  count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events)"""
TRACES = (
    STEPS
    + """, traces AS (SELECT user_id, d, CAST(max(n) AS BIGINT) AS n, string_agg(rule, '-' ORDER BY pos) AS shape, list(rule ORDER BY pos) AS rules,
  max(CASE WHEN pos = 0 THEN rule END) AS first_rule, max(CASE WHEN pos = n - 1 THEN rule END) AS last_rule FROM steps GROUP BY user_id, d)"""
)
JUDGED = "judged AS (SELECT documents.*, quality, toxic FROM documents JOIN labels USING (doc_id))"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE)"
