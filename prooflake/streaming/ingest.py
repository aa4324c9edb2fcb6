"""Continuous ingestion of buffer files with Structured Streaming.

The file source and a checkpoint give each file to exactly one batch.  A replayed batch writes the same folder again
(one per batch), so the sink is idempotent; keys are deduplicated within the batch and against the batches before it by
keyed state.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import BUFFER

KEY = ["goal_toks", "cert_toks"]


def stream_buffer(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(BUFFER).option("maxFilesPerTrigger", files).json(path)


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, accept: Callable[[DataFrame], DataFrame] | None = None, cap: int = 320) -> StreamingQuery:
    """Append new, short enough and accepted entries to ``sink``/batch=N; runs until the input is used up.

    Of entries with equal tokens one is taken, the first that a batch brings.  What was seen is keyed state, a digest an
    entry, in the checkpoint; sink and checkpoint belong together.  An entry that ``accept`` refuses is not asked again.
    """

    def batch(df: DataFrame, number: int) -> None:
        (accept(df) if accept else df).write.mode("overwrite").json(f"{sink}/batch={number}")

    stream = stream_buffer(spark, source)
    short = stream.where(F.size("goal_toks") + F.size("cert_toks") + 3 <= cap)
    fresh = short.withColumn("__key", F.sha2(F.to_json(F.struct(*KEY)), 256)).dropDuplicates(["__key"]).drop("__key")
    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waits(first: float = 1.0, ceiling: float = 60.0) -> Iterator[float]:
    """Seconds between restarts: doubled while they are below the ceiling."""
    wait = first
    while True:
        yield wait
        if wait < ceiling:
            wait *= 2


def restarting(start: Callable[[], StreamingQuery], limit: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query to its end, started again after each failure (``limit``: at most so often); how often it failed.

    The checkpoint makes a restart go on where the last whole batch ended.
    """
    for failed, wait in enumerate(waits()):
        try:
            start().awaitTermination()
        except StreamingQueryException:
            if limit is not None and failed >= limit:
                raise
            sleep(wait)
        else:
            return failed
    raise AssertionError("unreachable")


def running_counts(steps: DataFrame) -> DataFrame:
    """Streaming counts by position and rule: a round updates them instead of scanning the buffer again."""
    return steps.groupBy("pos", "rule").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Extension: event-time windows with a watermark for late rows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
