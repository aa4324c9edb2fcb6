"""Keyed state of a stream: running averages and counts by (position, rule) of each source, with expiry.

A source's state lives while its rows are at most ``gap`` apart: that is a session.  A value state holds the session's start, last
time, length and running average, a map state its counts by (position, rule), where positions begin anew each day, and
an event-time timer ends it once the watermark has passed its last row by the gap; a later row of the source ends it as
well.  Ended sessions are written out, one folder a batch, so a replayed batch writes the same again; open ones stay in
the checkpoint, where ``open_sessions`` reads them.  A restart goes on from the checkpoint.

Rows of a source must not come later than the watermark's delay; later ones are dropped by Spark.  Rows of equal time
are taken by their id.  A null value counts as a row and leaves the average; null times are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SESSION = "start long, last long, n long, valued long, average double, day long, place int"
OUT = "source long, start long, last long, n long, average double, pos int, rule string, count long"
DAY = 86_400_000_000
#: Rows of ended sessions that are given at once, if a source has so many.
FRAME = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SourceSessions(StatefulProcessor):
    """Sessions of one source; times are microseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.counts = handle.getMapState("counts", "pos int, rule string", "count long")

    def _ended(self, key: int, s: list, counts: dict) -> list[tuple]:
        return [(key, s[0], s[1], s[2], s[4], pos, rule, n) for (pos, rule), n in sorted(counts.items())]

    def _frames(self, rows: list[tuple], least: int = 1) -> Iterator[pd.DataFrame]:
        """One frame of many sessions' rows, if they are so many: a frame for each session costs more than its rows."""
        if len(rows) >= least:
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
            rows.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.session.get()  # each call of a state is a message to the JVM
        held = list(held) if held else None
        before = held[1] if held else None
        new: dict = {}
        fresh_start, ended = False, []
        for t, _, rule, value in sorted(r for part in rows for r in zip(part["us"], part["ident"], part["rule"], part["value"])):
            if held and t - held[1] > self.gap:
                ended += self._ended(key[0], held, self._merged(new, fresh_start))
                yield from self._frames(ended, FRAME)
                held, new, fresh_start = None, {}, True
            if held is None:
                held = [t, t, 0, 0, None, t // DAY, 0]
            if t // DAY != held[5]:
                held[5], held[6] = t // DAY, 0
            new[held[6], rule] = new.get((held[6], rule), 0) + 1
            held[1], held[2], held[6] = t, held[2] + 1, held[6] + 1
            if value == value and value is not None:
                held[3] += 1
                held[4] = value if held[4] is None else held[4] + (value - held[4]) / held[3]
        yield from self._frames(ended)
        if held is None:
            return
        if fresh_start and before is not None:
            self.counts.clear()
        kept = before is not None and not fresh_start  # only then there may be counts of the same session
        for k, n in new.items():
            old = self.counts.getValue(k) if kept else None
            self.counts.updateValue(k, ((old[0] if old else 0) + n,))
        self.session.update(tuple(held))
        if before is not None:
            self.handle.deleteTimer(self._expiry(before))
        self.handle.registerTimer(self._expiry(held[1]))

    def _merged(self, new: dict, fresh_start: bool) -> dict:
        out = {} if fresh_start else {tuple(k): v[0] for k, v in self.counts.iterator()}
        for k, n in new.items():
            out[k] = out.get(k, 0) + n
        return out

    def _expiry(self, last: int) -> int:
        return (last + self.gap) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.session.get()
        if held:
            yield from self._frames(self._ended(key[0], list(held), self._merged({}, False)))
            self.session.clear()
            self.counts.clear()

    def close(self) -> None:
        pass


def run_sessions(stream: DataFrame, sink: str, checkpoint: str, source: str, ident: str, rule: str, value: str, at: str = "ts", gap_hours: float = 8, late: str = "1 hour") -> StreamingQuery:
    """Start the stream; ended sessions go to ``sink``/batch=N as (source, start, last, n, average, pos, rule, count)."""
    rows = stream.select(F.col(at).cast("timestamp").alias("ts"), F.col(source).cast("long").alias("source"), F.col(ident).cast("long").alias("ident"), F.col(rule).alias("rule"), F.col(value).cast("double").alias("value"))
    rows = rows.where("ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    ended = rows.groupBy("source").transformWithStateInPandas(SourceSessions(round(gap_hours * 3_600_000_000)), OUT, "Append", "EventTime")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # typed state needs it; a query keeps the settings that it starts with
    try:
        return ended.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that haven't ended, from the state in the checkpoint."""
    read = spark.read.format("statestore")
    session = read.option("path", checkpoint).option("stateVarName", "session").load()
    counts = read.option("path", checkpoint).option("stateVarName", "counts").load()
    session = session.select(F.col("key.source").alias("source"), "value.start", "value.last", "value.n", "value.average")
    counts = counts.select(F.col("key.source").alias("source"), F.col("user_map_key.pos").alias("pos"), F.col("user_map_key.rule").alias("rule"), F.col("user_map_value.count").alias("count"))
    return session.join(counts, "source")


def ended_sessions(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(f"{OUT}, batch int").parquet(sink).drop("batch")
