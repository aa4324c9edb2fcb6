"""Buffers that change: keyed state of streams, and views that follow insertions and removals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from ..operators.keyindex import KeyIndex
from ..shared import fresh_path, kept
from ..sources.trace_files import register
from ..streaming import state as S
from .tables import BASELINE, TRACES, table, traces

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query(
    """WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 28800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, sid, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INT) AS pos FROM s),
whole AS (SELECT user_id, sid, epoch_us(min(ts)) AS start, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM s GROUP BY user_id, sid)
SELECT user_id AS source, start, n, cents, pos, event_type AS rule, count(*) AS "count" FROM p JOIN whole USING (user_id, sid) GROUP BY ALL"""
)
def session_stats(spark, sf):
    """Sessions of each user's events with their counts by position and rule, by keyed state of a stream that is stopped and restarted twice."""
    e = table(spark, sf, "events")
    root = fresh_path(spark, "sessions")
    lo, hi = e.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b")).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = [None, *((lo + (hi - lo) * k // 3 for k in (1, 2)) if lo is not None else (0, 0)), None]
    for a, b in zip(cuts, cuts[1:]):
        new = e if a is None else e.where(at > a)
        (new if b is None else new.where(at <= b)).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        S.run_sessions(stream, f"{root}/out", f"{root}/checkpoint", "user_id", "event_id", "event_type", "value").awaitTermination()
    cols = ["source", "start", "n", F.round(F.col("average") * F.col("n") * 100).cast("long").alias("cents"), "pos", "rule", "count"]
    return S.ended_sessions(spark, f"{root}/out").select(*cols).unionByName(S.open_sessions(spark, f"{root}/checkpoint").select(*cols))


def _changed(spark, sf, keys: list[str], rows):
    """A view over the traces after five changes: three insertions, a removal of traces with errors, a return of short ones."""
    t = kept(traces(spark, sf), "traces")
    view = V.CountView(spark, fresh_path(spark, "view"), keys, fold_every=3)
    wrong = F.array_contains("rules", "error")
    for lo, hi in (("2024-01-01", BASELINE), (BASELINE, "2024-01-15"), ("2024-01-15", "9999-12-31")):
        view.change(rows(t.where((F.col("d") > lo) & (F.col("d") <= hi) if lo != "2024-01-01" else F.col("d") <= hi)))
    view.change(rows(t.where(wrong)), -1)
    view.change(rows(t.where(wrong & (F.col("n") <= 2))))
    return view


_LEFT = "NOT list_contains(rules, 'error') OR n <= 2"


@query(
    f"""WITH {TRACES}, l AS (SELECT user_id, d FROM traces WHERE {_LEFT})
SELECT pos, rule, count(*) AS n FROM steps JOIN l USING (user_id, d) GROUP BY pos, rule"""
)
def counts_after_changes(spark, sf):
    """Counts by position and rule of a buffer after traces came and went, kept up by the changes alone."""
    steps = lambda t: t.select(F.posexplode("rules").alias("pos", "rule")).withColumn("pos", F.col("pos").cast("long"))
    return _changed(spark, sf, ["pos", "rule"], steps).read()


@query(
    f"""WITH {TRACES}, l AS (SELECT shape, bool_or(d <= DATE '{BASELINE}') AS old FROM traces WHERE {_LEFT} GROUP BY shape)
SELECT count(*) AS n_shapes, count(*) FILTER (WHERE NOT old) AS n_novel FROM l"""
)
def novelty_after_changes(spark, sf):
    """Shapes of that buffer, and those that its baseline days don't have."""
    shapes = lambda t: t.select("shape", (F.col("d") <= BASELINE).alias("baseline"))
    return V.novelty(_changed(spark, sf, ["shape", "baseline"], shapes).read())


@query(f"WITH {TRACES} SELECT shape, CAST(min(CASE WHEN d <= DATE '2024-01-08' THEN 1 WHEN d <= DATE '2024-01-16' THEN 2 ELSE 3 END) AS INT) AS batch FROM traces GROUP BY shape")
def indexed_shapes(spark, sf):
    """The batch of days that brings each shape first, by an index of keys that is kept between the batches."""
    t = kept(traces(spark, sf), "traces")
    index = KeyIndex(spark, fresh_path(spark, "index"), ["shape"])
    batch = F.when(F.col("d") <= "2024-01-08", 1).when(F.col("d") <= "2024-01-16", 2).otherwise(3)
    found = [index.add(t.where(batch == k)).select("shape", F.lit(k).alias("batch")) for k in (1, 2, 3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT conv_id AS id, turn AS pos, role, md5(text) AS digest FROM conversations WHERE role = 'assistant'")
def step_files(spark, sf):
    """The answers in all conversations, written as step files and read back with the role pushed into the reader."""
    register(spark)
    path = fresh_path(spark, "steps")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "role", "text")
    c.write.format("steps").mode("append").save(path)
    return spark.read.format("steps").load(path).where("role = 'assistant'").select("id", "pos", "role", F.md5("text").alias("digest"))
