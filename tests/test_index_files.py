"""The key index against a set, and step files written, read, streamed and aborted."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prooflake.operators.keyindex import KeyIndex
from prooflake.sources import trace_files as T

# ---- key index


def test_an_index_equals_a_set(spark, tmp_path):
    rng, seen = random.Random(1), set()
    index = KeyIndex(spark, f"{tmp_path}/i", ["a", "b"], buckets=8)
    for turn in range(5):
        batch = [(rng.choice([None, "", "x", "y"]), rng.choice([None, *range(6 * (turn + 1))])) for _ in range(40)]
        df = spark.createDataFrame(batch, "a string, b long")
        want = set(batch) - seen
        assert {tuple(r) for r in index.new(df).collect()} == want
        assert sorted(map(tuple, index.add(df).collect()), key=str) == sorted(want, key=str)
        seen |= want
        assert index.new(df).collect() == []
        if turn == 3:
            index.compact()
            assert len(index.table.entry(index.table.versions()[-1])["folders"]) == 1
    assert {tuple(r) for r in index.table.read().select("a", "b").collect()} == seen


def test_a_batch_reads_only_the_buckets_it_may_hit(spark, tmp_path):
    index = KeyIndex(spark, f"{tmp_path}/i", ["k"], buckets=64)
    index.add(spark.range(20_000).select(F.col("id").alias("k")))
    fresh = index.new(spark.range(1_000_000, 1_000_500).select(F.col("id").alias("k")))
    assert fresh.count() == 500 and len(index.touched) < 32  # filters of 16,384 bits with about 300 keys of 4 bits
    one = index.new(spark.range(3).select(F.lit(77).cast("long").alias("k")))
    assert one.count() == 0 and len(index.touched) == 1
    plan = index.table.read().where(F.col("__bucket").isin(index.touched))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan or "PartitionFilters: [(__bucket" in plan or "PartitionFilters: [__bucket" in plan


def test_a_failed_append_leaves_the_keys_as_they_were(spark, tmp_path):
    index = KeyIndex(spark, f"{tmp_path}/i", ["k"])
    index.add(spark.range(5).select(F.col("id").alias("k")))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(index.table, "_put", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(spark.range(10).select(F.col("id").alias("k")))
    again = KeyIndex(spark, f"{tmp_path}/i", ["k"])
    assert sorted(r.k for r in again.add(spark.range(10).select(F.col("id").alias("k"))).collect()) == [5, 6, 7, 8, 9]


# ---- step files

ROWS = [(1, 0, "user", 'a "quoted" \\ text\nover\r\nlines'), (1, 1, None, None), (2, None, "bot", ""), (None, 3, "bot", "é 😀 (step 1 2)"), (-7, 9, "user", "\\n stays"), (500, 1, "user", "x" * 3_000_000)]


@pytest.fixture
def steps(spark):
    T.register(spark)
    return lambda rows: spark.createDataFrame(rows, T.SCHEMA)


def read(spark, path):
    return spark.read.format("steps").load(path)


def test_round_trip_and_appends(spark, steps, tmp_path):
    path = f"{tmp_path}/s"
    steps(ROWS).repartition(3).write.format("steps").mode("append").save(path)
    assert sorted(map(tuple, read(spark, path).collect()), key=str) == sorted(ROWS, key=str)
    steps([(9, 9, "z", "z")]).write.format("steps").mode("append").save(path)
    assert read(spark, path).count() == len(ROWS) + 1
    steps(ROWS[:2]).write.format("steps").mode("overwrite").save(path)
    assert sorted(map(tuple, read(spark, path).collect()), key=str) == sorted(ROWS[:2], key=str)
    assert read(spark, f"{tmp_path}/none").count() == 0


def test_filters_reach_the_reader(spark, steps, tmp_path):
    path = f"{tmp_path}/s"
    for k in range(4):
        steps([(10 * k + i, i % 3, "ab"[i % 2], f"{k}/{i}") for i in range(10)]).write.format("steps").mode("append").save(path)
    plain = steps([tuple(r) for r in read(spark, path).collect()])
    for test in ("id = 12", "id >= 35", "id < 3 AND pos = 1", "role = 'a' AND id > 27", "pos > 1", "id IS NULL", "text = '1/2'", "role > 'a'"):
        assert sorted(read(spark, path).where(test).collect()) == sorted(plain.where(test).collect()), test
    reader = T.Reader(path, 1)
    left = list(reader.pushFilters([T.EqualTo(("id",), 12), T.EqualTo(("text",), "x")]))
    assert len(left) == 1 and len(reader.partitions()) == 1 and len(list(reader.read(reader.partitions()[0]))) == 1


def test_an_aborted_write_leaves_nothing(spark, steps, tmp_path):
    path = f"{tmp_path}/s"
    steps(ROWS[:1]).write.format("steps").mode("append").save(path)
    bad = F.when(F.col("id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("role"))
    many = spark.range(400).select("id", F.col("id").alias("pos"), F.lit("r").alias("role"), F.lit("t").alias("text")).repartition(4).withColumn("role", bad.cast("string"))
    with pytest.raises(Exception, match="stop"):
        many.write.format("steps").mode("append").save(path)
    assert [tuple(r) for r in read(spark, path).collect()] == ROWS[:1] and T.newest(path) == 1
    named = {f["name"] for f in T.listed(path)}
    writer = T.Writer(path, False)
    made = writer.write(iter(ROWS[:2]))
    assert (Path(path) / made.name).exists()
    writer.abort([made, None])
    assert not (Path(path) / made.name).exists() and {f["name"] for f in T.listed(path)} == named


def test_a_stream_takes_each_list_once(spark, steps, tmp_path):
    path, out, check = f"{tmp_path}/s", f"{tmp_path}/out", f"{tmp_path}/check"

    def run():
        spark.readStream.format("steps").load(path).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)

    steps(ROWS[:2]).write.format("steps").mode("append").save(path)
    assert run() == sorted(ROWS[:2], key=str)
    steps(ROWS[2:4]).write.format("steps").mode("append").save(path)
    steps(ROWS[4:]).write.format("steps").mode("append").save(path)
    assert run() == sorted(ROWS, key=str) == run()


def test_other_columns_and_other_lines_are_refused(spark, steps, tmp_path):
    with pytest.raises(Exception, match="columns are"):
        spark.range(1).write.format("steps").mode("append").save(f"{tmp_path}/a")
    path = f"{tmp_path}/s"
    steps(ROWS[:1]).write.format("steps").mode("append").save(path)
    file = Path(path) / T.listed(path)[0]["name"]
    file.write_text("(step nonsense)\n")
    with pytest.raises(Exception, match="not a step"):
        read(spark, path).collect()
