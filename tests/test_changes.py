"""Versioned tables, views under removals and keyed state against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prooflake.operators.views import CountView, novelty
from prooflake.sources.versions import Conflict, Versions
from prooflake.streaming import state as S


# ---- versions


def values(df):
    return sorted(r.k for r in df.collect())


def test_versions(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        v.read()
    one, two = spark.range(3).toDF("k"), spark.range(10, 12).toDF("k")
    assert v.commit(one) == 1 and v.commit(two, append=True) == 2 and v.commit(two) == 3
    assert values(v.read(1)) == [0, 1, 2] and values(v.read(2)) == [0, 1, 2, 10, 11] and values(v.read()) == [10, 11]
    assert v.clean(2) == 0 and v.versions() == [2, 3] and v.clean(1) == 2 and values(v.read()) == [10, 11]
    assert v.commit(spark.range(0).toDF("k")) == 4 and values(v.read()) == []


@pytest.mark.parametrize("step", ["_write", "_publish", "_put", "half"])
def test_a_crash_at_any_step_leaves_the_version_before(spark, tmp_path, step):
    root = f"{tmp_path}/t"
    v = Versions(spark, root)
    v.commit(spark.range(3).toDF("k"))
    reader = v.read()

    class Crash(Exception):
        pass

    def crash(*a):
        raise Crash

    with pytest.MonkeyPatch.context() as m:
        if step == "half":  # some files are there, the job isn't
            m.setattr(v, "_write", lambda df, folder: (df.limit(1).write.parquet(f"{root}/data/{folder}"), crash()))
        else:
            m.setattr(v, step, crash)
        with pytest.raises(Crash):
            v.commit(spark.range(100, 104).toDF("k"))
    assert values(reader) == [0, 1, 2] and values(Versions(spark, root).read()) == [0, 1, 2] and v.versions() == [1]
    assert v.commit(spark.range(5, 6).toDF("k")) == 2 and values(v.read()) == [5]
    v.clean(1)
    assert values(v.read()) == [5] and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_two_writers_from_one_version(spark, tmp_path):
    a, b = (Versions(spark, f"{tmp_path}/t") for _ in range(2))
    a.commit(spark.range(1).toDF("k"))
    a.commit(spark.range(2).toDF("k"), base=1)
    with pytest.raises(Conflict):
        b.commit(spark.range(3).toDF("k"), base=1)
    assert values(b.read()) == [0, 1] and b.versions() == [1, 2]
    assert b.commit(spark.range(3).toDF("k"), append=True, base=2) == 3


# ---- views


@pytest.mark.parametrize("fold_every", [1, 3, 100])
def test_a_view_equals_a_recount(spark, tmp_path, fold_every):
    rng = random.Random(fold_every)
    view = CountView(spark, f"{tmp_path}/v", ["a", "b"], fold_every)
    live, sizes = [], []
    for turn in range(6):
        new = [(rng.choice("xyz"), rng.choice([None, 1, 2])) for _ in range(rng.randrange(1, 60))]
        gone = rng.sample(live, len(live) // 2) if turn % 2 else []
        rows = [(*r, 1) for r in new] + [(*r, -1) for r in gone]
        number = view.change(spark.createDataFrame(rows, "a string, b int, sign int"), F.col("sign"))
        for r in gone:
            live.remove(r)
        live += new
        assert {(r.a, r.b): r.n for r in view.read().collect()} == dict(Counter(live))
        sizes.append(len(view.table.entry(number)["folders"]))
    assert max(sizes) <= fold_every


def test_a_removal_before_its_row_and_novelty(spark, tmp_path):
    view = CountView(spark, f"{tmp_path}/v", ["shape", "baseline"])
    row = spark.createDataFrame([("s", True), ("t", False), ("t", True), ("u", False)], "shape string, baseline boolean")
    view.change(row.where("shape = 's'"), -1)
    assert view.read().collect() == []
    view.change(row)
    assert sorted(r.shape for r in view.read().collect()) == ["t", "t", "u"]
    assert tuple(novelty(view.read()).first()) == (2, 1)
    view.change(row.where("shape = 't' AND baseline"), -1)
    assert tuple(novelty(view.read()).first()) == (2, 2)


def test_a_change_reads_only_itself(spark, tmp_path):
    view = CountView(spark, f"{tmp_path}/v", ["k"])
    view.change(spark.range(1000).select((F.col("id") % 10).alias("k")))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "v" / "data").iterdir()}
    view.change(spark.range(5).select(F.col("id").alias("k")), -1)
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "v" / "data").iterdir()}
    assert len(after) == 2 and before.items() <= after.items()


# ---- keyed state

HOUR = 3_600_000_000
EVENTS = "ts timestamp, user long, id long, kind string, value double, source string, n int"


def plain_sessions(rows, gap=8 * HOUR):
    """(source, start, last, n, average, pos, rule, count), whether ended or open."""
    out, last = [], {}
    sessions = []
    for t, user, _, kind, value in sorted(rows, key=lambda r: (r[0], r[2])):
        if user not in last or t - last[user]["last"] > gap:
            last[user] = {"user": user, "start": t, "values": [], "n": 0, "counts": Counter(), "day": None, "place": 0}
            sessions.append(last[user])
        s = last[user]
        if t // (24 * HOUR) != s["day"]:
            s["day"], s["place"] = t // (24 * HOUR), 0
        s["counts"][s["place"], kind] += 1
        s["place"], s["last"], s["n"] = s["place"] + 1, t, s["n"] + 1
        if value is not None:
            s["values"].append(value)
    for s in sessions:
        mean = sum(s["values"]) / len(s["values"]) if s["values"] else None
        out += [(s["user"], s["start"], s["last"], s["n"], None if mean is None else round(mean, 6), p, k, c) for (p, k), c in s["counts"].items()]
    return sorted(out)


def test_sessions_over_restarts(spark, tmp_path):
    rng = random.Random(8)
    now, rows = 1_700_000_000_000_000, []
    for i in range(400):
        now += rng.choice([0, 1000, HOUR // 7, HOUR // 2, HOUR, 3 * HOUR])
        rows.append((now, rng.randrange(5), i, rng.choice("abc"), rng.choice([None, float(rng.randrange(100))])))
    rows += [(now + 30 * HOUR + k, 77, 1000 + k, "z", 1.0) for k in range(3)]
    places = [(f"{tmp_path}/{x}") for x in ("in", "out", "check")]

    def start(feed=None):
        if feed is not None:
            df = spark.createDataFrame([(t, u, i, k, v, "x", 1) for t, u, i, k, v in feed], EVENTS.replace("timestamp", "long", 1))
            df.withColumn("ts", F.timestamp_micros("ts")).coalesce(2).write.mode("append").parquet(places[0])
        stream = spark.readStream.schema(EVENTS).parquet(places[0])
        S.run_sessions(stream, places[1], places[2], "user", "id", "kind", "value").awaitTermination()

    def everything():
        got = S.ended_sessions(spark, places[1]).unionByName(S.open_sessions(spark, places[2]))
        return sorted((r.source, r.start, r.last, r.n, None if r.average is None else round(r.average, 6), r.pos, r.rule, r["count"]) for r in got.collect())

    cut = [0, 90, 91, 300, len(rows)]
    for a, b in zip(cut, cut[1:]):
        start(rows[a:b])
        assert everything() == plain_sessions(rows[:b])
    start()  # nothing new: nothing changes
    assert everything() == plain_sessions(rows)
    ended = {(r.source, r.start) for r in S.ended_sessions(spark, places[1]).select("source", "start").distinct().collect()}
    assert {u for u, _ in ended} == set(range(5)) and S.open_sessions(spark, places[2]).select("source").distinct().count() == 1  # the timers ended all others


def test_sessions_ended_at_once_come_in_one_frame():
    """A frame for each session, and several messages for each look at a state, took most of the time."""
    import pandas as pd

    calls = Counter()

    class State(dict):
        def __getattr__(self, name):
            def call(*a):
                calls[name] += 1
                if name == "exists":
                    return bool(self)
                if name in ("get", "getValue"):
                    return dict.get(self, a[0] if a else None)
                if name in ("update", "updateValue"):
                    self.__setitem__(*(a if name == "updateValue" else (None, a[0])))
                return iter(()) if name == "iterator" else None

            return call

        def get(self, *a):
            return self.__getattr__("get")(*a)

        def update(self, *a):
            return self.__getattr__("update")(*a)

    made = S.SourceSessions(10)
    made.handle, made.session, made.counts = State(), State(), State()
    part = pd.DataFrame({"us": [100 * k for k in range(50)], "ident": range(50), "rule": ["a"] * 50, "value": [1.0] * 50})
    frames = list(made.handleInputRows((7,), iter([part]), None))
    assert [len(f) for f in frames] == [49] and frames[0]["start"].tolist() == [100 * k for k in range(49)]
    assert dict.get(made.session, None)[:3] == (4900, 4900, 1) and dict(made.counts) == {(0, "a"): (1,)}
    assert calls["exists"] == calls["containsKey"] == 0
