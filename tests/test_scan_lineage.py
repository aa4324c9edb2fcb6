"""Recurrences, automata and lineage against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prooflake import shared
from prooflake.operators import certs, lineage, scan
from prooflake.operators import patterns as P


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables would be put into one partition, without a boundary to carry anything over."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(n, users, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(users), k, rng.choice("abc"), rng.choice([None, rng.random() * 10])) for k in rng.sample(range(10 * n), n)]


SCHEMA = "u string, t long, s string, v double"
ORDERED = lambda data: sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


@pytest.mark.parametrize("users", [["x"], [None], ["x", "y", None], [f"u{k}" for k in range(300)], ["hot"] * 50 + [f"u{k}" for k in range(50)]])
def test_moving_average_by_key(spark, users):
    data = rows(3000, users)
    want, held = {}, {}
    for u, t, _, v in ORDERED(data):
        held[u] = held.get(u, 2.0) if v is None else 0.8 * held.get(u, 2.0) + (1 - 0.8) * v
        want[u, t] = held[u]
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = {(r.u, r.t): r.average for r in scan.moving_average(df, ["u"], ["t"], "v", 0.8, 2.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_moving_average_over_batches_and_of_nothing(spark):
    data = rows(2500, ["x", "y"], 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {(r.u, r.t): r.average for r in scan.moving_average(spark.createDataFrame(data, SCHEMA), ["u"], ["t"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for u, t, _, v in ORDERED(data):
        held[u] = held.get(u, 0.0) if v is None else 0.9 * held.get(u, 0.0) + 0.1 * v
        assert abs(got[u, t] - held[u]) < 1e-9
    assert scan.moving_average(spark.createDataFrame([], SCHEMA), ["u"], ["t"], "v").collect() == []


PATTERNS = [
    (P.seq(P.some(P.kind("a")), P.kind("b")), "a+b"),
    (P.many(P.either(P.seq(P.kind("a"), P.kind("b")), P.kind("c"))), "(ab|c)*"),
    (P.seq(P.many(P.anything()), P.kind("a"), P.anything(), P.kind("b")), ".*a.b"),
    (P.seq(P.kind("c"), P.many(P.anything())), "c.*"),
    (P.many(P.many(P.kind("a"))), "a*"),
]


@pytest.mark.parametrize(("pattern", "regex"), PATTERNS)
def test_automata_equal_regular_expressions(pattern, regex):
    table, other, accepts = P.automaton(pattern)
    rng = random.Random(5)
    for _ in range(2000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(8)))
        s = 0
        for x in word:
            s = table[s].get(x, other[s])
        assert accepts[s] == bool(re.fullmatch(regex, word)), word


def test_states_of_one_hot_trace_and_of_many(spark):
    table, other, accepts = P.automaton(PATTERNS[2][0])
    for users in (["x"], [f"u{k}" for k in range(200)]):
        data = rows(2000, users, 9)
        got = {(r.u, r.t): accepts[r.state] for r in scan.run_automaton(spark.createDataFrame(data, SCHEMA).repartition(5), ["u"], ["t"], "s", table, other).collect()}
        word = {}
        for u, t, s, _ in ORDERED(data):
            word[u] = word.get(u, "") + s
            assert got[u, t] == bool(re.search("a.b$", word[u]))


def test_a_trace_of_everything_is_spread(spark):
    df = spark.range(20_000).select(F.lit("x").alias("u"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
    folders = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(scan, "kept", lambda df, name: folders.append(out := shared.kept(df, name)) or out)
        got = {r.t: r.average for r in scan.moving_average(df, ["u"], ["t"], "v", 0.5).collect()}
    parts = folders[0].groupBy("__part").count().collect()
    assert len(parts) == 7 and max(r["count"] for r in parts) < 6_000
    assert all(abs(got[t] - (1 - 0.5 ** (t + 1))) < 1e-12 for t in range(20_000))


def test_latest_rows(spark):
    data = rows(1500, ["x", "y"], 3)
    needs = {"a": "a", "b": "a", "c": "b"}
    ids = {(u, t): k for k, (u, t, _, _) in enumerate(data)}
    df = spark.createDataFrame([(u, t, s, ids[u, t]) for u, t, s, _ in data], "u string, t long, s string, id long")
    got = {r.id: r.cites for r in scan.latest_rows(df, ["u"], ["t"], "id", "s", ["a", "b", "c"], needs).collect()}
    last = {}
    for u, t, s, _ in ORDERED(data):
        assert got[ids[u, t]] == last.get((u, needs[s]))
        last[u, s] = ids[u, t]


# ---- lineage


def test_a_chain_of_thousands_and_a_star(spark):
    n = 5000
    chain = [(k, k - 1 if k else None, 1 << (k % 3)) for k in range(n)]
    star = [(10_000 + k, 10_000 if k else None, 8) for k in range(500)] + [(20_000, 99_999, 16), (20_001, 20_000, 1)]
    got = {r.id: (r.root, r.depth, r["mask"]) for r in lineage.lineage(spark.createDataFrame(chain + star, "id long, parent long, mask long"), mask="mask").collect()}
    assert len(got) == len(chain) + len(star)
    assert all(got[k][:2] == (0, k) for k in range(n)) and got[0][2] == 1 and got[1][2] == 3 and got[n - 1][2] == 7
    assert got[10_321] == (10_000, 1, 8) and got[20_001] == (20_000, 1, 17)
    assert lineage.lineage(spark.createDataFrame([], "id long, parent long")).collect() == []


def test_a_cycle_is_told(spark):
    with pytest.raises(ValueError, match="cycle"):
        lineage.lineage(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, parent long"))


def test_closure_of_any_graph(spark):
    rng = np.random.default_rng(6)
    edges = {(g, int(a), int(b)) for g in range(3) for a, b in rng.integers(0, 25, (30, 2))}
    got = {tuple(r) for r in lineage.closure(spark.createDataFrame([*edges, *edges], "g int, id int, p int"), ["g"]).collect()}
    want, old = set(edges), None
    while want != old:
        old = set(want)
        want |= {(g, a, d) for g, a, b in old for h, c, d in edges if g == h and b == c}
    assert got == want
    assert lineage.closure(spark.createDataFrame([], "g int, id int, p int"), ["g"]).collect() == []


def test_live_steps(spark):
    steps = spark.createDataFrame([(1, k, k, f"r{k}") for k in range(100)] + [(2, 7, 0, "z")], "cid int, id int, pos int, rule string")
    premises = spark.createDataFrame([(1, k, k - 2) for k in range(2, 100)], "cid int, id int, p int")
    assert {(r.cid, r.id) for r in certs.live_steps(steps, premises).collect()} == {(1, k) for k in range(1, 100, 2)} | {(2, 7)}


@pytest.mark.parametrize("users", [["x"], ["x", "y", None], [f"u{k}" for k in range(300)]])
def test_lineage_of_latest_rows_in_one_pass(spark, users, monkeypatch):
    """Doubling wrote and shuffled every row again in each round."""
    data = [(u, t, random.Random(t).choice("abcde"), v) for u, t, _, v in rows(2000, users, 6)]
    needs, masks = {"a": "a", "b": "a", "c": "b", "e": "d"}, {"a": 1, "b": 2, "c": 4, "d": 8, "e": 16}
    want, held = {}, {}
    for u, t, s, _ in ORDERED(data):
        latest = held.setdefault(u, {})
        before = latest.get(needs.get(s))
        got = (before[0], before[1] + 1, before[2] | masks[s]) if before else (t, 0, masks[s])
        want[t], latest[s] = got, got
    written = []
    monkeypatch.setattr(scan, "kept", lambda df, name: written.append(name) or shared.kept(df, name))
    mask = F.element_at(F.create_map(*(F.lit(x) for kv in masks.items() for x in kv)), F.col("s"))
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    met = scan.latest_lineage(df, ["u"], ["t"], "t", "s", list("abcd"), {k: v for k, v in needs.items() if k != "e"}, mask)
    got = {r.t: (r.root, r.depth, r["mask"]) for r in met.collect()}
    assert got == {t: (t, 0, 16) if x[2] & 16 else x for t, x in want.items()} and written == ["scan"]
