import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from prooflake.llm import importance, line_dedup, oracle, whitening
from prooflake.llm.scratch import Scratch

LOWER = {i: i + 32 for i in range(65, 91)}


def same_as_sql(df, sql, views):
    con = duckdb.connect()
    for name, source in views.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)


# ---- lines


def plain_lines(rows, least=40, at_least=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    top = {k: max(h, key=lambda i: (i is not None, i or 0)) for k, h in holders.items() if len(h) >= at_least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LONG_LINE = "x" * 39 + "Y"
LINES = [
    *((i, f"own line {i} that nobody else has, really nobody\n  {LONG_LINE}\t\r\n\nend") for i in range(20, 27)),
    (7, None), (8, ""), (9, "\n\n"), (9, LONG_LINE), (10, f"{LONG_LINE}\n{LONG_LINE}\n"), (10, f"{LONG_LINE}\n{LONG_LINE}\n"),
    (30, "\n".join([LONG_LINE.lower()] * 3)), (30, "z"), (None, LONG_LINE), (None, f"a\n{LONG_LINE}"),
    *((40 + i, "four documents share this line of forty and more\n" + "É" * 41) for i in range(4)), *((50, "only one document, many rows, one shared line here") for _ in range(7)),
    *((60 + i, "É" * 39 + "\n" + "é" * 41 + "\n\x85" + "n" * 39) for i in range(6)),
]


def digest(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()), key=str)


def test_lines_equal_sql_and_plain_python(spark, sf, frame, table):
    same_as_sql(line_dedup.op11_line_dedup(spark, sf), oracle.LINE_DEDUP, {"documents": f"{sf}/documents.parquet"})
    got = line_dedup.op11_line_dedup(spark, table(frame(LINES)))
    assert sorted(map(tuple, got.collect()), key=str) == plain_lines(LINES)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_do_not_depend_on_batches(spark, frame, batches):
    rng = random.Random(batches)
    pool = [f"line number {k} of a pool, long enough to count as one" for k in range(30)]
    rows = [(rng.randrange(60), "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for _ in range(150)] + LINES
    assert digest(line_dedup.dedup_lines(spark, frame(rows), batches=batches)) == plain_lines(rows)


def test_lines_of_an_empty_table_and_of_long_texts(spark, frame):
    assert line_dedup.dedup_lines(spark, frame([])).collect() == []
    many = "\n".join(f"one of a great many lines, every document has it {i}" for i in range(40_000))
    rows = [(i, many + f"\n{i}") for i in range(6)]
    began = time.time()
    assert digest(line_dedup.dedup_lines(spark, frame(rows))) == plain_lines(rows)
    assert time.time() - began < 60


def test_lines_keep_the_callers_row(spark):
    names = ["doc_id", "text", "row", "x", "gone", "of", "of_x", "pos", "h", "g", "n", "holder", "batch", "k", "kept", "n_lines"]
    df = spark.createDataFrame([(1, "a", *range(len(names) - 2))], "doc_id int, text string, " + ", ".join(f"{c} int" for c in names[2:]))
    r = line_dedup.dedup_lines(spark, df).first()
    assert r.kept == "a" and r.row.asDict() == dict(zip(names, [1, "a", *range(len(names) - 2)]))


def test_runs_are_levelled_and_known_lines_have_no_new_holder(spark):
    keep = Scratch(spark, "runs")
    runs = line_dedup.LineRuns(spark, keep.path("x"), fanout=2, buckets=3)

    def add(rows):
        return runs.add(spark.createDataFrame(rows, "h long, g long, n long, top long"))

    def rows(name):
        return sorted(tuple(r) for r in spark.table(name).collect())

    def shape():
        return [len(x) for x in runs.levels]

    assert rows(add([(1, 1, 2, 90), (2, 2, 1, 80)])) == [(1, 1, 2, 90), (2, 2, 1, 80)] and shape() == [1]
    add([(1, 1, 3, 70), (3, 3, 1, 60)])  # the first is known
    assert shape() == [0, 1] and rows(runs.runs()[0]) == [(1, 1, 5, 90), (2, 2, 1, 80), (3, 3, 1, 60)]
    assert sorted(rows(add([(3, 3, 4, 50), (3, 4, 1, 50)])), key=str) == [(3, 3, 4, None), (3, 4, 1, 50)]
    assert shape() == [1, 1] and sorted(tuple(r) for r in runs.totals().collect()) == [(1, 1, 5, 90), (2, 2, 1, 80), (3, 3, 5, 60), (3, 4, 1, 50)]
    add([(9, 9, 1, 1)])
    assert shape() == [0, 0, 1]
    batch = spark.createDataFrame([(1, 1, 1, 1)], "h long, g long, n long, top long")
    joined = batch.repartition(3, "h", "g").join(spark.table(runs.runs()[0]).hint("merge"), ["h", "g"], "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # the batch moves, the run doesn't
    runs.forget()


# ---- whitening


def check_whitening(rows, got):
    part = [(i, [math.floor(64.0 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id, r.component].append(r)
    if not part:
        assert not got
        return
    fit = sorted({tuple(x) for _, x in part})
    n, dims = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(16, int((e > e[0] * 1e-12).sum()))
    assert len(got) == len(part) * k
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in part}
    sign = {}
    for i, x in part:
        z = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ v[:, :k] / np.sqrt(e[:k])
        for c in range(k):
            r = by_id[i, c + 1][0]
            assert r.n == n and r.deviation == deviation[i] and r.identity_error <= 1e-9
            assert abs(r.explained - e[c] / np.trace(cov)) <= 1e-9 * r.explained
            if abs(z[c]) > 1e-3:
                sign.setdefault(c, 1 if (r.whitened > 0) == (z[c] > 0) else -1)
                assert abs(r.whitened - sign[c] * z[c]) < 1e-6 * max(1, abs(z[c])), (i, c)


def test_whitening(spark, sf, tmp_path):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(rows, whitening.op12_whitening(spark, sf).collect())
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(5, 3, 6) * [9, 4, 2, 1, 0.5, 0.1]]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(500)]  # a hot vector is fitted once
    rows += [(3, rows[3][1]), (2000, None), (2001, []), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, rows[0][1])]
    schema = "vec_id long, embedding array<double>, y array<double>, n long, component int, d long"
    spark.createDataFrame([(*r, r[1], 1, 2, 3) for r in rows], schema).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    check_whitening(rows, whitening.op12_whitening(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_of_nothing_to_fit(spark, rows):
    df, _, error = whitening.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert df.collect() == [] and error == 0


def test_whitening_without_full_rank_and_of_mixed_lengths(spark):
    rng = np.random.default_rng(2)
    flat = [(i, [float(a), float(2 * a), 7.0]) for i, a in enumerate(rng.integers(-50, 50, 200))]
    df, found, error = whitening.whiten(spark, spark.createDataFrame([*flat, (900, [1.0]), (901, [1.0, 2.0, 3.0, 4.0])], "vec_id long, embedding array<double>"))
    assert len(found.values) == 1 and error < 1e-9 and {r.vec_id for r in df.collect()} == set(range(200))


def test_huge_entries(spark):
    rows = [(i, [float(x) * 2.0**38 for x in v]) for i, v in enumerate(np.random.default_rng(1).integers(-100, 100, (50, 3)))]
    df, found, error = whitening.whiten(spark, spark.createDataFrame([*rows, (99, [1e300] * 3)], "vec_id long, embedding array<double>"))
    got = df.collect()
    assert found.n == 50 and error < 1e-9 and all(r.deviation is None for r in got) and 99 not in {r.vec_id for r in got}


def test_moments_merge_to_those_of_the_whole():
    rng = np.random.default_rng(7)
    values = rng.integers(10**9, 10**9 + 50, (1000, 5))
    whole = whitening.Moments.of(values)
    held = whitening.Moments(0, np.zeros(0, object), np.zeros((0, 0)))
    for part in np.split(values, [1, 17, 500, 500, 999]):
        held = held.merged(whitening.Moments.of(part))
    assert held.n == 1000 and list(held.sums) == list(whole.sums)
    centred = values - values.mean(axis=0)
    assert np.allclose(held.covariance(), centred.T @ centred / 1000, rtol=1e-9)


# ---- resampling


def plain_resample(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own, s, t = [], Counter(), Counter()
    for i, text in docs:
        n, f = found(text)
        own.append((i, n, f))
        s.update(f)
    for text in target:
        t.update(found(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def many(n, seed=1):
    rng = random.Random(seed)
    pool = ["eau", "Ére", "le", "the", "x" * 60, "y" * 200, "12", "a'b", "naïve", "日本", "😀", "end."]
    return [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(n)]


def drawn(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_sql(spark, sf):
    sf = sf.replace("0.001", "0.01")
    same_as_sql(importance.op13_importance_resampling(spark, sf), oracle.RESAMPLE, {t: f"{sf}/{t}.parquet" for t in ("documents", "benchmark")})


@pytest.mark.parametrize(("longest", "run_rows", "range_rows"), [(1, 1 << 18, 250_000), (2, 50, 37), (3, 7, 1000), (1, 1000, 5)])
def test_resampling_equals_plain_python(spark, frame, longest, run_rows, range_rows):
    docs = [*many(900), (9000, None), (9001, ""), (9002, " \t "), (None, "the " * 30), (9003, "the x" * 20_000), (5, "le " * 25)]
    target = ["the end of the eau", None, "", "a'b 日本 " * 5]
    texts = spark.createDataFrame([(k, t, 3) for k, t in enumerate(target)], "item_id long, text string, bucket int")
    got = importance.resample(spark, frame(docs).repartition(6), texts, longest=longest, run_rows=run_rows, range_rows=range_rows)
    assert drawn(got) == plain_resample(docs, target, longest)


def test_resampling_of_ties_repeats_and_nothing(spark, frame):
    same = [(4, "word " * 25)] * 300 + many(100)
    texts = spark.createDataFrame([(0, "word")], "item_id long, text string")
    got = drawn(importance.resample(spark, frame(same).repartition(5), texts, run_rows=40, range_rows=16))
    assert got == plain_resample(same, ["word"])
    none = spark.createDataFrame([], "item_id long, text string")
    assert drawn(importance.resample(spark, frame([]), texts)) == [] and drawn(importance.resample(spark, frame(many(50)), none)) == plain_resample(many(50), [])


def test_tournament_merges_sorted_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((rng.randrange(50), rng.randrange(3), rng.randrange(9)) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(importance.Tournament(runs)) == sorted(x for r in runs for x in r)


def test_crc_of_slices():
    data = np.frombuffer(random.Random(3).randbytes(3000), np.uint8)
    starts = np.array([0, 5, 5, 100, 2999, 3000, 40])
    ends = np.array([0, 6, 5 + 47, 2000, 3000, 3000, 40 + 49])
    got = importance.crc_over(np.full(7, 0xFFFFFFFF, np.uint32), data, starts, ends) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
