"""Files, sinks, token expressions and streaming ingestion."""

import json

import pytest
from pyspark.sql import functions as F

from prooflake.functions import kernel, proofs, vocab
from prooflake.functions.terms import LogicError, show
from prooflake.operators import latex, verify
from prooflake.operators.corpus import new_rows
from prooflake.sources import files
from prooflake.streaming import ingest

PHI = '(type "pt" 0)\n; a comment\n(const "c" "pt -> bool")\n(axiom "ax" "(! x : pt. (c x))")\n(odd 1)\n(goal "p")\n(goal "(x:ind = x:ind)") trailing'
THY = "# numbers\ntype pt 0\nconst c : pt -> bool\naxiom ax : (! x : pt. (c x))\ntheorem t : (x:pt = x:pt)  # last\n"
#: What is done to the text of a sound proof: (old, new).
DAMAGE = {
    "cites_itself": ("(premises 2 1)", "(premises 3 1)"),
    "cites_a_later_step": ("CONJUNCT1) (witness ()) (premises 0)", "CONJUNCT1) (witness ()) (premises 4)"),
    "takes_the_wrong_half": ("rule CONJUNCT2", "rule CONJUNCT1"),
    "joins_in_the_wrong_order": ("(premises 2 1)", "(premises 1 2)"),
    "discharges_something_else": ('(rule DISCH) (witness (term "(a:bool /\\\\ b:bool)"))', '(rule DISCH) (witness (term "(b:bool /\\\\ a:bool)"))'),
    "assumes_no_proposition": ('(rule ASSUME) (witness (term "(a:bool /\\\\ b:bool)"))', '(rule ASSUME) (witness (term "n:ind"))'),
    "projects_an_implication": ("(rule CONJ)", "(rule MP)"),
    "claims_the_converse": ('(concl "((a:bool /\\\\ b:bool) ==> (b:bool /\\\\ a:bool))")', '(concl "((b:bool /\\\\ a:bool) ==> (a:bool /\\\\ b:bool))")'),
}


@pytest.mark.parametrize("name", DAMAGE)
def test_damaged_certificates_are_refused(name):
    sound = files.cert_text(proofs.SEEDS["conj_swap"]().cert())
    goal = proofs.SEEDS["conj_swap"]().cert().concl
    assert kernel.verify(files.cert_of_text(sound), goal)[0] == kernel.ACCEPTED
    old, new = DAMAGE[name]
    assert old in sound
    assert kernel.verify(files.cert_of_text(sound.replace(old, new)), goal)[0] == kernel.REJECTED


def test_prefix_verdicts(spark):
    sound = proofs.SEEDS["conj_swap"]().cert()
    rows = [verify._row("sound", sound)]
    broken = files.cert_of_text(files.cert_text(sound).replace("(rule CONJ)", "(rule MP)"))
    rows.append(verify._row("broken", broken))
    df = spark.createDataFrame([(a, b, c, tuple(d.values()), e, f) for a, b, c, d, e, f in rows], verify._GENERATED)
    ks = df.withColumn("k", F.explode(F.array(*(F.lit(x) for x in (-1, 0, 1, 3, 4, 5, 6)), F.lit(None).cast("int"))))
    got = {(r.cert_id, r.k): r for r in verify.prefix_verdicts(ks).collect()}
    assert {k for (c, k), r in got.items() if c == "sound" and r.ok} == {0, 1, 3, 4, 5}
    assert {k for (c, k), r in got.items() if c == "broken" and r.ok} == {0, 1, 3}
    assert got["sound", 3].concl == "b:bool" and got["broken", 4].reason and got["sound", 0].concl is None


def test_the_mask_takes_a_bare_equation_sign():
    from prooflake.functions import tokens
    from prooflake.functions.vocab import OPERATORS

    eq = OPERATORS["="]
    assert eq in tokens.allowed(("term",)) and tokens.advance(("term",), eq) == ()
    stack = ("term",)
    for t in (tokens.L, eq, eq):  # (= = ...: the sign applied to an argument comes first, then an operator
        stack = tokens.advance(stack, t)
    assert stack is not None


def test_sexp():
    assert files.read_sexp(' ; c\n(a (b "x\\"y\\n\\\\") ()) rest)') == ["a", ["b", 'x"y\n\\'], []]
    for bad in ("(a", ")", ""):
        with pytest.raises(LogicError):
            files.read_sexp(bad)


def test_declarations_and_theories(spark, tmp_path):
    (tmp_path / "phi.kf").write_text(PHI.replace(" trailing", ""))
    (tmp_path / "t.thy").write_text(THY)
    kf = files.read_decls(spark, f"{tmp_path}/phi.kf", "kf").collect()
    assert [(r.kind, r.name, r.arity) for r in kf] == [("type", "pt", 0), ("const", "c", None), ("axiom", "ax", None), ("unknown", "odd", None), ("goal", "goal", None)]
    assert kf[-1].body == "(x:ind = x:ind)"
    thy = files.theory_decls(THY)
    th = files.theory_of(thy)
    assert show(th.axioms["ax"]) == "(! x : pt. (c x:pt))"
    again = files.goal_decls(files.goal_text(thy, "(x:pt = x:pt)"))
    assert [d[:3] for d in again] == [d[:3] for d in thy[:3]] + [("goal", "goal", None)]
    assert files.read_decls(spark, f"{tmp_path}/t.thy", "thy").count() == 4
    for bad in ("lemma x : y", "const c nat"):
        with pytest.raises(LogicError):
            files.theory_decls(bad)


def test_certificate_files(spark, tmp_path):
    for label in ("conj_swap", "beta_inst_identity"):
        (tmp_path / f"{label}.cert").write_text(files.cert_text(proofs.SEEDS[label]().cert()))
    (tmp_path / "broken.cert").write_text("(cert (step")
    got = files.read_certs(spark, f"{tmp_path}/*.cert", proofs.number_theory).collect()
    assert sum(r.error is not None for r in got) == 1
    assert sorted(r.rule for r in got if r.rule) == sorted(["ASSUME", "CONJUNCT1", "CONJUNCT2", "CONJ", "DISCH", "BETA", "INST"])


def test_records(spark, tmp_path):
    path = f"{tmp_path}/buffer.jsonl"
    lines = [{"goal_toks": [1], "cert_toks": [2], "source": "curated", "discovered_round": 3}, {"goal_toks": [1], "cert_toks": [4]}]
    with open(path, "w") as f:
        f.write("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    got = files.read_buffer(spark, path).collect()
    assert sorted((r.source, r.discovered_round) for r in got) == [("corpus", 0), ("curated", 3)]
    assert files.read_buffer(spark, path, same_source={"curated": "corpus"}).select("source").distinct().count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_buffer(spark, path, "FAILFAST").collect()
    assert files.read_buffer(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        files.read_records(spark, path, "a int", "SKIP")


def test_append_and_replace(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for _ in range(2):
        files.append_new(df, path, ["k"])
    assert spark.read.json(path).count() == 2
    files.replace_atomically(spark.createDataFrame([(9, "z")], "k long, v string"), path)
    assert [r.k for r in spark.read.json(path).collect()] == [9] and spark.read.json(path + ".bak").count() == 2
    with pytest.raises(FileExistsError):
        files.replace_atomically(df, path)
    files.write_eval_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["k", "v"]


def test_requests(spark):
    df = spark.createDataFrame([("2 168 6 3 4 29 5",), ("P 4 1 9 2 7 8 H a  b",)], "value string")
    a, b = files.parse_requests(df).collect()
    assert (a.goal_toks, a.cert_toks, a.prefix, a.names) == ([168, 6], [4, 29, 5], None, None)
    assert (b.goal_toks, b.cert_toks, b.prefix, b.names) == ([9], [7, 8], 4, ["a", "b"])


def test_token_expressions(spark):
    df = verify.with_native_columns(verify.seed_certs(spark))
    for r in df.collect():
        assert "-".join(r.rule_shape) == r.shape and r.length == len(r.goal_toks) + len(r.cert_toks) + 3
        assert r.input == ([0, *r.goal_toks, 0, *r.cert_toks, 1][:320])[:-1]
        assert len(r.labels) == len(r.input) and set(r.labels[: len(r.goal_toks) + 1]) == {vocab.PAD} and r.labels[len(r.goal_toks) + 1] == 4
    one = df.where("cert_id = 'conj_swap'").select(
        vocab.texts(F.col("cert_toks")).alias("t"), vocab.has_step(F.col("cert_toks")).alias("s"), vocab.infer_header(F.col("cert_toks")).alias("h"), vocab.has_step(F.array().cast("array<int>")).alias("e"),
        vocab.wrap_cert(F.array(F.lit(1)), F.array(F.lit(2))).alias("w"), vocab.override_names(F.array(F.lit("v0"), F.lit("v1")), F.array(F.lit("q"))).alias("o"),
    ).first()
    assert one.t.startswith("( cert ( step 0 ( rule ASSUME )") and one.s and not one.e and one.h.vars == ["v0", "v1"] and one.o == ["q", "v1"]
    assert one.w == [4, 29, 1, 4, 34, 9, 2, 9, 5, 5]
    toks = vocab.vocab_table(spark).withColumn("head", vocab.is_type_head(F.col("token_id"))).withColumn("slot2", vocab.slot(F.col("token_id"), "var")).withColumn("r", vocab.rule_name(F.col("token_id"))).collect()
    assert sum(t.head for t in toks) == 20 and [t.slot2 for t in toks if t.cls == "var"] == list(range(32)) and [t.r for t in toks if t.cls == "rule"] == vocab.RULES


def test_malformed_tokens_are_minus_one(spark):
    rows = verify.seed_certs(spark).where("cert_id = 'imp_p'").withColumn("cert_toks", F.concat(F.slice("cert_toks", 1, 5), F.array(F.lit(231))))
    assert verify.verify_tokens(rows).first().verdict == -1
    assert verify.decoded_steps(verify.seed_certs(spark)).count() == 75
    assert verify.prefix_theorems(verify.seed_certs(spark), 1).count() == 23


def test_documents(spark):
    tex = {r.cert_id: r.tex for r in latex.proof_documents(verify.seed_certs(spark)).collect()}
    assert r"p \Rightarrow p" in tex["imp_p"] and "CONJUNCT1" in tex["conj_swap"] and tex["gcd_refl"].count(r"\mathrm{gcd}") >= 2
    assert all(t.startswith(r"\documentclass") and t.endswith(r"\end{document}") for t in tex.values())


def test_streaming_ingest_is_replay_safe(spark, tmp_path):
    source, sink, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    seeds = verify.seed_certs(spark).select("goal_toks", "cert_toks", F.lit("corpus").alias("source"), F.lit(0).alias("discovered_round"))
    seeds.write.json(source)
    ingest.ingest(spark, source, sink, check).awaitTermination()
    n = seeds.dropDuplicates(["goal_toks", "cert_toks"]).count()
    assert spark.read.json(sink).count() == n
    seeds.limit(5).write.mode("append").json(source)  # known already
    more = verify.curated(spark, 2).select("goal_toks", "cert_toks", F.lit("synthetic").alias("source"), F.lit(1).alias("discovered_round"))
    more.write.mode("append").json(source)
    ingest.ingest(spark, source, sink, check).awaitTermination()
    ingest.ingest(spark, source, sink, check).awaitTermination()
    known = seeds.unionByName(more).select(F.col("goal_toks").cast("array<int>"), F.col("cert_toks").cast("array<int>")).distinct().count()
    assert spark.read.json(sink).count() == known
    left = new_rows(more, seeds, ["goal_toks", "cert_toks"], ["source"]).count()
    assert left == known - n


def test_streaming_counts(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/events").schema).parquet(f"{tmp_path}/events")
    out = ingest.windowed_counts(events, "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_refused_and_long_entries_stay_out(spark, tmp_path):
    source, sink, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    rows = [([1], [2], "a", 0), ([1], [2], "b", 1), ([3], [4], "refused", 0), ([5], [6] * 400, "long", 0), ([7], [8], "a", 0)]
    spark.createDataFrame(rows, "goal_toks array<smallint>, cert_toks array<smallint>, source string, discovered_round int").write.json(source)
    ingest.ingest(spark, source, sink, check, lambda df: df.where("source <> 'refused'")).awaitTermination()
    got = spark.read.json(sink)
    assert sorted((r.goal_toks, r.cert_toks) for r in got.collect()) == [([1], [2]), ([7], [8])]
    ingest.ingest(spark, source, sink, check).awaitTermination()
    assert spark.read.json(sink).count() == 2


def test_declarations_become_goal_files_and_come_back(spark, sf, tmp_path):
    from prooflake.plans.structure import decls

    odd = [("odd", k, *x) for k, x in enumerate([("goal", "goal", None, "early"), ("type", 'a"b', 2, None), ("const", "c\\\\d", None, "line\n\ttab"), ("unknown", "u", None, "x"), ("axiom", "none", None, None), ("goal", "goal", None, "x = \"y\"")])]
    rows = decls(spark, sf).where("kind IS NOT NULL").unionByName(spark.createDataFrame(odd, "file string, pos long, kind string, name string, arity int, body string"))
    rows = rows.where("file = 'odd' OR file LIKE '1%'")
    files.write_goal_files(rows, f"{tmp_path}/goals")
    found = {}
    for r in files.read_decls(spark, f"{tmp_path}/goals/*", "kf").collect():
        found.setdefault(r.path.split("/file=")[1].split("/")[0], []).append((r.kind, r.name, r.arity, r.body))
    want = {}
    for r in rows.orderBy("pos").collect():
        if r.kind == "type" and r.arity is not None:
            want.setdefault(r.file, []).append((r.kind, r.name, r.arity, None))
        elif r.kind in ("const", "axiom") and r.body is not None:
            want.setdefault(r.file, []).append((r.kind, r.name, None, r.body))
    for r in rows.where("kind = 'goal'").groupBy("file").agg(F.max_by("body", "pos").alias("body")).collect():
        want.setdefault(r.file, []).append(("goal", "goal", None, r.body))
    assert len(want) > 20 and found == want
