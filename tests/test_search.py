"""Search, provers, probes, feedback, resampling and the sinks that go with them."""

import itertools
from collections import Counter

import pytest

from prooflake.functions import kernel as K
from prooflake.functions import proofs as P
from prooflake.functions import provers as R
from prooflake.functions import search as S
from prooflake.functions import tokens as T
from prooflake.functions.terms import BOOL, NAT, alpha_key, mk_eq, mk_quant, show
from prooflake.operators import sampling, verify
from prooflake.operators import search as Q
from prooflake.plans import QUERIES
from prooflake.plans.certificates import FIXED
from prooflake.sources import files

TH = P.number_theory()
#: Counts of the curated units, as searches over tables are guided by.
POLICY = Counter((i, s.rule) for unit in P.PATTERNS for i, s in enumerate(unit(0).cert().steps))
SEARCHED = ["refl_x", "imp_p", "prime_imp_prime", "conj_proj_left", "k_combinator", "gcd_refl", "disj_imp_self", "spec_twice"]


@pytest.mark.parametrize("label", SEARCHED)
def test_best_first(label):
    goal = P.SEEDS[label]().cert().concl
    found = S.best_first(goal, TH, POLICY)
    assert found.cert is not None and K.verify(found.cert, goal, TH, True)[0] == 100
    assert found.calls <= S.Limits().calls and [s.id for s in found.cert.steps] == list(range(len(found.cert.steps)))


def test_search_ends_within_its_limits():
    false = mk_eq(P.v("x"), P.v("y"))
    for limits in (S.Limits(calls=50), S.Limits(steps=1), S.Limits(calls=0)):
        a, b = S.best_first(false, TH, {}, limits), S.flat_sample(false, TH, {}, limits)
        assert a.cert is None and b.cert is None and max(a.calls, b.calls) <= limits.calls and max(a.depth, b.depth) <= limits.steps


def test_flat_sample_is_reproducible():
    goal = P.SEEDS["imp_p"]().cert().concl
    a, b = (S.flat_sample(goal, TH, {}, S.Limits(samples=400), 5) for _ in range(2))
    assert a == b and a.cert is not None and K.verify(a.cert, goal, TH, True)[0] == 100


def test_policy_orders_rules():
    scores = S.rule_scores({(2, "DISCH"): 50.0}, 2)
    assert scores[0][0] == "DISCH" and S.rule_scores({(2, "DISCH"): 50.0}, 1)[0][1] == S.rule_scores({}, 0)[0][1]
    assert len({round(x, 9) for _, x in S.rule_scores({(2, "DISCH"): 50.0}, 2, mix=1.0)}) == 1


def test_emitted_steps_replay():
    p, goal = P.Proof(), S.Goal(P.SEEDS["conj_proj_left"]().cert().concl)
    s, t = S.emit(p, goal, "ASSUME")
    assert s.rule == "ASSUME" and t.hyps and S.emit(p, goal, "CONJUNCT1") is None and S.emit(p, goal, "TRANS", P.Draws(1, 1)) is None


def test_token_subterms():
    for make in P.SEEDS.values():
        goal, _, header = T.encode_pair(make().cert().concl, make().cert())
        got = S.token_subterms(goal)
        brackets = [goal[i:j] for i, j in itertools.combinations(range(len(goal) + 1), 2) if goal[i] == T.L and goal[j - 1] == T.R and _balanced(goal[i:j])]
        assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in brackets} <= {tuple(x) for x in got}
        assert all(x[0] == T.L or x[1] == T.COLON for x in got)
    assert S.token_subterms([]) == [] and S.token_subterms([T.R, T.L]) == []


def _balanced(toks):
    depth = 0
    for i, t in enumerate(toks):
        depth += (t == T.L) - (t == T.R)
        if depth == 0 and i < len(toks) - 1:
            return False
    return depth == 0


def test_places_of_rules_and_witnesses():
    for make in P.SEEDS.values():
        stack, rules, kinds = T.START, 0, 0
        cert, _ = T.encode_cert(make().cert())
        for t in cert:
            rules += T.chooses_rule(T.allowed(stack))
            kinds += T.chooses_witness(T.allowed(stack))
            stack = T.advance(stack, t)
        n = len(make().cert().steps)
        assert rules == n and kinds == sum(s.witness[0] != "none" for s in make().cert().steps)


def test_recognisers():
    renamed = mk_quant("!", "a", NAT, mk_quant("?", "b", NAT, P.both(R._call("gt", P.v("b"), P.v("a")), R._call("prime", P.v("b")))))
    assert R.is_euclid(renamed) and not R.is_euclid(mk_quant("!", "n", NAT, P.prop("p")))
    lam = lambda n: ("\\", n, NAT, P.v(n))
    assert R.is_reflexive(mk_eq(lam("x"), lam("y"))) and not R.is_reflexive(mk_eq(P.v("x"), P.v("y"))) and not R.is_reflexive(P.prop("p"))


def test_scripted_needs_its_axioms():
    th = R.euclid_theory()
    c = next(R.scripted(R.EUCLID, th, S.Limits(), []))
    assert K.verify(c, R.EUCLID, th, True)[0] == 100 and len(c.steps) == 12
    assert list(R.scripted(R.EUCLID, TH, S.Limits(), [])) == [] and list(R.scripted(P.prop("p"), th, S.Limits(), [])) == []


def test_first_prover(spark, sf):
    got = {r.goal_id: r.prover for r in FIXED["prove_goals"](spark, sf).collect()}
    assert len(got) == 24 and got["euclid"] == "scripted" and got["refl_x"] == "enumerator" and got["conj_assoc"] == got["comp_imp"] == "lookup"
    assert got["imp_p"] == "search" and got["eq_trans_impl"] in (None, "search")


def test_order_store_and_bad_entries(spark, tmp_path):
    goals = spark.createDataFrame([("a", show(mk_eq(P.v("x"), P.v("x")))), ("b", "(((" ), ("c", None), ("d", show(mk_eq(P.v("x"), P.v("y"))))], "goal_id string, goal string")
    out = Q.prove(goals, ["enumerator", "search"], limits=S.Limits(calls=200))
    path = str(tmp_path / "store")
    Q.store(out, path)
    Q.store(out, path)
    kept = Q.read_store(spark, path)
    assert {r.goal_id: r.prover for r in out.collect()} == {"a": "enumerator", "b": None, "c": None, "d": None} and kept.count() == 1
    again = Q.prove(goals, ["lookup", "enumerator"], kept)
    assert {r.goal_id: r.prover for r in again.collect()} == {"a": "lookup", "b": None, "c": None, "d": None}
    # a store that holds something else under the key isn't believed
    from pyspark.sql import functions as F

    wrong = kept.withColumn("cert", F.lit(files.cert_text(P.SEEDS["imp_p"]().cert())))
    assert {r.goal_id: r.prover for r in Q.prove(goals, ["lookup", "enumerator"], wrong).collect()}["a"] == "enumerator"
    with pytest.raises(ValueError):
        Q.prove(goals, ["oracle"])


def test_key_is_up_to_bound_names(spark):
    goals = [("a", show(mk_quant("!", "x", BOOL, P.prop("x")))), ("b", show(mk_quant("!", "y", BOOL, P.prop("y"))))]
    got = Q.keyed(spark.createDataFrame(goals, "goal_id string, goal string")).collect()
    assert got[0].key == got[1].key and alpha_key(P.prop("x")) != alpha_key(P.prop("y"))


def test_searches_over_seeds(spark, sf):
    tree = {r.goal_id: r for r in FIXED["goal_search"](spark, sf).collect()}
    assert len(tree) == 23 and all(tree[x].solved for x in SEARCHED) and all(r.calls <= 2000 for r in tree.values())
    flat = FIXED["goal_sample"](spark, sf).collect()
    assert len(flat) == 23 and sum(r.solved for r in flat) >= 3
    assert FIXED["goal_subterms"](spark, sf).count() > 23


def test_probes_change_nothing(spark):
    for k in range(60):
        x = {}
        a, b = P.walk(4, k, 6, kit=0.5, probe=x), P.walk(4, k, 6, kit=0.5)
        assert a == b and x["completed_shape"] == ([s.rule for s in a.steps] if a else [])
        if a:
            taken = [s for s in x["steps"] if s[4]]
            assert [s[3] for s in taken] == x["completed_shape"][: len(taken)] and all(s[3] in s[1] for s in taken if not s[6])
    lengths = set()
    for k in range(60):
        P.walk(4, k, 6, kit=1.0, probe=(x := {}))
        lengths.add(sum(s[6] for s in x["steps"]))
    assert lengths == {1, 2, 3}


def test_walks_reach_every_rule():
    seen = Counter(s.rule for k in range(600) if (c := P.walk(0, k, 7, kit=0.5)) for s in c.steps)
    assert set(seen) == set(P.WALK_RULES)


def test_probe_and_novel_records(spark, tmp_path):
    got = verify.probes(spark, 20, 5, kit=0.5)
    path = str(tmp_path / "probe")
    files.write_records(got, path)
    assert sorted(map(str, files.read_probes(spark, path).collect())) == sorted(map(str, got.collect()))
    from pyspark.sql import functions as F

    novel = verify.seed_certs(spark).select(F.lit(1).alias("round"), F.col("cert_id").alias("seed_label"), F.split("shape", "-").alias("shape"), F.col("goal_toks").cast("array<smallint>").alias("goal_toks"), F.col("cert_toks").cast("array<smallint>").alias("cert_toks"))
    path = tmp_path / "novel"
    assert not files.append_novel(novel.where("false"), str(path)) and not path.exists()
    assert files.append_novel(novel, str(path)) and files.read_novel(spark, str(path)).count() == 23


def test_feedback_evens_the_rules_out(spark, sf):
    first = verify.generate(spark, 100, 5)
    weight = verify.feedback(first)
    assert weight and all(0 < w <= 0.5 for w in weight.values()) and weight[max(verify.counts(first), key=verify.counts(first).get)] == min(weight.values())
    got = {r.rule: r for r in FIXED["fed_back_walks"](spark, sf).collect()}
    assert sum(r.second for r in got.values()) > 0
    assert all(r.applied <= r.sampled <= r.applicable for r in FIXED["walk_probes"](spark, sf).collect())


def test_rewards_by_form(spark, sf):
    got = {r.cert_id: r.reward for r in FIXED["syntactic_rewards"](spark, sf).collect()}
    assert len(got) == 46 and all(x == (-1.0 if k.endswith("/half") else 101.0) for k, x in got.items())
    a, b = (r.asDict(recursive=True) for r in verify.seed_certs(spark).where("cert_id IN ('refl_x', 'imp_p')").collect())
    other = spark.createDataFrame([{**a, "goal_toks": b["goal_toks"]}], verify.seed_certs(spark).schema)
    assert verify.syntactic(other, wrong=2.0).first().reward == 2.0


def test_certificate_files(spark, tmp_path):
    path = str(tmp_path / "certs")
    files.write_texts(Q.cert_texts(verify.seed_certs(spark)), path)
    got = files.read_certs(spark, path, P.number_theory).where("error IS NULL")
    assert got.select("path").distinct().count() == 23 and got.count() == sum(len(m().cert().steps) for m in P.SEEDS.values())


def test_draws_follow_the_weights(spark):
    rows = spark.createDataFrame([(1, 1000), (2, 2000), (3, 0), (4, None), (5, 1)] + [(k, 3) for k in range(10, 110)], "id int, w int")
    got = Counter(r.id for r in sampling.resampled(rows, "id", "w", 6000, 3).collect())
    assert sum(got.values()) == 6000 and not {3, 4, None} & set(got)
    assert abs(got[1] - 6000 * 1000 / 3301) < 200 and abs(got[2] - 6000 * 2000 / 3301) < 200
    assert sampling.resampled(rows.where("false"), "id", "w", 10, 3).count() == 0


def test_waits_double_up_to_a_ceiling():
    from prooflake.streaming import ingest

    assert list(itertools.islice(ingest.waits(), 8)) == [1, 2, 4, 8, 16, 32, 64, 64]


def test_restarts(spark):
    from pyspark.errors import StreamingQueryException

    from prooflake.streaming import ingest

    class Run:
        left, slept = 2, []

        def awaitTermination(self):
            if Run.left:
                Run.left -= 1
                raise StreamingQueryException("lost")

    assert ingest.restarting(Run, sleep=Run.slept.append) == 2 and Run.slept == [1, 2]
    Run.left = 5
    with pytest.raises(StreamingQueryException):
        ingest.restarting(Run, limit=1, sleep=Run.slept.append)


def test_swap_recovers(spark, tmp_path):
    path = tmp_path / "t"
    files.replace_atomically(spark.range(3).toDF("x"), str(path))
    path.rename(tmp_path / "t.bak")  # stopped between the renames
    files.replace_atomically(spark.range(5).toDF("x"), str(path))
    assert spark.read.json(str(path)).count() == 5 and spark.read.json(str(path) + ".bak").count() == 3


def test_every_rule_has_right_and_wrong_certificates(spark, sf):
    from prooflake.plans import verdicts
    from prooflake.functions.vocab import RULES

    assert set(verdicts.FAMILIES) >= set(RULES) - {"ETA_AX", "SELECT_AX", "EM_AX"}
    assert {r.verdict for r in QUERIES["rule_verdicts"](spark, sf).select("verdict").distinct().collect()} == {100, 0, -1}


def test_templates(spark, sf):
    got = {r.shape: r for r in FIXED["template_verdicts"](spark, sf).collect()}
    assert len(got) == 9 and sum(r.n for r in got.values()) == 2000 and all(r.well_formed == r.n for r in got.values())
    bad = {k for k, r in got.items() if r.replayed < r.n}
    assert bad <= {"BETA", "REFL-EXISTS"} and got["ASSUME-DISCH-GEN"].replayed == got["ASSUME-DISCH-GEN"].n
    assert P.template(1, 5) == P.template(1, 5)
