"""Queries over certificates: verification, structure, generation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import proofs, provers, vocab
from ..functions.terms import show
from ..operators import certs as R
from ..operators import search as P
from ..operators import verify as V
from ..operators.latex import proof_documents
from ..sources.files import cert_text, read_buffer, write_records
from .tables import BASELINE, STEPS, TRACES, events, steps, traces

QUERIES, ORACLE = {}, {}
#: Checks over the seeds and curated patterns alone.  They read no table, so they aren't among the queries; tests run them.
FIXED = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def fixed(f):
    FIXED[f.__name__] = f
    return f


# ---- certificates themselves


@fixed
def seeds(spark, sf):
    """The 23 seed goals: shape, depth, and whether they are out of distribution by label and by shape."""
    known = F.broadcast(V.curated(spark, 1).select("shape").distinct().withColumn("known", F.lit(True)))  # 20 shapes
    out = V.seed_certs(spark).join(known, "shape", "left")
    return out.select(F.col("cert_id").alias("label"), "shape", F.col("depth").cast("long").alias("depth"), F.col("cert_id").isin(proofs.OOD_LABELS).alias("ood_label"), F.col("known").isNull().alias("ood_shape"))


@fixed
def gold_verify(spark, sf):
    """Verdict of every seed's proof."""
    return V.verify_tokens(V.seed_certs(spark), strict=True).select("cert_id", "verdict", "open_hyps")


@fixed
def prefix_theorems(spark, sf):
    """Every theorem that the seeds' proofs derive on the way."""
    return V.prefix_theorems(V.seed_certs(spark)).select("cert_id", "step_id", F.array_join("hyps", "; ").alias("hyps"), "concl")


@fixed
def prefix_verdicts(spark, sf):
    """Verdict of every prefix of the seeds' proofs, and of one step more than there are."""
    prefixes = V.seed_certs(spark).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("depth") + 1)))
    return V.prefix_verdicts(prefixes).select("cert_id", "k", "ok", "concl")


@fixed
def grammar_accept(spark, sf):
    """Grammar acceptance of the seeds' proofs and of the same cut in half."""
    full = V.seed_certs(spark).select("cert_id", "cert_toks")
    half = full.select(F.concat("cert_id", F.lit("/half")).alias("cert_id"), F.slice("cert_toks", F.lit(1), (F.size("cert_toks") / 2).cast("int")).alias("cert_toks"))
    return V.grammar(full.unionByName(half)).select("cert_id", "accepted", "taken", F.size("allowed_next").alias("n_allowed"))


@fixed
def curated_corpus(spark, sf):
    """200 instances of each curated pattern, with shape and length."""
    out = V.with_native_columns(V.curated(spark, 200))
    return out.select("cert_id", "shape", "length", (F.array_join("rule_shape", "-") == F.col("shape")).alias("shape_from_tokens"))


@fixed
def gen_walks(spark, sf):
    """Random derivations and their verdicts."""
    walks = V.generate(spark, 400, 6)
    return walks.join(V.verify_tokens(walks, strict=True), "cert_id").select("cert_id", "shape", "depth", "verdict")


def _goals(spark):
    """Goals of the seeds and the statement on primes, as text."""
    goals = [(label, show(make().cert().concl)) for label, make in proofs.SEEDS.items()]
    return spark.createDataFrame([*goals, ("euclid", show(provers.EUCLID))], "goal_id string, goal string")


@fixed
def goal_search(spark, sf):
    """Best-first search for every seed, guided by the curated corpus' counts; what is found is replayed."""
    seeds = _goals(spark).where("goal_id <> 'euclid'")
    return P.search(seeds, V.counts(V.curated(spark, 20))).select("goal_id", "solved", "shape", "calls", "depth")


@fixed
def goal_sample(spark, sf):
    """Flat sampling for every seed."""
    seeds = _goals(spark).where("goal_id <> 'euclid'")
    return P.search(seeds, V.counts(V.curated(spark, 20)), method="sample", seed=1).select("goal_id", "solved", "shape", "calls", "depth")


@fixed
def prove_goals(spark, sf):
    """The first prover, in order, that proves each goal, with a store that holds two of the proofs."""
    kept = ["conj_assoc", "comp_imp"]
    seeds = [(label, cert_text(proofs.SEEDS[label]().cert())) for label in kept]
    keys = P.keyed(_goals(spark), provers.euclid_theory).where(F.col("goal_id").isin(kept))
    cache = keys.join(F.broadcast(spark.createDataFrame(seeds, "goal_id string, cert string")), "goal_id").select("key", "cert")  # two rows
    out = P.prove(_goals(spark), ["lookup", "scripted", "enumerator", "search"], cache, theory=provers.euclid_theory)
    return out.select("goal_id", "prover")


@fixed
def goal_subterms(spark, sf):
    """Token subterms of every seed's goal."""
    return P.subterms(V.seed_certs(spark)).select("cert_id", "place", F.array_join("toks", " ").alias("toks"))


@fixed
def walk_probes(spark, sf):
    """Reach of each rule in walks of which half open with a kit: steps that made it possible, took it and kept it."""
    steps = V.probes(spark, 400, 6, kit=0.5).select(F.explode("steps").alias("s")).where("NOT s.kit")
    seen = steps.select(F.explode("s.applicable").alias("rule"), "s.sampled", "s.apply_ok")
    taken = F.col("sampled") == F.col("rule")
    return seen.groupBy("rule").agg(F.count(F.lit(1)).alias("applicable"), F.count_if(taken).alias("sampled"), F.count_if(taken & F.col("apply_ok")).alias("applied"))


@fixed
def fed_back_walks(spark, sf):
    """A second batch of walks, weighed by the counts of the first; by rule, its steps in both."""
    first = V.generate(spark, 200, 6)
    second = V.generate(spark, 200, 6, seed=1, weight=V.feedback(first))
    both = first.withColumn("batch", F.lit(0)).unionByName(second.withColumn("batch", F.lit(1)))
    rules = both.select("batch", F.explode(F.split("shape", "-")).alias("rule"))
    return rules.groupBy("rule").agg(F.count_if(F.col("batch") == 0).alias("first"), F.count_if(F.col("batch") == 1).alias("second"))


@fixed
def syntactic_rewards(spark, sf):
    """Rewards by form alone: the seeds' proofs and the same cut in half."""
    full = V.seed_certs(spark)
    half = full.withColumn("cert_id", F.concat("cert_id", F.lit("/half"))).withColumn("cert_toks", F.slice("cert_toks", F.lit(1), (F.size("cert_toks") / 2).cast("int")))
    return V.syntactic(full.unionByName(half), bonus=1.0)


@fixed
def template_verdicts(spark, sf):
    """Certificates from templates by shape: how many there are, replay, and are right in form."""
    made = V.templates(spark, 2000)
    judged = made.join(V.verify_tokens(made), "cert_id").join(V.grammar(made).select("cert_id", "accepted"), "cert_id")
    return judged.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == 100).alias("replayed"), F.count_if("accepted").alias("well_formed"))


@fixed
def gen_variants(spark, sf):
    """Three renamed variants of each seed, and their verdicts."""
    out = V.variants(V.seed_certs(spark), 3)
    return out.join(V.verify_tokens(out, strict=True), "cert_id").select("cert_id", "shape", "verdict")


@fixed
def proof_trace(spark, sf):
    """A LaTeX document for every seed's proof."""
    return proof_documents(V.seed_certs(spark)).select("cert_id", F.length("tex").alias("n_chars"), F.md5("tex").alias("tex_md5"))


@fixed
def buffer_scan(spark, sf):
    """Seeds written as a buffer of JSON lines and read back with its schema and defaults."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="prooflake-")
    path = f"{root.rstrip('/')}/buffer-{uuid.uuid4().hex}"
    write_records(V.seed_certs(spark).select("goal_toks", "cert_toks", F.lit("curated").alias("source")), path)
    out = read_buffer(spark, path, same_source={"curated": "corpus"})
    return out.select("source", "discovered_round", F.size("goal_toks").alias("goal_len"), F.size("cert_toks").alias("cert_len"), F.array_join(vocab.rule_shape(F.col("cert_toks").cast("array<int>")), "-").alias("shape"))


# ---- structure: relational checks

_PR = f"""{STEPS}, st AS (SELECT user_id || '/' || d AS cid, pos AS id, rule FROM steps),
pr AS (SELECT s.user_id || '/' || s.d AS cid, s.pos AS id, CAST(regexp_extract(e.props, '"k": ([0-9]+)', 1) AS BIGINT) AS p FROM steps s JOIN events e USING (event_id))"""


def _cited(spark, sf):
    """Steps of event traces, and as premises the position that an event's properties name."""
    st = steps(spark, sf).select(F.concat_ws("/", "user_id", "d").alias("cid"), F.col("pos").alias("id"), "rule", "pos", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("long").alias("p"))
    return st.drop("p"), st.select("cid", "id", "p")


@query(f"WITH {_PR} SELECT s.cid, s.id, s.rule, pr.p, e.rule AS premise_rule FROM st s JOIN pr ON s.cid = pr.cid AND s.id = pr.id JOIN st e ON e.cid = s.cid AND e.id = pr.p AND e.id < s.id")
def premise_join(spark, sf):
    """Each step with the latest earlier step of the ids that it cites."""
    return R.premise_join(*_cited(spark, sf))


@query(f"WITH {_PR} SELECT cid, id, p FROM pr ANTI JOIN (SELECT DISTINCT cid, id AS p FROM st) x USING (cid, p)")
def dangling_premises(spark, sf):
    """Citations of steps that don't exist."""
    return R.dangling(*_cited(spark, sf))


@query(
    f"""WITH a AS (SELECT user_id, event_type AS name, min(CAST(ts AS DATE)) AS since FROM events WHERE CAST(ts AS DATE) <= DATE '{BASELINE}' GROUP BY ALL)
SELECT e.event_id, e.event_type AS name, since, since IS NOT NULL AS declared FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.name = e.event_type WHERE CAST(e.ts AS DATE) > DATE '{BASELINE}'"""
)
def axiom_lookup(spark, sf):
    """Citations and whether what they name is declared: a user's first events of a type declare it, later ones cite it."""
    e = events(spark, sf).select("event_id", "user_id", F.col("event_type").alias("name"), "d")
    declared = e.where(F.col("d") <= BASELINE).groupBy("user_id", "name").agg(F.min("d").alias("since"))
    return R.declared(e.where(F.col("d") > BASELINE), declared, ["user_id", "name"]).select("event_id", "name", "since", "declared")


_RULES = ", ".join(f"('{r}', '{vocab.SIGNATURES[r][0]}', {vocab.SIGNATURES[r][1]})" for r in vocab.RULES)
_NAMES = [*vocab.RULES, "NOPE"]
_KINDS = sorted({kind for kind, _ in vocab.SIGNATURES.values()})


@query(
    f"""WITH r(rule, kind, n) AS (VALUES {_RULES}), s AS (SELECT event_id, {_NAMES}[event_id % {len(_NAMES)} + 1] AS rule,
{_KINDS}[event_id // {len(_NAMES)} % {len(_KINDS)} + 1] AS witness_kind, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) % 3 AS premises FROM events)
SELECT event_id, s.rule, coalesce(r.kind = s.witness_kind AND r.n = s.premises, false) AS ok FROM s LEFT JOIN r ON r.rule = s.rule"""
)
def witness_kind_check(spark, sf):
    """Whether steps have the witness and as many premises as their rule takes; events stand for steps."""

    def dealt(names, k):
        return F.element_at(F.array(*map(F.lit, names)), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))

    k, premises = F.col("event_id"), F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("long") % 3
    s = events(spark, sf).select("event_id", dealt(_NAMES, k).alias("rule"), dealt(_KINDS, F.floor(k / len(_NAMES))).alias("witness_kind"), premises.alias("premises"))
    r = F.broadcast(vocab.rules_table(spark).withColumnRenamed("witness_kind", "kind"))  # 23 rows
    return s.join(r, "rule", "left").select("event_id", "rule", F.coalesce((F.col("kind") == F.col("witness_kind")) & (F.col("arity") == F.col("premises")), F.lit(False)).alias("ok"))


# ---- pairings of steps, on event traces: a step's rule is its left side, the next step's rule its right side

_SIDES = f"{STEPS}, s AS (SELECT user_id, d, pos, rule, coalesce(lead(rule) OVER (PARTITION BY user_id, d ORDER BY pos), 'end') AS nxt, floor(value / 10) AS ty FROM steps)"


def _sides(spark, sf):
    from pyspark.sql import Window

    nxt = F.coalesce(F.lead("rule").over(Window.partitionBy("user_id", "d").orderBy("pos")), F.lit("end"))
    return steps(spark, sf).select("user_id", "d", "pos", "rule", nxt.alias("nxt"), F.floor(F.col("value") / 10).alias("ty"))


@query(f"WITH {_SIDES} SELECT a.user_id, a.d, a.pos AS a, b.pos AS b FROM s a JOIN s b ON a.user_id = b.user_id AND a.d = b.d AND a.nxt = b.rule AND a.pos <> b.pos")
def trans_pairs(spark, sf):
    """Pairs of different steps whose right and left sides are equal."""
    return R.equal_pairs(_sides(spark, sf), "nxt", "rule", ["user_id", "d"])


@query(f"WITH {_SIDES} SELECT a.user_id, a.d, a.pos AS a, b.pos AS b FROM s a JOIN s b ON a.user_id = b.user_id AND a.d = b.d AND a.rule = b.nxt AND a.pos <> b.pos")
def mp_match(spark, sf):
    """Implications with the steps that conclude their antecedent."""
    return R.equal_pairs(_sides(spark, sf), "rule", "nxt", ["user_id", "d"])


@query(f"WITH {_SIDES} SELECT a.user_id, a.d, a.pos AS a, b.pos AS b FROM s a JOIN s b ON a.user_id = b.user_id AND a.d = b.d AND a.nxt = b.rule AND a.pos <> b.pos WHERE a.rule = 'view' AND b.rule <> 'view'")
def eqmp_match(spark, sf):
    """Equations (views) with the steps, not equations themselves, that conclude their side."""
    s = _sides(spark, sf).withColumn("nxt", F.when(F.col("rule") == "view", F.col("nxt"))).withColumn("rule", F.when(F.col("rule") != "view", F.col("rule")))
    return R.equal_pairs(s, "nxt", "rule", ["user_id", "d"])


@query(f"WITH {_SIDES} SELECT a.user_id, a.d, a.pos AS a, b.pos AS b FROM s a JOIN s b ON a.user_id = b.user_id AND a.d = b.d AND a.ty = b.ty AND a.pos <> b.pos")
def mkcomb_pairs(spark, sf):
    """Pairs of different steps whose types fit."""
    return R.equal_pairs(_sides(spark, sf), "ty", "ty", ["user_id", "d"])


@query(f"WITH {TRACES} SELECT user_id, d, CAST(n * (n - 1) AS BIGINT) AS pairs, CAST(len([x FOR x IN rules IF x = 'view']) * (len([x FOR x IN rules IF x = 'view']) - 1) AS BIGINT) AS view_pairs FROM traces")
def conj_pairs(spark, sf):
    """Ordered pairs of different steps that conjunction could join, counted: any two go together, so none is listed."""
    v = F.size(F.filter("rules", lambda x: x == "view")).cast("long")
    return traces(spark, sf).select("user_id", "d", (F.col("n") * (F.col("n") - 1)).alias("pairs"), (v * (v - 1)).alias("view_pairs"))
