"""Certificate operators that need trees: Arrow batches in, rows out, nothing collected.

Certificates are small (32 steps at most), so each batch is a loop over rows in one Python worker; partitions give the
parallelism.  Cheap native filters (length caps, duplicates) belong before these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernel, proofs, tokens, vocab
from ..functions.terms import LogicError, Theory, alpha_key, same, show
from ..schemas import HEADER, PROBE

TheoryMaker = Callable[[], Theory]


def _header(h) -> tokens.Header:
    return tokens.Header(*(list(h[k]) if h[k] is not None else [] for k in ("tycons", "tyvars", "names", "vars")))


def verify_tokens(df: DataFrame, theory: TheoryMaker = proofs.number_theory, strict: bool = False) -> DataFrame:
    """(cert_id, verdict, reason, open_hyps) of rows (cert_id, goal_toks, cert_toks, header)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            out = []
            for cid, goal, cert, h in zip(b["cert_id"], b["goal_toks"], b["cert_toks"], b["header"], strict=True):
                try:
                    header = _header(h)
                    g = None if goal is None or not len(goal) else tokens.decode_term(goal, header, th)
                    c = tokens.decode_cert(cert, header, th, strict)
                except (LogicError, RecursionError, TypeError) as e:
                    out.append((cid, kernel.MALFORMED, str(e), -1))
                else:
                    out.append((cid, *kernel.verify(c, g, th, strict)))
            yield pd.DataFrame(out, columns=["cert_id", "verdict", "reason", "open_hyps"])

    return df.select("cert_id", "goal_toks", "cert_toks", "header").mapInPandas(run, "cert_id string, verdict int, reason string, open_hyps int")


def prefix_theorems(df: DataFrame, steps: int | None = None, theory: TheoryMaker = proofs.number_theory) -> DataFrame:
    """(cert_id, step_id, hyps, concl, key) of the first steps of each certificate; none of a failing one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            out = []
            for cid, cert, h in zip(b["cert_id"], b["cert_toks"], b["header"], strict=True):
                try:
                    done = kernel.replay(tokens.decode_cert(cert, _header(h), th), th, steps=steps)
                except (LogicError, RecursionError, TypeError):
                    continue
                out += [(cid, k, [show(x) for x in t.hyps.values()], show(t.concl), alpha_key(t.concl)) for k, t in done]
            yield pd.DataFrame(out, columns=["cert_id", "step_id", "hyps", "concl", "key"])

    return df.select("cert_id", "cert_toks", "header").mapInPandas(run, "cert_id string, step_id int, hyps array<string>, concl string, key string")


def prefix_verdicts(df: DataFrame, theory: TheoryMaker = proofs.number_theory) -> DataFrame:
    """(cert_id, k, ok, reason, concl) of rows (cert_id, cert_toks, header, k): do the first k steps replay?

    concl: the theorem of step k, null for a refused prefix and for k = 0.  A prefix of more steps than there are is
    refused, as is a negative or null one; a certificate that can't be decoded is refused at every k.
    """

    def judged(cert, h, k, th: Theory) -> tuple[bool, str, str | None]:
        try:
            c = tokens.decode_cert(cert, _header(h), th)
            if k is None or pd.isna(k) or not 0 <= k <= len(c.steps):
                return False, f"no prefix of {k} steps", None
            done = kernel.replay(c, th, steps=int(k))
        except (LogicError, RecursionError, TypeError) as e:
            return False, str(e), None
        return True, "", show(done[-1][1].concl) if done else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            out = [(cid, k, *judged(cert, h, k, th)) for cid, cert, h, k in zip(b["cert_id"], b["cert_toks"], b["header"], b["k"], strict=True)]
            yield pd.DataFrame(out, columns=["cert_id", "k", "ok", "reason", "concl"])

    return df.select("cert_id", "cert_toks", "header", "k").mapInPandas(run, "cert_id string, k int, ok boolean, reason string, concl string")


def decoded_steps(df: DataFrame, theory: TheoryMaker = proofs.number_theory) -> DataFrame:
    """(cert_id, pos, step_id, rule, witness_kind, premises): certificates as a relational table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            out = []
            for cid, cert, h in zip(b["cert_id"], b["cert_toks"], b["header"], strict=True):
                try:
                    c = tokens.decode_cert(cert, _header(h), th)
                except (LogicError, RecursionError, TypeError):
                    continue
                out += [(cid, k, s.id, s.rule, s.witness[0], s.premises) for k, s in enumerate(c.steps)]
            yield pd.DataFrame(out, columns=["cert_id", "pos", "step_id", "rule", "witness_kind", "premises"])

    return df.select("cert_id", "cert_toks", "header").mapInPandas(run, "cert_id string, pos int, step_id int, rule string, witness_kind string, premises array<int>")


def grammar(df: DataFrame) -> DataFrame:
    """(cert_id, accepted, taken, allowed_next): grammar acceptance, and the mask after the longest accepted prefix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cid, toks in zip(b["cert_id"], b["cert_toks"], strict=True):
                stack, taken = tokens.START, 0
                for t in toks if toks is not None else ():
                    after = tokens.advance(stack, int(t))
                    if after is None:
                        break
                    stack, taken = after, taken + 1
                n = 0 if toks is None else len(toks)
                out.append((cid, taken == n and stack == (), taken, sorted(tokens.allowed(stack))))
            yield pd.DataFrame(out, columns=["cert_id", "accepted", "taken", "allowed_next"])

    return df.select("cert_id", "cert_toks").mapInPandas(run, "cert_id string, accepted boolean, taken int, allowed_next array<int>")


_GENERATED = f"cert_id string, goal_toks array<int>, cert_toks array<int>, header {HEADER}, shape string, depth int"


def _row(cid: str, c: kernel.Cert) -> tuple | None:
    try:
        goal, cert, h = tokens.encode_pair(c.concl, c)
    except LogicError:
        return None
    head = {"tycons": h.tycons, "tyvars": h.tyvars, "names": h.names, "vars": h.vars}
    return cid, goal, cert, head, "-".join(s.rule for s in c.steps), len(c.steps)


def _frame(rows: list[tuple | None]) -> pd.DataFrame:
    return pd.DataFrame([r for r in rows if r], columns=["cert_id", "goal_toks", "cert_toks", "header", "shape", "depth"])


def generate(spark, n: int, depth: int, seed: int = 0, weight: dict[tuple[int, str], float] | None = None, kit: float = 0.0) -> DataFrame:
    """Random walks 0..n-1, each from its own draws; ``weight`` is one snapshot for the whole batch (bounded: positions
    times rules), so results don't depend on how walks are spread.  ``kit``: the share that opens with a kit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            walks = [(i, proofs.walk(seed, int(i), depth, weight, kit=kit)) for i in b["id"]]
            yield _frame([_row(f"walk{i}", c) for i, c in walks if c is not None])

    return spark.range(n).mapInPandas(run, _GENERATED)


def probes(spark, n: int, depth: int, seed: int = 0, weight: dict[tuple[int, str], float] | None = None, kit: float = 0.0) -> DataFrame:
    """What the same walks could choose and chose, one PROBE record each; the shape is empty where a walk failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["pos", "applicable", "precond", "sampled", "apply_ok", "failures", "kit"]
        for b in batches:
            out = []
            for i in b["id"]:
                proofs.walk(seed, int(i), depth, weight, kit=kit, probe=(x := {}))
                out.append((i, depth, x["completed_shape"], [dict(zip(keys, s, strict=True)) for s in x["steps"]]))
            yield pd.DataFrame(out, columns=["walk_id", "target_depth", "completed_shape", "steps"])

    return spark.range(n).mapInPandas(run, PROBE)


def counts(certs: DataFrame) -> dict[tuple[int, str], float]:
    """Steps by (position, rule), counted by Spark; what comes to the driver is bounded by 32 positions times the rules."""
    steps = certs.select(F.posexplode(F.split("shape", "-")).alias("pos", "rule"))
    return {(r.pos, r.rule): float(r.n) for r in steps.groupBy("pos", "rule").agg(F.count(F.lit(1)).alias("n")).collect()}


def feedback(walks: DataFrame) -> dict[tuple[int, str], float]:
    """Weights for the next batch of walks from the counts of this one: 1 / (1 + count) by position and rule."""
    return {k: 1.0 / (1 + n) for k, n in counts(walks).items()}


def syntactic(df: DataFrame, theory: TheoryMaker = proofs.number_theory, wrong: float = 0.0, bonus: float = 0.0) -> DataFrame:
    """(cert_id, reward) without replaying: -1 off the grammar, 100 for the goal as conclusion, else ``wrong``; the last
    two plus ``bonus`` if there is a step.  A certificate without steps that states the goal passes here."""

    def scored(goal, cert, header, th: Theory) -> float:
        toks = [int(t) for t in cert] if cert is not None else []
        if not tokens.accepts(toks):
            return -1.0
        extra = bonus if vocab.KEYWORDS["step"] in toks else 0.0
        try:
            return extra + (100.0 if same(tokens.decode_cert(toks, header, th).concl, tokens.decode_term(goal, header, th)) else wrong)
        except (LogicError, RecursionError, TypeError):
            return extra + wrong

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            yield pd.DataFrame({"cert_id": b["cert_id"], "reward": [scored(g, c, _header(h), th) for g, c, h in zip(b["goal_toks"], b["cert_toks"], b["header"], strict=True)]})

    return df.select("cert_id", "goal_toks", "cert_toks", "header").mapInPandas(run, "cert_id string, reward double")


def templates(spark, n: int, seed: int = 0) -> DataFrame:
    """n certificates from templates, right in form; some don't replay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([_row(f"template{i}", proofs.template(seed, int(i))) for i in b["id"]])

    return spark.range(n).mapInPandas(run, _GENERATED)


def curated(spark, each: int) -> DataFrame:
    """``each`` instances of every curated pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(proofs.PATTERNS)
        for b in batches:
            yield _frame([_row(f"pattern{i % k}-{i // k}", proofs.PATTERNS[i % k](i // k).cert()) for i in b["id"].tolist()])

    return spark.range(each * len(proofs.PATTERNS)).mapInPandas(run, _GENERATED)


def seed_certs(spark) -> DataFrame:
    """The 23 seed goals with their proofs, as encoded rows (a fixed table)."""
    rows = [_row(label, make().cert()) for label, make in proofs.SEEDS.items()]
    return spark.createDataFrame([(a, b, c, tuple(d.values()), e, f) for a, b, c, d, e, f in rows], _GENERATED)


def variants(df: DataFrame, k: int, theory: TheoryMaker = proofs.number_theory) -> DataFrame:
    """k renamed variants of each certificate (fewer where names run out)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            out = []
            for cid, cert, h in zip(b["cert_id"], b["cert_toks"], b["header"], strict=True):
                c = tokens.decode_cert(cert, _header(h), th)
                made = ((i, proofs.variant(c, i)) for i in range(k))
                out += [_row(f"{cid}~{i}", x) for i, x in made if x is not None]
            yield _frame(out)

    return df.select("cert_id", "cert_toks", "header").mapInPandas(run, _GENERATED)


def with_native_columns(df: DataFrame) -> DataFrame:
    """Adds the expressions that need no tree: rule shape, length, training arrays."""
    x, y = vocab.training_pair(F.col("goal_toks"), F.col("cert_toks"))
    return df.withColumn("rule_shape", vocab.rule_shape(F.col("cert_toks"))).withColumn("length", vocab.pair_length(F.col("goal_toks"), F.col("cert_toks"))).withColumn("input", x).withColumn("labels", y)
