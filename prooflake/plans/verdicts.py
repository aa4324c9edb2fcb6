"""One small certificate for every event, right or wrong by the event's numbers, and the verdict that logic gives it.

``FAMILIES`` names for each inference rule a certificate in two numbers i and j below 4 and, in SQL, when it holds and
how many hypotheses it leaves open.  The query encodes, decodes and replays; the SQL only compares i and j.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions.kernel import SIGNATURES, Cert, Step
from ..functions.proofs import both, imp, prop, v
from ..functions.terms import BOOL, NAT, fun, mk_eq, mk_quant
from ..operators import verify as V
from .tables import table

QUERIES, ORACLE = {}, {}

Steps = list[tuple]  # (rule, premises, *witness)


def _x(i: int):
    return v("abcd"[i])


def _p(i: int):
    return prop("pqrs"[i])


_M, _W, _Z = v("m"), v("w"), prop("z")
_A = ("'", "A")


def _prime(t):
    return ("@", ("c", "prime", fun(NAT, BOOL)), t)


def _function(i: int):
    return v("f", fun(BOOL if i % 2 else NAT, NAT))


#: rule: (steps, conclusion that is claimed, SQL of whether it holds, SQL of the hypotheses left open)
FAMILIES: dict[str, tuple[Callable[[int, int], Steps], Callable[[int, int], tuple], str, str]] = {
    "REFL": (lambda i, j: [("REFL", (), _x(i))], lambda i, j: mk_eq(_x(i), _x(j)), "i = j", "0"),
    "ASSUME": (lambda i, j: [("ASSUME", (), _p(i))], lambda i, j: _p(j), "i = j", "1"),
    "DISCH": (lambda i, j: [("ASSUME", (), _p(i)), ("DISCH", (0,), _p(j))], lambda i, j: imp(_p(j), _p(i)), "true", "CASE WHEN i = j THEN 0 ELSE 1 END"),
    "TRANS": (lambda i, j: [("ASSUME", (), mk_eq(_x(i), _x(j))), ("TRANS", (0, 0))], lambda i, j: mk_eq(_x(i), _x(j)), "i = j", "1"),
    "MK_COMB": (lambda i, j: [("REFL", (), _function(i)), ("REFL", (), _x(j)), ("MK_COMB", (0, 1))], lambda i, j: mk_eq(("@", v("f", fun(NAT, NAT)), _x(j)), ("@", v("f", fun(NAT, NAT)), _x(j))), "i % 2 = 0", "0"),
    "ABS": (lambda i, j: [("ASSUME", (), mk_eq(_x(i), _W)), ("ABS", (0,), *_x(j)[1:])], lambda i, j: mk_eq(("\\", _x(j)[1], NAT, _x(i)), ("\\", _x(j)[1], NAT, _W)), "i <> j", "1"),
    "BETA": (lambda i, j: [("BETA", (), ("@", ("\\", _x(i)[1], NAT, _x(i)), _x(j)))], lambda i, j: mk_eq(("@", ("\\", _x(i)[1], NAT, _x(i)), _x(j)), _x(j)), "i = j", "0"),
    "EQ_MP": (lambda i, j: [("ASSUME", (), mk_eq(_p(i), _Z)), ("ASSUME", (), _p(j)), ("EQ_MP", (0, 1))], lambda i, j: _Z, "i = j", "2"),
    "DEDUCT_ANTISYM_RULE": (lambda i, j: [("ASSUME", (), _p(i)), ("ASSUME", (), _p(j)), ("DEDUCT_ANTISYM_RULE", (0, 1))], lambda i, j: mk_eq(_p(i), _p(j)), "true", "CASE WHEN i = j THEN 0 ELSE 2 END"),
    "INST": (lambda i, j: [("ASSUME", (), _p(i)), ("INST", (0,), [(_p(0), _p(j))])], lambda i, j: _p(j), "i = 0 OR i = j", "1"),
    "INST_TYPE": (lambda i, j: [("REFL", (), v("y", _A)), ("INST_TYPE", (0,), [("A", NAT)])], lambda i, j: mk_eq(v("y", BOOL if i % 2 else NAT), v("y", BOOL if i % 2 else NAT)), "i % 2 = 0", "0"),
    "GEN": (lambda i, j: [("ASSUME", (), mk_eq(_x(i), _W)), ("GEN", (0,), *_x(j)[1:])], lambda i, j: mk_quant("!", _x(j)[1], NAT, mk_eq(_x(i), _W)), "i <> j", "1"),
    "SPEC": (lambda i, j: [("ASSUME", (), mk_quant("!", "m", NAT, mk_eq(_M, _W))), ("SPEC", (0,), _x(i))], lambda i, j: mk_eq(_x(j), _W), "i = j", "1"),
    "EXISTS": (lambda i, j: [("ASSUME", (), _prime(_x(i))), ("EXISTS", (0,), "m", NAT, _x(j))], lambda i, j: mk_quant("?", "m", NAT, _prime(_M)), "i = j", "1"),
    "CONJ": (lambda i, j: [("ASSUME", (), _p(i)), ("ASSUME", (), _p(j)), ("CONJ", (0, 1))], lambda i, j: both(_p(i), _p(j)), "true", "CASE WHEN i = j THEN 1 ELSE 2 END"),
    "CONJUNCT1": (lambda i, j: [("ASSUME", (), both(_p(i), _Z)), ("CONJUNCT1", (0,))], lambda i, j: _p(j), "i = j", "1"),
    "CONJUNCT2": (lambda i, j: [("ASSUME", (), both(_Z, _p(i))), ("CONJUNCT2", (0,))], lambda i, j: _p(j), "i = j", "1"),
    "MP": (lambda i, j: [("ASSUME", (), imp(_p(i), _Z)), ("ASSUME", (), _p(j)), ("MP", (0, 1))], lambda i, j: _Z, "i = j", "2"),
    "CHOOSE": (
        lambda i, j: [("ASSUME", (), mk_quant("?", "m", NAT, _prime(_M))), ("ASSUME", (), _prime(_x(j))), ("EXISTS", (1,), "m", NAT, _x(j)), ("CHOOSE", (0, 2), *_x(i)[1:])],
        lambda i, j: mk_quant("?", "m", NAT, _prime(_M)), "i = j", "1",  # the body has to assume the instance
    ),
    "AXIOM": (lambda i, j: [("AXIOM", (), "undeclared")], lambda i, j: _p(j), "false", "0"),
    "cites ahead": (lambda i, j: [("GEN", (1,), "m", NAT), ("REFL", (), _x(i))], lambda i, j: mk_eq(_x(j), _x(j)), "false", "0"),
    "cut short": (lambda i, j: [("REFL", (), _x(i))], lambda i, j: mk_eq(_x(i), _x(i)), "NULL", "0"),
}
NAMES = list(FAMILIES)


@functools.lru_cache(maxsize=16 * len(FAMILIES))
def _encoded(family: int, i: int, j: int) -> tuple:
    make, claim, _, _ = FAMILIES[NAMES[family]]
    kinds = {rule: SIGNATURES[rule][0] for rule in SIGNATURES}
    steps = [Step(k, rule, ("none",) if kinds[rule] == "none" else (kinds[rule], *w), list(premises)) for k, (rule, premises, *w) in enumerate(make(i, j))]
    row = V._row("", Cert(steps, claim(i, j)))
    return row[1], row[2][: -4 if NAMES[family] == "cut short" else None], row[3]


def event_certs(events):
    """(cert_id, goal_toks, cert_toks, header) of events (event_id, family, i, j)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(str(e), *_encoded(int(f), int(i), int(j))) for e, f, i, j in zip(b["event_id"], b["family"], b["i"], b["j"], strict=True)]
            yield pd.DataFrame(rows, columns=["cert_id", "goal_toks", "cert_toks", "header"])

    return events.mapInPandas(run, f"cert_id string, goal_toks array<int>, cert_toks array<int>, header {V.HEADER}")


def _families(spark, sf):
    n = len(FAMILIES)
    return table(spark, sf, "events").select("event_id", (F.col("event_id") % n).alias("family"), (F.col("user_id") % 4).alias("i"), (F.floor(F.col("event_id") / n) % 4).alias("j"))


_HOLDS = " ".join(f"WHEN {k} THEN {holds}" for k, (_, _, holds, _) in enumerate(FAMILIES.values()))
_OPEN = " ".join(f"WHEN {k} THEN {n}" for k, (_, _, _, n) in enumerate(FAMILIES.values()))
_NUMBERS = f"e AS (SELECT event_id, event_id % {len(FAMILIES)} AS family, user_id % 4 AS i, event_id // {len(FAMILIES)} % 4 AS j FROM events), h AS (SELECT *, CASE family {_HOLDS} END AS holds FROM e)"


def rule_verdicts(spark, sf):
    """Verdict and open hypotheses of every event's certificate."""
    return V.verify_tokens(event_certs(_families(spark, sf))).select(F.col("cert_id").cast("long").alias("event_id"), "verdict", "open_hyps")


def rule_grammar(spark, sf):
    """Grammar acceptance of every event's certificate."""
    return V.grammar(event_certs(_families(spark, sf))).select(F.col("cert_id").cast("long").alias("event_id"), "accepted")


def rule_steps(spark, sf):
    """Steps of every event's certificate after decoding, by rule and witness."""
    return V.decoded_steps(event_certs(_families(spark, sf))).groupBy("rule", "witness_kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES |= {f.__name__: f for f in (rule_verdicts, rule_grammar, rule_steps)}
ORACLE["rule_verdicts"] = f"""WITH {_NUMBERS} SELECT event_id, CAST(CASE WHEN holds IS NULL THEN -1 WHEN holds THEN 100 ELSE 0 END AS INTEGER) AS verdict,
CAST(CASE WHEN holds THEN CASE family {_OPEN} END ELSE -1 END AS INTEGER) AS open_hyps FROM h"""
ORACLE["rule_grammar"] = f"WITH {_NUMBERS} SELECT event_id, holds IS NOT NULL AS accepted FROM h"
_LISTED = ", ".join(f"({k}, '{rule}', '{SIGNATURES[rule][0]}')" for k, (make, _, _, _) in enumerate(FAMILIES.values()) if NAMES[k] != "cut short" for rule, *_ in make(0, 0))
ORACLE["rule_steps"] = f"WITH {_NUMBERS}, s(family, rule, witness_kind) AS (VALUES {_LISTED}) SELECT rule, witness_kind, count(*) AS n FROM h JOIN s USING (family) GROUP BY rule, witness_kind"
