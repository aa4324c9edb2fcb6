"""Proofs of goals as DataFrame operators: provers in order over a cache, search, and the store of accepted proofs.

Goals are rows (goal_id, goal) with the text form of a term.  Each goal's work is bounded by ``Limits`` and independent
of the others, so partitions give the parallelism.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernel, provers, tokens
from ..functions.proofs import number_theory
from ..functions.search import Limits, Policy, best_first, flat_sample, token_subterms
from ..functions.terms import LogicError, alpha_key, parse_term
from ..schemas import HEADER
from ..sources.files import append_new, cert_of_text, cert_text, read_records
from .verify import TheoryMaker, _header

CACHE = "key string, cert string"


def keyed(goals: DataFrame, theory: TheoryMaker = number_theory) -> DataFrame:
    """Adds ``key``, the hash of the goal up to bound names; null for a goal that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            yield b.assign(canon=[_canon(g, th) for g in b["goal"]])

    return goals.select("goal_id", "goal").mapInPandas(run, "goal_id string, goal string, canon string").select("goal_id", "goal", F.sha2("canon", 256).alias("key"))


def _canon(goal: str | None, th) -> str | None:
    try:
        return None if goal is None else alpha_key(parse_term(goal, th))
    except (LogicError, RecursionError):
        return None


def search(goals: DataFrame, policy: Policy | None = None, limits: Limits = Limits(), method: str = "tree", seed: int = 0, theory: TheoryMaker = number_theory) -> DataFrame:
    """(goal_id, solved, shape, calls, depth, cert): best-first (``tree``) or flat sampling (``sample``).

    ``policy``: counts by (position, rule), one bounded snapshot.  Unreadable goals are unsolved after no calls.
    """
    if method not in ("tree", "sample"):
        raise ValueError("method: tree or sample")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            out = []
            for gid, goal in zip(b["goal_id"], b["goal"], strict=True):
                try:
                    t = parse_term(goal or "", th)
                    found = best_first(t, th, policy, limits) if method == "tree" else flat_sample(t, th, policy, limits, seed)
                except (LogicError, RecursionError, TypeError):
                    out.append((gid, False, None, 0, 0, None))
                    continue
                c = found.cert
                out.append((gid, c is not None, c and "-".join(s.rule for s in c.steps), found.calls, found.depth, c and cert_text(c)))
            yield pd.DataFrame(out, columns=["goal_id", "solved", "shape", "calls", "depth", "cert"])

    return goals.select("goal_id", "goal").mapInPandas(run, "goal_id string, solved boolean, shape string, calls int, depth int, cert string")


def prove(goals: DataFrame, using: list[str], cache: DataFrame | None = None, hints: list[str] | None = None, limits: Limits = Limits(), theory: TheoryMaker = number_theory) -> DataFrame:
    """(goal_id, key, prover, cert): the first prover, in the order of ``using``, with a certificate that replays.

    ``lookup`` takes the certificate stored under the goal's key, by one left join; it stands where ``using`` has it.
    Whatever a prover or the cache gives is replayed strictly against the goal.  No prover: null.
    """
    if unknown := set(using) - {"lookup", *provers.PROVERS}:
        raise ValueError(f"unknown provers {sorted(unknown)}")
    rows = keyed(goals, theory)
    if cache is not None and "lookup" in using:
        rows = rows.join(cache.groupBy("key").agg(F.min("cert").alias("stored")), "key", "left")
    else:
        rows = rows.withColumn("stored", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()

        def accepted(goal: str | None, stored: str | None) -> tuple[str | None, str | None]:
            if goal is None:
                return None, None
            try:
                t = parse_term(goal, th)
            except (LogicError, RecursionError, TypeError):
                return None, None
            for name in using:
                try:
                    found = iter([cert_of_text(stored, th)] if stored else []) if name == "lookup" else provers.PROVERS[name](t, th, limits, hints or [])
                    for c in found:
                        if kernel.verify(c, t, th, True)[0] == kernel.ACCEPTED:
                            return name, cert_text(c)
                except (LogicError, ValueError, RecursionError):
                    continue
            return None, None

        for b in batches:
            best = [accepted(g, s) for g, s in zip(b["goal"], b["stored"], strict=True)]
            yield pd.DataFrame({"goal_id": b["goal_id"], "key": b["key"], "prover": [x for x, _ in best], "cert": [x for _, x in best]})

    return rows.select("goal_id", "key", "goal", "stored").mapInPandas(run, "goal_id string, key string, prover string, cert string")


def store(proved: DataFrame, path: str) -> None:
    """Keep accepted certificates under their goals' keys; a key that is there stays as it is, so it can be run again."""
    append_new(proved.where("cert IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("cert").alias("cert")), path, ["key"])


def read_store(spark, path: str) -> DataFrame:
    return read_records(spark, path, CACHE)


def subterms(df: DataFrame) -> DataFrame:
    """(cert_id, place, toks): the subterms of each goal as token slices, in order, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(cid, i, s) for cid, goal in zip(b["cert_id"], b["goal_toks"], strict=True) if goal is not None for i, s in enumerate(token_subterms([int(t) for t in goal]))]
            yield pd.DataFrame(rows, columns=["cert_id", "place", "toks"])

    return df.select("cert_id", "goal_toks").mapInPandas(run, "cert_id string, place int, toks array<int>")


def cert_texts(df: DataFrame, theory: TheoryMaker = number_theory) -> DataFrame:
    """(name, value): encoded certificates as certificate files; one that can't be decoded gives no file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            out = []
            for cid, cert, h in zip(b["cert_id"], b["cert_toks"], b["header"], strict=True):
                try:
                    out.append((cid, cert_text(tokens.decode_cert(cert, _header(h), th))))
                except (LogicError, RecursionError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["name", "value"])

    return df.select(F.col("cert_id"), "cert_toks", F.col("header").cast(HEADER)).mapInPandas(run, "name string, value string")
