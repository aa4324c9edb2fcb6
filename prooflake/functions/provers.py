"""Provers: functions from a goal to certificates, tried in the order that the caller names.

A prover isn't trusted: whoever calls it replays what it returns.  Stored certificates (``lookup``) are a join by key, in
``operators.search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from .kernel import Cert
from .proofs import Proof, _refl, both, imp, number_theory, v
from .search import Limits, _operands, best_first
from .terms import BOOL, NAT, Theory, fun, mk_quant, same


class Prover(Protocol):
    def __call__(self, goal: tuple, theory: Theory, limits: Limits, hints: list[str]) -> Iterator[Cert]: ...


PROVERS: dict[str, Prover] = {}


def prover(name: str):
    """Register a prover under a name."""

    def add(f: Prover) -> Prover:
        PROVERS[name] = f
        return f

    return add


_ONE, _N, _P, _Q = ("c", "one", NAT), v("n"), v("p"), v("q")
_SIGNATURE = {"prime": fun(NAT, BOOL), "gt": fun(NAT, fun(NAT, BOOL)), "divides": fun(NAT, fun(NAT, BOOL)), "factorial": fun(NAT, NAT), "plus": fun(NAT, fun(NAT, NAT)), "one": NAT}


def _call(f: str, *args):
    out = ("c", f, _SIGNATURE[f])
    for a in args:
        out = ("@", out, a)
    return out


#: n! + 1, and "p is a prime that divides it".
_AFTER = _call("plus", _call("factorial", _N), _ONE)
_DIVISOR = both(_call("prime", _P), _call("divides", _P, _AFTER))
#: Above every number there is a prime.
EUCLID = mk_quant("!", "n", NAT, mk_quant("?", "q", NAT, both(_call("gt", _Q, _N), _call("prime", _Q))))


def euclid_theory() -> Theory:
    """Number theory with the two axioms that the statement on primes rests on."""
    t = number_theory()
    for name, ty in _SIGNATURE.items():
        t.add_const(name, ty)
    t.add_axiom("has_prime_divisor", mk_quant("!", "m", NAT, mk_quant("?", "p", NAT, both(_call("prime", _P), _call("divides", _P, v("m"))))))
    t.add_axiom("euclid_step", mk_quant("!", "p", NAT, mk_quant("!", "n", NAT, imp(_DIVISOR, _call("gt", _P, _N)))))
    return t


def is_euclid(goal) -> bool:
    """Whether the goal says, under any bound names, that there is a prime above every number."""
    return same(goal, EUCLID)


def is_reflexive(goal) -> bool:
    """Whether the goal is an equation of two terms that are equal up to bound names."""
    sides = _operands("=", goal)
    return sides is not None and same(*sides)


@prover("scripted")
def scripted(goal, theory: Theory, limits: Limits, hints: list[str]) -> Iterator[Cert]:
    """The statement on primes from its two axioms; nothing for other goals, or in a theory without the axioms."""
    if not is_euclid(goal) or not {"has_prime_divisor", "euclid_step"} <= set(theory.axioms):
        return
    p = Proof(theory)
    h = p.add("ASSUME", _DIVISOR)
    k = p.add("AXIOM", "euclid_step")
    for t in (_P, _N):
        k = p.add("SPEC", t, premises=(k,))
    above = p.add("MP", premises=(k, h))
    found = p.add("EXISTS", "q", NAT, _P, premises=(p.add("CONJ", premises=(above, p.add("CONJUNCT1", premises=(h,)))),))
    some = p.add("SPEC", _AFTER, premises=(p.add("AXIOM", "has_prime_divisor"),))
    p.add("GEN", "n", NAT, premises=(p.add("CHOOSE", "p", NAT, premises=(some, found)),))
    yield p.cert()


@prover("enumerator")
def enumerator(goal, theory: Theory, limits: Limits, hints: list[str]) -> Iterator[Cert]:
    """One step of reflexivity."""
    if is_reflexive(goal) and limits.steps >= 1:
        c = _refl(_operands("=", goal)[0]).cert()
        yield Cert(c.steps, goal)


@prover("search")
def searched(goal, theory: Theory, limits: Limits, hints: list[str]) -> Iterator[Cert]:
    """Best-first search; ``hints`` name rules that are tried first at every position."""
    found = best_first(goal, theory, {(k, r): 1000.0 for k in range(limits.steps) for r in hints}, limits)
    if found.cert is not None:
        yield found.cert

