"""Patterns over rows' kinds, turned into automata by derivatives.

A pattern is a nested tuple: ``kind("view")``, ``seq(...)``, ``either(...)``, ``many(p)``, ``some(p)``, ``anything()``.  Its
derivative by a kind is what must follow that kind; the distinct derivatives are the states.
"""

from __future__ import annotations

NEVER, DONE = ("never",), ("done",)


def kind(name: str) -> tuple:
    return ("kind", name)


def anything() -> tuple:
    """One row of whatever kind."""
    return ("any",)


def seq(*parts: tuple) -> tuple:
    out: tuple = DONE
    for p in reversed(parts):
        if NEVER in (p, out):
            return NEVER
        out = out if p == DONE else p if out == DONE else ("seq", p, out)
    return out


def either(*parts: tuple) -> tuple:
    flat = {q for p in parts for q in (p[1] if p[0] == "either" else (p,))} - {NEVER}
    if not flat:
        return NEVER
    return next(iter(flat)) if len(flat) == 1 else ("either", tuple(sorted(flat, key=repr)))


def many(p: tuple) -> tuple:
    """Any number, none too."""
    return DONE if p in (DONE, NEVER) else p if p[0] == "many" else ("many", p)


def some(p: tuple) -> tuple:
    """One or more."""
    return seq(p, many(p))


def empty(p: tuple) -> bool:
    """Whether no row at all fits."""
    match p[0]:
        case "done" | "many":
            return True
        case "seq":
            return empty(p[1]) and empty(p[2])
        case "either":
            return any(map(empty, p[1]))
    return False


def derivative(p: tuple, x: str | None) -> tuple:
    """What must follow a row of kind ``x`` (None: a kind that the pattern doesn't name)."""
    match p[0]:
        case "kind":
            return DONE if p[1] == x else NEVER
        case "any":
            return DONE
        case "seq":
            first = seq(derivative(p[1], x), p[2])
            return either(first, derivative(p[2], x)) if empty(p[1]) else first
        case "either":
            return either(*(derivative(q, x) for q in p[1]))
        case "many":
            return seq(derivative(p[1], x), p)
    return NEVER


def names(p: tuple) -> set[str]:
    if p[0] == "kind":
        return {p[1]}
    return {n for q in (p[1] if p[0] == "either" else p[1:]) if isinstance(q, tuple) for n in names(q)}


def automaton(p: tuple) -> tuple[list[dict[str, int]], list[int], list[bool]]:
    """(table by state and kind, state after other kinds, whether a state accepts); state 0 is the start."""
    kinds, states, table, other = sorted(names(p)), [p], [], []
    at = {p: 0}

    def number(q: tuple) -> int:
        if q not in at:
            at[q] = len(states)
            states.append(q)
        return at[q]

    k = 0
    while k < len(states):
        table.append({x: number(derivative(states[k], x)) for x in kinds})
        other.append(number(derivative(states[k], None)))
        k += 1
    return table, other, [empty(q) for q in states]
