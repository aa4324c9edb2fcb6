"""Proof documents: statement and trace table in LaTeX."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import kernel, proofs, tokens
from ..functions.terms import BINARY, LogicError, show_type
from .verify import TheoryMaker, _header

SYMBOL = {"=": "=", "==>": r"\Rightarrow", "/\\": r"\wedge", "\\/": r"\vee", "~": r"\neg", "!": r"\forall", "?": r"\exists", "\\": r"\lambda", "->": r"\to"}


def name(s: str) -> str:
    """An identifier: subscripts for trailing digits, text style for long names."""
    stem = s.rstrip("0123456789")
    digits = s[len(stem) :]
    stem = stem.replace("_", r"\_") or s
    body = stem if len(stem) == 1 else rf"\mathrm{{{stem}}}"
    return body + (f"_{{{digits}}}" if digits and stem != s else "")


def type_tex(ty) -> str:
    return show_type(ty).replace("->", SYMBOL["->"]).replace("'", r"\alpha_")


def term_tex(t) -> str:
    if t[0] in "vc":
        return SYMBOL.get(t[1], name(t[1]))
    if t[0] == "\\":
        return rf"({SYMBOL['\\']} {name(t[1])}{{:}}{type_tex(t[2])}.\; {term_tex(t[3])})"
    f, x = t[1:]
    if f[0] == "@" and f[1][0] == "c" and f[1][1] in BINARY:
        return f"({term_tex(f[2])} {SYMBOL[f[1][1]]} {term_tex(x)})"
    if f[0] == "c" and f[1] in "!?" and x[0] == "\\":
        return rf"({SYMBOL[f[1]]} {name(x[1])}{{:}}{type_tex(x[2])}.\; {term_tex(x[3])})"
    if f[:2] == ("c", "~"):
        return rf"({SYMBOL['~']} {term_tex(x)})"
    return rf"({term_tex(f)}\; {term_tex(x)})"


def witness_tex(w: tuple) -> str:
    if w[0] in ("none",):
        return ""
    if w[0] == "term":
        return f"${term_tex(w[1])}$"
    if w[0] == "var":
        return f"${name(w[1])}{{:}}{type_tex(w[2])}$"
    if w[0] == "inst":
        return ", ".join(rf"${term_tex(a)} \mapsto {term_tex(b)}$" for a, b in w[1])
    if w[0] == "insttype":
        return ", ".join(rf"${name(a)} \mapsto {type_tex(b)}$" for a, b in w[1])
    if w[0] == "bound_and_witness":
        return f"${name(w[1])}$, ${term_tex(w[3])}$"
    return str(w[1]).replace("_", r"\_")


def document(goal, c: kernel.Cert, theorems) -> str:
    """A complete document for one certificate."""
    rows = [
        f"{s.id} & {s.rule.replace('_', chr(92) + '_')} & ${term_tex(t.concl)}$ & {witness_tex(s.witness)} & {', '.join(map(str, s.premises))} \\\\"
        for s, (_, t) in zip(c.steps, theorems, strict=True)
    ]
    return "\n".join([r"\documentclass{article}", r"\begin{document}", r"\section*{Theorem}", f"$$ {term_tex(goal)} $$", r"\section*{Proof}", r"\begin{tabular}{rllll}", r"step & rule & conclusion & witness & from \\ \hline", *rows, r"\end{tabular}", r"\end{document}"])


def proof_documents(df: DataFrame, theory: TheoryMaker = proofs.number_theory) -> DataFrame:
    """(cert_id, tex) of every certificate that replays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory()
        for b in batches:
            out = []
            for cid, cert, h in zip(b["cert_id"], b["cert_toks"], b["header"], strict=True):
                try:
                    c = tokens.decode_cert(cert, _header(h), th)
                    out.append((cid, document(c.concl, c, kernel.replay(c, th))))
                except LogicError:
                    continue
            yield pd.DataFrame(out, columns=["cert_id", "tex"])

    return df.select("cert_id", "cert_toks", "header").mapInPandas(run, "cert_id string, tex string")
