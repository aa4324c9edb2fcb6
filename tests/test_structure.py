"""Nesting, best paths and renaming against plain Python."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from prooflake.operators import nesting, paths, renaming

PAIR = {")": "(", "]": "[", "}": "{"}


def plain_brackets(text):
    stack, deepest, depth, place, n = [], 0, 0, None, 0
    for i, c in enumerate(text or ""):
        if c in "([{)]}":
            n += 1
            depth += 1 if c in "([{" else -1
            deepest = max(deepest, depth)
            if place is None:
                if c in "([{":
                    stack.append(c)
                elif stack and stack[-1] == PAIR[c]:
                    stack.pop()
                else:
                    place = i
    if place is None and stack:
        place = len(text)
    return n, deepest, place is None, place


@pytest.mark.parametrize("block", [4096, 3])
def test_brackets(spark, monkeypatch, block):
    monkeypatch.setattr(nesting, "BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", "plain", "()", ")(", "(]", "((", "a(b[c]d)e", "(" * 50 + ")" * 50, "😀(é]", "([)]"]
    for _ in range(300):
        depth, out = [], []
        for _ in range(rng.randrange(30)):
            if depth and rng.random() < 0.5:
                out.append({v: k for k, v in PAIR.items()}[depth.pop()] if rng.random() < 0.97 else ")")
            else:
                depth.append(rng.choice("([{"))
                out.append(depth[-1] + rng.choice(["", "x", "éé"]))
        out += [{v: k for k, v in PAIR.items()}[c] for c in reversed(depth)] if rng.random() < 0.8 else []
        texts.append("".join(out))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.n_tokens, r.deepest, r.balanced, r.place) for r in nesting.brackets(df, "id", "text").collect()}
    assert got == {i: plain_brackets(t) for i, t in enumerate(texts)}


def test_a_text_of_many_tokens(spark):
    deep, flat = "(" * 30_000 + "[]" + ")" * 30_000, "()" * 50_000 + "]"
    df = spark.createDataFrame([(1, deep), (2, flat), (3, deep + "(")], "id long, text string")
    got = {r.id: (r.n_tokens, r.deepest, r.balanced, r.place) for r in nesting.brackets(df, "id", "text").collect()}
    assert got == {i: plain_brackets(t) for i, t in ((1, deep), (2, flat), (3, deep + "("))}


def test_tags(spark):
    pages = ["<div><B class='x>'>a</b></DIV>", "<div><b></div></b>", "<br><body><bold>", "<div><p>x", "</p>", "<b\n>x</b >", None]
    df = spark.createDataFrame([(i, p, "t", 1) for i, p in enumerate(pages)], "id long, html string, name string, level int")
    got = {r.id: (r.n_tokens, r.balanced, r.place) for r in nesting.tags(df, "id", "html", ["b", "div", "p"]).collect()}
    assert got == {0: (4, True, None), 1: (4, False, 8), 2: (0, True, None), 3: (2, False, 9), 4: (1, False, 0), 5: (2, True, None), 6: (0, True, None)}


def test_best_paths(spark):
    rng = random.Random(3)
    nodes = [f"n{k}" for k in range(7)]
    for trial in range(3):
        cost = {(a, b): rng.randrange(1, 6) for a, b in itertools.product(nodes, nodes) if rng.random() < 0.5}
        edges = spark.createDataFrame([(*e, c) for e, c in cost.items()], "a string, b string, cost long")
        every, level = [], [(0, ["n0"])]
        for _ in range(4):
            level = [(c + cost[p[-1], b], [*p, b]) for c, p in level for b in nodes if (p[-1], b) in cost]
            every += [x for x in level if x[1][-1] == "n1"]
            level = [x for x in level if x[1][-1] != "n1"]
        got = [(r["rank"], r.cost, r.path) for r in paths.best_paths(edges, "n0", "n1", 5, 4).orderBy("rank").collect()]
        assert got == [(i, c, p) for i, (c, p) in enumerate(sorted(every)[:5], 1)], trial
    assert paths.best_paths(edges, "n0", "nowhere", 5, 3).collect() == []


def test_renaming(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    rows = [(i, k, None if c == "c" else c) for i, w in enumerate(words) for k, c in enumerate(w)]
    df = spark.createDataFrame(rows, "id long, at int, s string")

    def canonical(w):
        seen = {}
        return tuple(seen.setdefault(c, len(seen)) for c in w)

    labels = {(r.id, r.at): r.label for r in renaming.numbered(df, ["id"], "at", "s").collect()}
    assert labels == {(i, k): x for i, w in enumerate(words) for k, x in enumerate(canonical(w))}
    members = {}
    for i, w in enumerate(words):
        members.setdefault(canonical(w), []).append(i)
    got = {r.id: (r.n, r.n_symbols, r.size, r.first.id) for r in renaming.classes(df, ["id"], "at", "s").collect()}
    assert got == {i: (len(w), max(canonical(w)) + 1, len(m := members[canonical(w)]), m[0]) for i, w in enumerate(words)}


def test_costs_are_those_of_the_counts(spark):
    rows = spark.createDataFrame([("u", k, "ab"[k % 3 == 0]) for k in range(30)] + [("v", 0, "a")], "u string, t int, s string")
    got = {(r.a, r.b): r.n for r in paths.transitions(rows, ["u"], ["t"], "s").collect()}
    word = "".join("ab"[k % 3 == 0] for k in range(30))
    assert got == {(a, b): n for a in "ab" for b in "ab" if (n := len(re.findall(f"(?={a}{b})", word)))} and math.log(sum(got.values())) == math.log(29)
    assert rows.where(F.col("u") == "v").count() == 1
