"""Declared schemas of the native records."""

from __future__ import annotations

_TOKS = "array<smallint>"
HEADER = "struct<tycons: array<string>, tyvars: array<string>, names: array<string>, vars: array<string>>"
BUFFER = f"goal_toks {_TOKS}, cert_toks {_TOKS}, source string, discovered_round int"
CORPUS = f"goal_toks {_TOKS}, cert_toks {_TOKS}, rule_shape array<string>, cert_names array<string>, goal_names array<string>, source string, depth int"
NOVEL = f"round int, seed_label string, shape array<string>, goal_toks {_TOKS}, cert_toks {_TOKS}"
PROBE = (
    "walk_id bigint, target_depth int, completed_shape array<string>, steps array<struct<pos: int, applicable: array<string>, "
    "precond: map<string, boolean>, sampled: string, apply_ok: boolean, failures: array<array<string>>, kit: boolean>>"
)
EVAL = "seed string, method string, rule_shape string, solved int, novel_shape int, kernel_calls int, forward_passes int, depth int, ckpt_round int, elapsed double"
STEPS = "cert_id string, pos int, step_id int, rule string, witness_kind string, premises array<int>, declared_concl string"
THEOREMS = "cert_id string, step_id int, hyps array<string>, concl string"
DECLS = "kind string, name string, arity int, body string"
