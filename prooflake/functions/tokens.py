"""Certificates as token sequences: encoding, decoding, and the grammar's pushdown automaton."""

from __future__ import annotations

from dataclasses import dataclass, field

from .kernel import Cert, Step
from .terms import LogicError, Theory, fun, mk_binary, mk_not, mk_quant
from .vocab import BUILTIN_TYPES, EOS, KEYWORDS, OPERATORS, POOLS, PUNCTUATION, RULE_ID, RULE_OF

L, R, COLON, DOT, COMMA, Q, ARROW = (PUNCTUATION[c] for c in ("(", ")", ":", ".", ",", '"', "->"))
_OP_OF = {i: o for o, i in OPERATORS.items()}
_BUILTIN_OF = {i: o for o, i in BUILTIN_TYPES.items()}
_TAG = {"term": "term", "type": "type", "var": "var", "axiom": "axiom", "inst": "inst", "insttype": "insttype", "bound_and_witness": "bound_and_witness"}


@dataclass
class Header:
    """Names of the pool slots."""

    tycons: list[str] = field(default_factory=list)
    tyvars: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    vars: list[str] = field(default_factory=list)


class Encoder:
    """Emits tokens; names get pool slots in order of first sight."""

    def __init__(self, header: Header | None = None):
        self.header, self.out = header or Header(), []
        self._pools = {"tycon": self.header.tycons, "tyvar": self.header.tyvars, "name": self.header.names, "var": self.header.vars}

    def slot(self, cls: str, name: str) -> int:
        pool, (first, size) = self._pools[cls], POOLS[cls]
        if name not in pool:
            if len(pool) == size:
                raise LogicError(f"{cls} pool is full at {name}")
            pool.append(name)
        return first + pool.index(name)

    def emit(self, *toks: int) -> None:
        self.out += toks

    def integer(self, n: int) -> None:
        first, size = POOLS["int"]
        if not 0 <= n < size:
            raise LogicError(f"number {n} is out of range")
        self.emit(first + n)

    def head(self, name: str) -> int:
        return BUILTIN_TYPES[name] if name in BUILTIN_TYPES else self.slot("tycon", name)

    def type(self, ty) -> None:
        if ty[0] == "'":
            self.emit(self.slot("tyvar", ty[1]))
        elif ty[1] == "fun" and len(ty[2]) == 2:
            self.emit(L)
            self.type(ty[2][0])
            self.emit(ARROW)
            self.type(ty[2][1])
            self.emit(R)
        elif not ty[2]:
            self.emit(self.head(ty[1]))
        else:
            for k, a in enumerate(ty[2]):
                self.emit(COMMA if k else L)
                self.type(a)
            self.emit(R, self.head(ty[1]))

    def var(self, name: str, ty) -> None:
        self.emit(self.slot("var", name), COLON)
        self.type(ty)

    def term(self, t) -> None:
        if t[0] == "v":
            return self.var(t[1], t[2])
        if t[0] == "c":
            if t[1] in OPERATORS:
                raise LogicError(f"operator {t[1]} without its arguments")
            return self.emit(self.slot("name", t[1]))
        self.emit(L)
        if t[0] == "\\":
            self._bind("\\", t)
        elif t[1][0] == "@" and t[1][1][0] == "c" and t[1][1][1] in ("=", "/\\", "\\/", "==>"):
            self.term(t[1][2])
            self.emit(OPERATORS[t[1][1][1]])
            self.term(t[2])
        elif t[1][:2] == ("c", "~"):
            self.emit(OPERATORS["~"])
            self.term(t[2])
        elif t[1][0] == "c" and t[1][1] in "!?" and t[2][0] == "\\":
            self._bind(t[1][1], t[2])
        else:
            self.term(t[1])
            self.term(t[2])
        self.emit(R)

    def _bind(self, op: str, t) -> None:
        self.emit(OPERATORS[op])
        self.var(t[1], t[2])
        self.emit(DOT)
        self.term(t[3])

    def quoted(self, kind: str, x) -> None:
        self.emit(Q)
        if kind == "term":
            self.term(x)
        elif kind == "type":
            self.type(x)
        else:
            self.emit(self.slot(kind, x))
        self.emit(Q)

    def witness(self, w) -> None:
        kind = w[0]
        if kind == "none":
            return
        self.emit(L, KEYWORDS[_TAG[kind]])
        if kind in ("term", "type"):
            self.quoted(kind, w[1])
        elif kind == "axiom":
            self.quoted("name", w[1])
        elif kind == "var":
            self.quoted("var", w[1])
            self.quoted("type", w[2])
        elif kind in ("inst", "insttype"):
            for a, b in w[1]:
                self.emit(L, KEYWORDS["subst"])
                self.quoted(*(("term", a) if kind == "inst" else ("var", a)))
                self.quoted("term" if kind == "inst" else "type", b)
                self.emit(R)
        else:
            self.emit(L, KEYWORDS["bound"])
            self.quoted("var", w[1])
            self.quoted("type", w[2])
            self.emit(R, L, KEYWORDS["witness"])
            self.quoted("term", w[3])
            self.emit(R)
        self.emit(R)

    def cert(self, c: Cert) -> None:
        self.emit(L, KEYWORDS["cert"])
        for s in c.steps:
            if s.rule not in RULE_ID:
                raise LogicError(f"unknown rule {s.rule}")
            self.emit(L, KEYWORDS["step"])
            self.integer(s.id)
            self.emit(L, KEYWORDS["rule"], RULE_ID[s.rule], R, L, KEYWORDS["witness"])
            self.witness(s.witness)
            self.emit(R, L, KEYWORDS["premises"])
            for p in s.premises:
                self.integer(p)
            self.emit(R, R)
        self.emit(L, KEYWORDS["concl"])
        self.quoted("term", c.concl)
        self.emit(R, R)


def encode_cert(c: Cert) -> tuple[list[int], Header]:
    e = Encoder()
    e.cert(c)
    return e.out, e.header


def encode_term(t, header: Header | None = None) -> tuple[list[int], Header]:
    e = Encoder(header)
    e.term(t)
    return e.out, e.header


def encode_pair(goal, c: Cert) -> tuple[list[int], list[int], Header]:
    """Goal and certificate tokens over one header: the goal's names take the first slots."""
    goal_toks, header = encode_term(goal)
    e = Encoder(header)
    e.cert(c)
    return goal_toks, e.out, e.header


class Decoder:
    """Recursive descent over a token sequence."""

    def __init__(self, toks, header: Header, theory: Theory | None = None):
        self.toks, self.h, self.theory, self.at = [int(t) for t in toks], header, theory or Theory(), 0

    def peek(self, k: int = 0) -> int:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else -1

    def next(self, want: int | None = None) -> int:
        t = self.peek()
        if t < 0 or want is not None and t != want:
            raise LogicError(f"token {self.at}: expected {want}, found {t}")
        self.at += 1
        return t

    def pool(self, cls: str) -> str:
        first, size = POOLS[cls]
        k = self.next() - first
        names = {"tycon": self.h.tycons, "tyvar": self.h.tyvars, "name": self.h.names, "var": self.h.vars}[cls]
        if not 0 <= k < size:
            raise LogicError(f"token {self.at - 1}: expected a {cls}")
        if k >= len(names):
            if cls == "var":
                return f"v{k}"
            raise LogicError(f"token {self.at - 1}: {cls} slot {k} has no name")
        return names[k]

    def integer(self) -> int:
        first, size = POOLS["int"]
        k = self.next() - first
        if not 0 <= k < size:
            raise LogicError(f"token {self.at - 1}: expected a number")
        return k

    def type_name(self) -> str:
        return _BUILTIN_OF[self.next()] if self.peek() in _BUILTIN_OF else self.pool("tycon")

    def type(self):
        if self.peek() == L:
            self.next()
            args = [self.type()]
            if self.peek() == ARROW:
                self.next()
                out = fun(args[0], self.type())
                self.next(R)
                return out
            while self.peek() == COMMA:
                self.next()
                args.append(self.type())
            self.next(R)
            return ("T", self.type_name(), tuple(args))
        first, size = POOLS["tyvar"]
        if first <= self.peek() < first + size:
            return ("'", self.pool("tyvar"))
        return ("T", self.type_name(), ())

    def term(self):
        t = self.peek()
        if t == L:
            self.next()
            op = _OP_OF.get(self.peek(), "")
            if op in ("!", "?", "\\"):
                self.next()
                name = self.pool("var")
                self.next(COLON)
                ty = self.type()
                self.next(DOT)
                body = self.term()
                out = ("\\", name, ty, body) if op == "\\" else mk_quant(op, name, ty, body)
            elif op == "~":
                self.next()
                out = mk_not(self.term())
            else:
                out = self.term()
                op = _OP_OF.get(self.peek(), "")
                if op in ("=", "/\\", "\\/", "==>"):
                    self.next()
                    out = mk_binary(op, out, self.term())
                else:
                    while self.peek() != R:
                        out = ("@", out, self.term())
            self.next(R)
            return out
        if t == OPERATORS["="]:
            self.next()
            return ("c", "=", self.theory.consts["="])
        first, size = POOLS["var"]
        if first <= t < first + size:
            name = self.pool("var")
            self.next(COLON)
            return ("v", name, self.type())
        name = self.pool("name")
        if name not in self.theory.consts:
            raise LogicError(f"unknown constant {name}")
        return ("c", name, self.theory.consts[name])

    def quoted(self, kind: str):
        self.next(Q)
        out = self.term() if kind == "term" else self.type() if kind == "type" else self.pool(kind)
        self.next(Q)
        return out

    def witness(self) -> tuple:
        if self.peek() == R:
            return ("none",)
        self.next(L)
        kind = {KEYWORDS[v]: k for k, v in _TAG.items()}.get(self.next())
        if kind is None:
            raise LogicError(f"token {self.at - 1}: not a witness")
        if kind in ("term", "type"):
            out = (kind, self.quoted(kind))
        elif kind == "axiom":
            out = (kind, self.quoted("name"))
        elif kind == "var":
            out = (kind, self.quoted("var"), self.quoted("type"))
        elif kind == "bound_and_witness":
            self.next(L)
            self.next(KEYWORDS["bound"])
            var = self.quoted("var"), self.quoted("type")
            self.next(R)
            self.next(L)
            self.next(KEYWORDS["witness"])
            out = (kind, *var, self.quoted("term"))
            self.next(R)
        else:
            pairs = []
            while self.peek() == L:
                self.next()
                self.next(KEYWORDS["subst"])
                pairs.append((self.quoted("term"), self.quoted("term")) if kind == "inst" else (self.quoted("var"), self.quoted("type")))
                self.next(R)
            out = (kind, pairs)
        self.next(R)
        return out

    def cert(self) -> Cert:
        self.next(L)
        self.next(KEYWORDS["cert"])
        steps = []
        while self.peek(1) != KEYWORDS["concl"]:
            self.next(L)
            self.next(KEYWORDS["step"])
            k = self.integer()
            self.next(L)
            self.next(KEYWORDS["rule"])
            rule = RULE_OF.get(self.next())
            if rule is None:
                raise LogicError(f"token {self.at - 1}: not a rule")
            self.next(R)
            self.next(L)
            self.next(KEYWORDS["witness"])
            w = self.witness()
            self.next(R)
            self.next(L)
            self.next(KEYWORDS["premises"])
            prem = []
            while self.peek() != R:
                prem.append(self.integer())
            self.next(R)
            self.next(R)
            steps.append(Step(k, rule, w, prem))
        self.next(L)
        self.next(KEYWORDS["concl"])
        concl = self.quoted("term")
        self.next(R)
        self.next(R)
        return Cert(steps, concl)


def decode_cert(toks, header: Header, theory: Theory | None = None, strict: bool = False) -> Cert:
    d = Decoder(toks, header, theory)
    out = d.cert()
    if strict and d.at < len(d.toks):
        raise LogicError("tokens after the certificate")
    return out


def decode_term(toks, header: Header, theory: Theory | None = None):
    return Decoder(toks, header, theory).term()


# ---- grammar: productions by nonterminal, each chosen by its first token


def _pool(cls: str) -> set[int]:
    first, size = POOLS[cls]
    return set(range(first, first + size))


_HEADS = set(_BUILTIN_OF) | _pool("tycon")
_BIN = {OPERATORS[o] for o in ("=", "/\\", "\\/", "==>")}
K = KEYWORDS
#: Nonterminal -> [(first tokens, symbols that replace it)]; a set is a terminal, None first tokens: anything (empty).
GRAMMAR: dict[str, list[tuple[set[int] | None, list]]] = {
    "cert": [({L}, [{L}, {K["cert"]}, "items"])],
    "items": [({L}, [{L}, "item"])],
    "item": [
        ({K["step"]}, [{K["step"]}, _pool("int"), {L}, {K["rule"]}, set(RULE_OF), {R}, {L}, {K["witness"]}, "witness", {R}, {L}, {K["premises"]}, "ints", {R}, {R}, "items"]),
        ({K["concl"]}, [{K["concl"]}, {Q}, "term", {Q}, {R}, {R}]),
    ],
    "ints": [(_pool("int"), [_pool("int"), "ints"]), (None, [])],
    "witness": [({L}, [{L}, "body", {R}]), (None, [])],
    "body": [
        ({K["term"]}, [{K["term"]}, {Q}, "term", {Q}]),
        ({K["type"]}, [{K["type"]}, {Q}, "type", {Q}]),
        ({K["var"]}, [{K["var"]}, {Q}, _pool("var"), {Q}, {Q}, "type", {Q}]),
        ({K["axiom"]}, [{K["axiom"]}, {Q}, _pool("name"), {Q}]),
        ({K["inst"]}, [{K["inst"]}, "insts"]),
        ({K["insttype"]}, [{K["insttype"]}, "insttypes"]),
        ({K["bound_and_witness"]}, [{K["bound_and_witness"]}, {L}, {K["bound"]}, {Q}, _pool("var"), {Q}, {Q}, "type", {Q}, {R}, {L}, {K["witness"]}, {Q}, "term", {Q}, {R}]),
    ],
    "insts": [({L}, [{L}, {K["subst"]}, {Q}, "term", {Q}, {Q}, "term", {Q}, {R}, "insts"]), (None, [])],
    "insttypes": [({L}, [{L}, {K["subst"]}, {Q}, _pool("var"), {Q}, {Q}, "type", {Q}, {R}, "insttypes"]), (None, [])],
    "type": [({L}, [{L}, "type", "typerest"]), (_HEADS | _pool("tyvar"), [_HEADS | _pool("tyvar")])],
    "typerest": [({ARROW}, [{ARROW}, "type", {R}]), ({COMMA}, [{COMMA}, "type", "typeargs"]), ({R}, [{R}, _HEADS])],
    "typeargs": [({COMMA}, [{COMMA}, "type", "typeargs"]), ({R}, [{R}, _HEADS])],
    "term": [({L}, [{L}, "inner", {R}]), (_pool("var"), [_pool("var"), {COLON}, "type"]), (_pool("name"), [_pool("name")]), ({OPERATORS["="]}, [{OPERATORS["="]}])],
    "inner": [
        ({OPERATORS[o] for o in ("!", "?", "\\")}, [{OPERATORS[o] for o in ("!", "?", "\\")}, _pool("var"), {COLON}, "type", {DOT}, "term"]),
        ({OPERATORS["~"]}, [{OPERATORS["~"]}, "term"]),
        ({L, OPERATORS["="]} | _pool("var") | _pool("name"), ["term", "second"]),
    ],
    "second": [(_BIN, [_BIN, "term"]), ({L} | _pool("var") | _pool("name"), ["term"])],
}
START = ("cert",)


def allowed(stack: tuple) -> set[int]:
    """The tokens that the automaton takes next; EOS if it is in its accepting state."""
    out: set[int] = set()
    for k in range(len(stack) - 1, -1, -1):
        top = stack[k]
        if isinstance(top, frozenset | set):
            return out | top
        empty = False
        for first, _ in GRAMMAR[top]:
            if first is None:
                empty = True
            else:
                out |= first
        if not empty:
            return out
    return out | {EOS}


def advance(stack: tuple, tok: int) -> tuple | None:
    """The stack after a token, or None if the grammar doesn't take it; EOS leaves an accepted stack as it is."""
    if not stack:
        return stack if tok == EOS else None
    work = list(stack)
    while work:
        top = work.pop()
        if isinstance(top, frozenset | set):
            return tuple(work) if tok in top else None
        for first, symbols in GRAMMAR[top]:
            if first is not None and tok in first:
                work += symbols[::-1]
                break
        else:
            if all(first is not None for first, _ in GRAMMAR[top]):
                return None
    return None


def accepts(toks) -> bool:
    stack: tuple | None = START
    for t in toks:
        stack = advance(stack, int(t))
        if stack is None:
            return False
    return stack == ()


def chooses_rule(taken: set[int]) -> bool:
    """Whether the mask is that of the place where a rule's name stands."""
    return taken == set(RULE_OF)


def chooses_witness(taken: set[int]) -> bool:
    """Whether the mask is that of the place where a witness's kind stands."""
    return len(taken) > 1 and taken <= {K[w] for w in ("term", "type", "var", "axiom", "inst", "insttype", "bound_and_witness")}
