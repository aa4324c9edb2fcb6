"""The fixed token vocabulary of certificates and its Column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Token ids of the certificate format.
BOS, EOS, PAD, UNK = range(4)
PUNCTUATION = {"(": 4, ")": 5, ":": 6, ".": 7, ",": 8, '"': 9, "->": 10}
OPERATORS = {"=": 16, "==>": 17, "/\\": 18, "\\/": 19, "~": 20, "!": 21, "?": 22, "\\": 23}
KEYWORDS = {
    "type": 24, "const": 25, "axiom": 26, "theorem": 27, "goal": 28, "cert": 29, "step": 30, "rule": 31, "witness": 32,
    "premises": 33, "concl": 34, "term": 35, "var": 36, "inst": 37, "insttype": 38, "bound_and_witness": 39, "subst": 40, "bound": 41,
}
RULES = [
    "REFL", "TRANS", "MK_COMB", "ABS", "BETA", "ASSUME", "EQ_MP", "DEDUCT_ANTISYM_RULE", "INST", "INST_TYPE", "AXIOM", "GEN", "SPEC",
    "EXISTS", "CHOOSE", "CONJ", "CONJUNCT1", "CONJUNCT2", "MP", "DISCH", "ETA_AX", "SELECT_AX", "EM_AX",
]
FIRST_RULE = 48
BUILTIN_TYPES = {"bool": 72, "ind": 73, "fun": 74, "nat": 75}
#: Pools: class -> (first id, slots).
POOLS = {"tyvar": (80, 8), "tycon": (88, 16), "name": (104, 64), "var": (168, 32), "int": (200, 32)}
SIZE = 232

#: Rule -> (witness kind, number of premises).
SIGNATURES = {
    "REFL": ("term", 0), "TRANS": ("none", 2), "MK_COMB": ("none", 2), "ABS": ("var", 1), "BETA": ("term", 0), "ASSUME": ("term", 0),
    "EQ_MP": ("none", 2), "DEDUCT_ANTISYM_RULE": ("none", 2), "INST": ("inst", 1), "INST_TYPE": ("insttype", 1), "AXIOM": ("axiom", 0),
    "GEN": ("var", 1), "SPEC": ("term", 1), "EXISTS": ("bound_and_witness", 1), "CHOOSE": ("var", 2), "CONJ": ("none", 2),
    "CONJUNCT1": ("none", 1), "CONJUNCT2": ("none", 1), "MP": ("none", 2), "DISCH": ("term", 1), "ETA_AX": ("none", 0),
    "SELECT_AX": ("none", 0), "EM_AX": ("none", 0),
}

RULE_ID = {r: FIRST_RULE + i for i, r in enumerate(RULES)}
RULE_OF = {i: r for r, i in RULE_ID.items()}


def rows() -> list[tuple[int, str, int, str]]:
    """(token_id, class, slot, text) of every id, reserved ids included."""
    out: dict[int, tuple[str, int, str]] = {}
    for i, t in enumerate(("<bos>", "<eos>", "<pad>", "<unk>")):
        out[i] = "special", i, t
    for cls, table in (("punctuation", PUNCTUATION), ("operator", OPERATORS), ("keyword", KEYWORDS), ("rule", RULE_ID), ("builtin", BUILTIN_TYPES)):
        first = min(table.values())
        for t, i in table.items():
            out[i] = cls, i - first, t
    for cls, (first, n) in POOLS.items():
        for k in range(n):
            out[first + k] = cls, k, {"tyvar": "a", "tycon": "t", "name": "n", "var": "v", "int": ""}[cls] + str(k)
    return [(i, *out.get(i, ("reserved", 0, f"<{i}>"))) for i in range(SIZE)]


def vocab_table(spark: SparkSession) -> DataFrame:
    """The 232 ids as a table (a bounded side for broadcast joins)."""
    return spark.createDataFrame(rows(), "token_id int, cls string, slot int, text string")


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, RULE_ID[r], SIGNATURES[r][1], SIGNATURES[r][0]) for r in RULES], "rule string, token_id int, arity int, witness_kind string")


def is_class(tok: Column, cls: str) -> Column:
    """Whether a token belongs to a class: a range test, no join."""
    if cls == "special":
        return tok.between(0, 3)
    if cls == "rule":
        return tok.between(FIRST_RULE, FIRST_RULE + len(RULES) - 1)
    if cls == "builtin":
        return tok.between(72, 75)
    first, n = POOLS[cls]
    return tok.between(first, first + n - 1)


def is_type_head(tok: Column) -> Column:
    return is_class(tok, "builtin") | is_class(tok, "tycon")


def slot(tok: Column, cls: str) -> Column:
    """Slot of a pool token, null for others."""
    return F.when(is_class(tok, cls), tok - POOLS[cls][0])


def rule_name(tok: Column) -> Column:
    return F.when(is_class(tok, "rule"), F.element_at(F.array(*map(F.lit, RULES)), (tok - FIRST_RULE + 1).cast("int")))


def texts(toks: Column) -> Column:
    """Space-joined text of a token array, all in one expression."""
    table = F.array(*(F.lit(r[3]) for r in rows()))
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.get(table, t.cast("int")), F.lit("<unk>"))), " ")


def rule_shape(toks: Column) -> Column:
    """Rule of each rule keyword: the first rule token among the next three; keywords without one are left out."""
    at = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.get(toks, i) == KEYWORDS["rule"])
    near = F.transform(at, lambda i: F.get(F.filter(F.slice(toks, i + 2, F.lit(3)), lambda t: is_class(t, "rule")), F.lit(0)))
    return F.when(F.size(toks) > 0, F.transform(F.filter(near, lambda t: t.isNotNull()), rule_name)).otherwise(F.array().cast("array<string>"))


def has_step(toks: Column) -> Column:
    """Whether a step keyword follows an opening bracket somewhere."""
    return F.exists(F.arrays_zip(toks.alias("a"), F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1))).alias("b")), lambda p: (p["a"] == 4) & (p["b"] == KEYWORDS["step"]))


def wrap_cert(steps: Column, concl: Column) -> Column:
    """Certificate tokens around step tokens and a conclusion's term tokens."""
    return F.concat(F.array(F.lit(4), F.lit(29)), steps, F.array(F.lit(4), F.lit(34), F.lit(9)), concl, F.array(F.lit(9), F.lit(5), F.lit(5)))


def infer_header(toks: Column) -> Column:
    """Synthetic pool names up to the highest slot that occurs, by class."""

    def names(cls: str, letter: str) -> Column:
        top = F.array_max(F.transform(F.filter(toks, lambda t: is_class(t, cls)), lambda t: t - POOLS[cls][0]))
        return F.when(top.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(top, F.lit(0)).cast("int")), lambda i: F.concat(F.lit(letter), i.cast("string"))))

    return F.struct(names("tycon", "t").alias("tycons"), names("tyvar", "a").alias("tyvars"), names("name", "n").alias("names"), names("var", "v").alias("vars"))


def override_names(header: Column, names: Column) -> Column:
    """Pool names with the caller's names where it gives some."""
    return F.transform(header, lambda x, i: F.coalesce(F.get(names, i), x))


def training_pair(goal: Column, cert: Column, cap: int = 320) -> tuple[Column, Column]:
    """Input and label arrays: [BOS] goal [BOS] cert [EOS] cut to ``cap``; labels hide the prompt."""
    full = F.slice(F.concat(F.array(F.lit(BOS)), goal, F.array(F.lit(BOS)), cert, F.array(F.lit(EOS))), 1, cap)
    prompt = F.size(goal) + 2
    labels = F.transform(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), lambda t, i: F.when(i < prompt - 1, F.lit(PAD)).otherwise(t))
    return F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0))), labels


def pair_length(goal: Column, cert: Column) -> Column:
    return F.size(goal) + F.size(cert) + 3
