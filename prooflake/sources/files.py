"""Readers and writers of the native formats: JSON lines, certificates, goals and theories.

Parsing is row-wise in Python workers; files are whole-text rows, so every format works on any store Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.kernel import Cert, Step
from ..functions.terms import LogicError, Theory, parse_term, parse_type, show, show_type
from ..schemas import BUFFER, DECLS, NOVEL, PROBE

POLICIES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


# ---- JSON lines


def read_records(spark: SparkSession, path: str, schema: str, malformed: str = "DROPMALFORMED", missing_ok: bool = True) -> DataFrame:
    """Records of a declared schema; a missing path is an empty table unless that is an error."""
    if malformed not in POLICIES:
        raise ValueError(f"malformed: one of {POLICIES}")
    try:
        return spark.read.schema(schema).option("mode", malformed).json(path)
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_buffer(spark: SparkSession, path: str, malformed: str = "DROPMALFORMED", unknown_source: str = "corpus", same_source: dict[str, str] | None = None) -> DataFrame:
    """Buffer entries with defaults for what old rows lack; ``same_source`` merges labels explicitly."""
    df = read_records(spark, path, BUFFER, malformed)
    source = F.coalesce("source", F.lit(unknown_source))
    for a, b in (same_source or {}).items():
        source = F.when(source == a, b).otherwise(source)
    return df.withColumn("source", source).withColumn("discovered_round", F.coalesce("discovered_round", F.lit(0)))


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append rows whose key the buffer doesn't hold yet; run again, it adds nothing."""
    known = read_records(df.sparkSession, path, _ddl(df))
    fresh = df.dropDuplicates(key).join(known.select(*key).distinct(), key, "left_anti")
    write_records(fresh.select(*df.columns), path)


def read_probes(spark: SparkSession, path: str, malformed: str = "DROPMALFORMED") -> DataFrame:
    return read_records(spark, path, PROBE, malformed)


def read_novel(spark: SparkSession, path: str, malformed: str = "DROPMALFORMED") -> DataFrame:
    return read_records(spark, path, NOVEL, malformed)


def append_novel(df: DataFrame, path: str) -> bool:
    """Append novel certificates; writes nothing, not even a folder, if there are none.  Whether it wrote."""
    if df.isEmpty():
        return False
    write_records(df.select(*(f.split()[0] for f in NOVEL.split(", "))), path)
    return True


def write_texts(df: DataFrame, path: str) -> None:
    """Rows (name, value) as a file each, in a folder name=..., which the readers of whole files here take as it is.

    For exports: a file a row is dear beyond some millions of rows, where the token columns should be kept instead.
    """
    df.select("name", "value").repartition("name").write.mode("append").partitionBy("name").option("lineSep", "\n").text(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def replace_atomically(df: DataFrame, path: str) -> None:
    """Back the old folder up, then swap the new one in by rename; refuses if a backup is there."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p, new, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".new", ".bak"))
    fs = p.getFileSystem(conf)
    if fs.exists(old) and not fs.exists(p):  # stopped between the two renames: the old folder is the last whole one
        fs.rename(old, p)
    if fs.exists(old):
        raise FileExistsError(f"{path}.bak")
    df.write.mode("overwrite").json(path + ".new")
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(new, p)


def write_eval_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# ---- S-expressions

_SEXP = re.compile(r'\s+|;[^\n]*|([()])|"((?:[^"\\]|\\.)*)"|([^\s()";]+)', re.S)
_ESCAPE = {"n": "\n", "t": "\t"}


def read_sexp(text: str, every: bool = False):
    """The first form of a text as nested lists of strings (``every``: all forms); what follows is ignored."""
    stack: list[list] = [[]]
    at = 0
    while at < len(text):
        m = _SEXP.match(text, at)
        if not m:
            raise LogicError(f"unreadable at {at}")
        at = m.end()
        if m[1] == "(":
            stack.append([])
        elif m[1] == ")":
            if len(stack) == 1:
                raise LogicError("unbalanced )")
            done = stack.pop()
            stack[-1].append(done)
        elif m[2] is not None:
            stack[-1].append(re.sub(r"\\(.)", lambda x: _ESCAPE.get(x[1], x[1]), m[2], flags=re.S))
        elif m[3] is not None:
            stack[-1].append(m[3])
        if len(stack) == 1 and stack[0] and not every:
            return stack[0][0]
    if len(stack) > 1 or not stack[0] and not every:
        raise LogicError("unfinished form")
    return stack[0] if every else stack[0][0]


def _witness(x, th: Theory) -> tuple:
    match x:
        case []:
            return ("none",)
        case ["term", t]:
            return ("term", parse_term(t, th))
        case ["type", t]:
            return ("type", parse_type(t))
        case ["var", n, t]:
            return ("var", n, parse_type(t))
        case ["axiom", n]:
            return ("axiom", n)
        case ["bound_and_witness", ["bound", n, t], ["witness", w]]:
            return ("bound_and_witness", n, parse_type(t), parse_term(w, th))
        case ["inst", *pairs]:
            return ("inst", [(parse_term(a, th), parse_term(b, th)) for _, a, b in pairs])
        case ["insttype", *pairs]:
            return ("insttype", [(a, parse_type(b)) for _, a, b in pairs])
    raise LogicError("bad witness")


def cert_of_text(text: str, theory: Theory | None = None) -> Cert:
    """A certificate from its text form."""
    th = theory or Theory()
    form = read_sexp(text)
    if not isinstance(form, list) or not form or form[0] != "cert" or not (isinstance(form[-1], list) and form[-1][:1] == ["concl"]):
        raise LogicError("not a certificate that ends in a conclusion")
    steps = []
    for s in form[1:-1]:
        parts = {p[0]: p[1:] for p in reversed(s[2:]) if isinstance(p, list) and p}
        if s[0] != "step" or "rule" not in parts:
            raise LogicError("bad step")
        w = parts.get("witness", [[]])
        w = w[0] if len(w) == 1 and isinstance(w[0], list) else w
        declared = parse_term(parts["concl"][0], th) if "concl" in parts else None
        steps.append(Step(int(s[1]), parts["rule"][0], _witness(w, th), [int(p) for p in parts.get("premises", [])], declared))
    return Cert(steps, parse_term(form[-1][1], th))


def _quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'


def witness_text(w: tuple) -> str:
    match w:
        case ("none",):
            return "()"
        case ("term", t):
            return f"(term {_quote(show(t))})"
        case ("type", t):
            return f"(type {_quote(show_type(t))})"
        case ("var", n, t):
            return f"(var {_quote(n)} {_quote(show_type(t))})"
        case ("axiom", n):
            return f"(axiom {_quote(n)})"
        case ("bound_and_witness", n, t, x):
            return f"(bound_and_witness (bound {_quote(n)} {_quote(show_type(t))}) (witness {_quote(show(x))}))"
        case ("inst", pairs):
            return f"(inst {' '.join(f'(subst {_quote(show(a))} {_quote(show(b))})' for a, b in pairs)})"
        case ("insttype", pairs):
            return f"(insttype {' '.join(f'(subst {_quote(a)} {_quote(show_type(b))})' for a, b in pairs)})"
    raise LogicError("bad witness")


def cert_text(c: Cert) -> str:
    """The text form, with all witnesses and declared conclusions."""
    lines = ["(cert"]
    for s in c.steps:
        declared = f" (concl {_quote(show(s.declared))})" if s.declared is not None else ""
        lines.append(f"  (step {s.id} (rule {s.rule}) (witness {witness_text(s.witness)}) (premises {' '.join(map(str, s.premises))}){declared})")
    return "\n".join([*lines, f"  (concl {_quote(show(c.concl))}))"]) + "\n"


# ---- goals and theories: rows (kind, name, arity, body)


def goal_decls(text: str) -> list[tuple[str, str, int | None, str | None]]:
    """Declarations of a goal file; unknown forms are kept as kind ``unknown``; the last goal counts."""
    out, goal = [], None
    for f in read_sexp(text, every=True):
        match f:
            case ["type", n, a]:
                out.append(("type", n, int(a), None))
            case ["const" | "axiom" as kind, n, body]:
                out.append((kind, n, None, body))
            case ["goal", body]:
                goal = ("goal", "goal", None, body)
            case _:
                out.append(("unknown", str(f[0]) if f else "", None, None))
    return [*out, goal] if goal else out


def theory_decls(text: str) -> list[tuple[str, str, int | None, str | None]]:
    """Declarations of a theory file: a line each, # starts a comment."""
    out = []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        kind, _, rest = line.partition(" ")
        if kind == "type":
            n, _, a = rest.strip().partition(" ")
            out.append(("type", n, int(a or 0), None))
        elif kind in ("const", "axiom", "theorem"):
            n, sep, body = rest.partition(":")
            if not sep:
                raise LogicError(f"no ':' in {line!r}")
            out.append((kind, n.strip(), None, body.strip()))
        else:
            raise LogicError(f"unknown declaration {kind}")
    return out


def theory_of(decls) -> Theory:
    """A theory in two passes: types and constants first, then axioms."""
    th = Theory()
    for kind, n, arity, body in decls:
        if kind == "type":
            th.add_type(n, arity or 0)
        elif kind == "const":
            th.add_const(n, parse_type(body))
    for kind, n, _, body in decls:
        if kind == "axiom":
            th.add_axiom(n, parse_term(body, th))
    return th


def goal_text(decls, goal: str) -> str:
    """A goal file for one formula of a theory."""
    form = {"type": lambda n, a, b: f"(type {_quote(n)} {a})", "const": lambda n, a, b: f"(const {_quote(n)} {_quote(b)})", "axiom": lambda n, a, b: f"(axiom {_quote(n)} {_quote(b)})"}
    return "\n".join([*(form[k](n, a, b) for k, n, a, b in decls if k in form), f"(goal {_quote(goal)})"]) + "\n"


def goal_lines(decls: DataFrame) -> DataFrame:
    """(file, last, pos, value): lines of goal files from declarations (file, pos, kind, name, arity, body), native.

    ``last`` sorts goals after all else.  Kinds that a goal file doesn't hold and rows without what their kind needs have no line.
    """

    def quoted(c: str):
        x = F.col(c)
        for plain, marked in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
            x = F.replace(x, F.lit(plain), F.lit(marked))
        return F.concat(F.lit('"'), x, F.lit('"'))

    kind, sp = F.col("kind"), F.lit(" ")
    line = (
        F.when(kind == "type", F.concat(F.lit("(type "), quoted("name"), sp, F.col("arity").cast("string"), F.lit(")")))
        .when(kind.isin("const", "axiom"), F.concat(F.lit("("), kind, sp, quoted("name"), sp, quoted("body"), F.lit(")")))
        .when(kind == "goal", F.concat(F.lit("(goal "), quoted("body"), F.lit(")")))
    )
    return decls.select("file", (kind == "goal").alias("last"), "pos", line.alias("value")).where("value IS NOT NULL")


def write_goal_files(decls: DataFrame, path: str) -> None:
    """Declarations as goal files, one a ``file`` in a folder file=..., line by line: no file is ever held whole."""
    lines = goal_lines(decls).repartition("file").sortWithinPartitions("file", "last", "pos")
    lines.select("file", "value").write.mode("append").partitionBy("file").option("lineSep", "\n").text(path)


def read_decls(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(path, kind, name, arity, body) of goal (``kf``) or theory (``thy``) files."""
    parse = {"kf": goal_decls, "thy": theory_decls}[form]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *d) for p, t in zip(b["path"], b["value"], strict=True) for d in parse(t)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "arity", "body"]).astype({"arity": "Int32"})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, f"path string, {DECLS}")


def read_certs(spark: SparkSession, path: str, theory=None) -> DataFrame:
    """(path, error, pos, step_id, rule, witness_kind, premises, concl): certificate files as step rows.

    An unreadable file gives one row with its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        th = theory() if theory else Theory()
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["value"], strict=True):
                try:
                    c = cert_of_text(t, th)
                except (LogicError, ValueError, RecursionError) as e:
                    rows.append((p, str(e), None, None, None, None, None, None))
                else:
                    rows += [(p, None, k, s.id, s.rule, s.witness[0], s.premises, show(c.concl)) for k, s in enumerate(c.steps)]
            out = pd.DataFrame(rows, columns=["path", "error", "pos", "step_id", "rule", "witness_kind", "premises", "concl"])
            yield out.astype({"pos": "Int32", "step_id": "Int32"})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, "path string, error string, pos int, step_id int, rule string, witness_kind string, premises array<int>, concl string")


def parse_requests(lines: DataFrame) -> DataFrame:
    """(goal_toks, cert_toks, prefix, names) of request lines ``[P k] n toks m toks [H names]``, by native expressions."""
    parts = F.split("value", r"\s+H(?:\s+|$)", 2)
    w = F.split(F.trim(parts[0]), r"\s+")
    pre = w[0] == "P"
    body = F.when(pre, F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0)))).otherwise(w)
    n = body[0].cast("int")
    m = F.get(body, n + 1).cast("int")
    ints = lambda a: F.transform(a, lambda x: x.cast("int"))
    return lines.select(
        ints(F.slice(body, F.lit(2), n)).alias("goal_toks"),
        ints(F.slice(body, n + 3, m)).alias("cert_toks"),
        F.when(pre, w[1].cast("int")).alias("prefix"),
        F.when(F.size(parts) > 1, F.filter(F.split(F.get(parts, F.lit(1)), r"\s+"), lambda x: x != "")).alias("names"),
    )
