"""Secret scan: fixed patterns and a randomness test battery [DataFrame functions only].

Base spans are the matches of three patterns.  The battery adds spans of kind ``random``: tokens of 20 or more
characters of the base64 alphabets outside the base spans.  Each token's encoding is inferred from its characters
(hex, base32, base36, base62, base64) and three tests hold it against uniform random characters of that alphabet:
chi-squared on the character counts, a runs test on character classes (digit, upper, other), and lag-one serial
correlation of character codes.  A token that fails any of them (Bonferroni at ``FAIL``) is dropped.

False discoveries are controlled on the other tail of the same statistics.  Ordinary text has many equal characters,
hence a large chi-squared statistic, and few runs of classes: ``p_text`` is the chance that text of the token's length
has a chi-squared statistic so small and so many runs, and for hex and base32 that its letters and digits all happen
to lie in the smaller alphabet; Fisher's method combines these.  Benjamini-Hochberg control at ``Q``, in families by
length and encoding over all tokens of the corpus, tells which are reported.  The families' p-values are binned, so the
step-up thresholds come from a table of bounded size.  Tails are closed forms, whatever the length.

Positions are code points, end exclusive.  Spans come from splitting each text by its pattern and adding up lengths in
blocks, so the work in a text grows with its length and its matches, not with their product.

Defined cases: null and empty texts have no spans; repeated rows are rows of their own; an empty table gives no rows;
further columns are ignored by the query and kept by ``redact``; whole texts are scanned, however long, and tokens of
any length are tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidate tokens of the battery: maximal runs, in the linear pattern's own words.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
FAIL, Q = 0.01, 0.005
#: Rates of ordinary text: changes of class between neighbours, in joined words with capitals and in tokens of one case
#: (between letters and digits); equal characters among pairs (the least of the published indices of coincidence of
#: English, French, German and Spanish); letters that are a to f (the most of these languages); digits that are 2 to 7.
TEXT_CHANGES, TEXT_CHANGES_ONE_CASE, TEXT_COINCIDENCE, TEXT_HEX_LETTERS, TEXT_BASE32_DIGITS = 0.25, 0.1, 0.065, 0.4, 0.6
#: p-values are binned by their -log10 in steps of 1 / BINS up to TOP.
BINS, TOP = 20, 16
#: Elements that an array is scanned by, and characters of a token that are looked at in one array.
BLOCK, PIECE = 128, 4096
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
MARK = "[SECRET]"


_SPANS = "array<struct<s:int,e:int,k:int>>"
_TOKENS = "array<struct<s:int,e:int,token:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan_array(values: Column, zero: Column, op: Callable[[Column, Column], Column], type_: str = "int") -> Column:
    """For each element what ``op`` (associative, ``zero`` neutral) makes of all elements before it, block by block."""

    def inner(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast(f"array<{type_}>").alias("out"))
        return F.aggregate(part, state, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def blocks_of(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    def scanned(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, zero, op))
        return F.flatten(F.zip_with(blocks, inner(totals, zero), inner))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks_of(v), scanned)).otherwise(F.array().cast(f"array<{type_}>")))


def _found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (s, e, k, token) of a pattern's matches whose group has at least ``least`` characters."""
    p = F.lit(pattern)
    match = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    if group:
        sized = F.zip_with(match, F.regexp_extract_all(text, p, F.lit(group)), lambda m, v: F.struct(F.length(m).alias("m"), v.alias("v")))
    else:
        sized = F.transform(match, lambda m: F.struct(F.length(m).alias("m"), m.alias("v")))

    def placed(rows: Column) -> Column:
        whole = F.zip_with(rows, F.slice(gaps, F.lit(1), F.size(rows)), lambda r, g: F.struct(g.alias("g"), r["m"].alias("m"), r["v"].alias("v")))

        def spans(w: Column) -> Column:
            before = scan_array(F.transform(w, lambda x: x["g"] + x["m"]), F.lit(0), lambda a, x: a + x)
            k = F.lit(KINDS.index(kind))
            all_ = F.zip_with(w, before, lambda x, b: F.struct((b + x["g"]).alias("s"), (b + x["g"] + x["m"]).alias("e"), k.alias("k"), x["v"].alias("token")))
            return F.filter(all_, lambda x: F.length(x["token"]) >= least)

        return _let(whole, spans)

    return _let(sized, placed)


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """(s, e, k) of the matches, without work for texts that the pattern isn't in."""
    found = F.transform(_found(text, pattern, kind, group, least), lambda x: F.struct(x["s"], x["e"], x["k"])).cast(_SPANS)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _free(tokens: Column, base: Column) -> Column:
    """Tokens (s, e, k, token) that overlap no base span: one scan from the left and one from the right by start."""
    no = F.lit(None).cast("string")
    both = F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), no.alias("token"))), F.transform(tokens, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["token"].alias("token")))))
    own, most = KINDS.index("random"), F.lit(2**31 - 1)

    def kept(b: Column) -> Column:
        ends = scan_array(F.transform(b, lambda x: F.when(x["k"] == own, F.lit(0)).otherwise(x["e"])), F.lit(0), lambda a, x: F.greatest(a, x))
        starts = F.reverse(scan_array(F.reverse(F.transform(b, lambda x: F.when(x["k"] == own, most).otherwise(x["s"]))), most, lambda a, x: F.least(a, x)))
        beside = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        marked = F.zip_with(b, beside, lambda x, y: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["token"].alias("token"), ((x["k"] == own) & (y["e"] <= x["s"]) & (y["s"] >= x["e"])).alias("free")))
        return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: F.struct(x["s"], x["e"], x["token"]))

    return _let(both, kept).cast(_TOKENS)


def _digest(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _in_order(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


def upper_tail(z: Column) -> Column:
    """P(N > z), by the rational approximation of Abramowitz and Stegun (26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * F.lit(1.330274429)))))
    tail = F.exp(-a * a / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x), by Wilson and Hilferty."""
    return upper_tail((F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def poisson_upto(k: Column, rate: Column) -> Column:
    """P(X <= k) of a Poisson variable, k >= 0: the tail of a chi-squared variable of 2 (k + 1) degrees beyond 2 rate."""
    return F.when(k < 1, F.exp(-rate)).otherwise(chi2_tail(2 * rate, 2 * (k + 1)))


def poisson_from(k: Column, rate: Column) -> Column:
    """P(X >= k) of a Poisson variable: 1 for k = 0, else the lower tail of a chi-squared variable of 2 k degrees."""
    df = 2 * F.greatest(k, F.lit(1.0))
    lower = upper_tail(-(F.pow(2 * rate / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    return F.when(k < 1, F.lit(1.0)).when(k < 2, -F.expm1(-rate)).otherwise(lower)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, size of its alphabet, the three p-values against randomness and ``p_text`` to (token) rows."""
    t = F.col("token")
    encoding = (
        F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(t.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), F.lit("base32"))
        .when(t.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), F.lit("base36"))
        .when(t.rlike("^[0-9A-Za-z]+$"), F.lit("base62"))
        .otherwise(F.lit("base64"))
    )
    size = F.when(F.col("encoding") == "hex", 16).when(F.col("encoding") == "base32", 32).when(F.col("encoding") == "base36", 36).when(F.col("encoding") == "base62", 62).otherwise(64)
    left = lambda x: F.length(F.replace(t, x, F.lit("")))
    squares = F.aggregate(F.array(*map(F.lit, ALPHABET)), F.lit(0.0), lambda s, x: s + F.pow((F.length(t) - left(x)).cast("double"), F.lit(2.0)))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[0-9]", "0"), "[A-Z]", "A"), "[^0A]", "z")
    out = tokens.withColumn("encoding", encoding).withColumn("a", size.cast("double")).withColumn("n", F.length(t).cast("double")).withColumn("sq", squares).withColumn("classes", classes)
    c = F.col("classes")
    out = out.withColumn("digits", F.length(F.regexp_replace(c, "[^0]", "")).cast("double")).withColumn("uppers", F.length(F.regexp_replace(c, "[^A]", "")).cast("double"))
    out = out.withColumn("changes", F.regexp_count(c, F.lit("(?<=0)[^0]|(?<=A)[^A]|(?<=z)[^z]")).cast("double"))
    # chi-squared against equal frequencies
    out = out.withColumn("chi2", F.col("a") / F.col("n") * F.col("sq") - F.col("n"))
    out = out.withColumn("p_chi2", chi2_tail(F.col("chi2"), F.col("a") - 1))
    # runs of character classes, given how often each occurs
    share = sum((F.pow(x / F.col("n"), F.lit(2.0)) for x in (F.col("digits"), F.col("uppers"), F.col("n") - F.col("digits") - F.col("uppers"))), F.lit(0.0))
    out = out.withColumn("p_change", (1 - share) * F.col("n") / (F.col("n") - 1))
    spread = F.sqrt((F.col("n") - 1) * F.col("p_change") * (1 - F.least(F.col("p_change"), F.lit(0.999))) + 1e-9)
    out = out.withColumn("p_runs", F.least(F.lit(1.0), 2 * upper_tail(F.abs(F.col("changes") - (F.col("n") - 1) * F.col("p_change")) / spread)))
    # lag-one serial correlation of the codes, from sums over pieces that overlap by a character
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("x", "xx", "xy", "first", "last")))

    def sums(acc: Column, i: Column) -> Column:
        piece = F.transform(F.split(F.substring(t, i * PIECE + 1, F.lit(PIECE)), ""), lambda x: F.ascii(x).cast("double"))

        def added(v: Column) -> Column:
            inner = F.aggregate(
                v,
                F.struct(acc["x"].alias("x"), acc["xx"].alias("xx"), acc["xy"].alias("xy"), acc["last"].alias("last")),
                lambda s, x: F.struct((s["x"] + x).alias("x"), (s["xx"] + x * x).alias("xx"), (s["xy"] + s["last"] * x).alias("xy"), x.alias("last")),
            )
            return _let(inner, lambda s: F.struct(s["x"].alias("x"), s["xx"].alias("xx"), s["xy"].alias("xy"), F.when(i == 0, v[0]).otherwise(acc["first"]).alias("first"), s["last"].alias("last")))

        return _let(F.filter(piece, lambda x: x > 0), added)

    pieces = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))
    out = out.withColumn("s", F.aggregate(pieces, zero, sums)) if "s" not in tokens.columns else out.withColumn("__s", F.aggregate(pieces, zero, sums))
    own = "__s" if "s" in tokens.columns else "s"
    x, xx, xy, first, last = (F.col(f"{own}.{k}") for k in ("x", "xx", "xy", "first", "last"))
    mean = x / F.col("n")
    var = xx - F.col("n") * mean * mean
    cov = xy - mean * (2 * x - first - last) + (F.col("n") - 1) * mean * mean
    out = out.withColumn("r", F.when(var > 1e-6, cov / var).otherwise(F.lit(1.0))).drop(own)
    out = out.withColumn("p_serial", F.least(F.lit(1.0), 2 * upper_tail(F.abs(F.col("r") + 1 / F.col("n")) * F.sqrt(F.col("n")))))
    # the other tail: what ordinary text would show
    least = F.lit(10.0**-TOP)
    one_case = F.col("encoding").isin("hex", "base32", "base36")
    rate = F.when(one_case, F.lit(TEXT_CHANGES_ONE_CASE)).otherwise(F.lit(TEXT_CHANGES))
    many = F.greatest(poisson_from(F.col("changes"), (F.col("n") - 1) * rate), least)
    pairs = (F.col("sq") - F.col("n")) / 2  # the chi-squared statistic is 2 a pairs / n + a - n
    few = F.greatest(poisson_upto(pairs, F.col("n") * (F.col("n") - 1) / 2 * TEXT_COINCIDENCE), least)
    few = F.when(F.col("encoding") == "hex", 1.0).otherwise(few)  # text has no more equal characters than sixteen signs
    mixed = (F.col("digits") > 0) & (F.col("digits") < F.col("n"))  # a number is no random string
    chance = F.when(F.col("encoding") == "hex", F.pow(F.lit(TEXT_HEX_LETTERS), F.col("n") - F.col("digits"))).when(F.col("encoding") == "base32", F.pow(F.lit(TEXT_BASE32_DIGITS), F.col("digits"))).otherwise(F.lit(1.0))
    inside = F.when(mixed, F.greatest(chance, least)).otherwise(F.lit(1.0))
    third = F.col("encoding").isin("hex", "base32").cast("int")
    # Fisher's method: -sum(log p) of k tests exceeds y with chance exp(-y) (1 + y + ... + y^(k-1) / (k-1)!)
    y = -(F.log(F.least(many, F.lit(1.0))) + F.log(F.least(few, F.lit(1.0))) + F.log(inside))
    out = out.withColumn("__y", y).withColumn("p_text", F.least(F.lit(1.0), F.exp(-F.col("__y")) * (1 + F.col("__y") + third * F.col("__y") * F.col("__y") / 2)))
    return out.drop("__y", "classes")


def _tested(tokens: DataFrame) -> DataFrame:
    """Families, bins and whether the battery passes, of rows (doc_id, row, s, e, token)."""
    out = battery(tokens)
    random = F.least("p_chi2", "p_runs", "p_serial") * 3 >= FAIL
    length = F.floor(F.log2("n") * 2).cast("int")  # lengths that differ by less than a half
    level = F.least(F.lit(BINS * TOP), F.floor(-F.log10(F.greatest("p_text", F.lit(1e-300))) * BINS)).cast("int")  # rounded up to the bin's p
    return out.select("row", "s", "e", F.concat_ws("/", "encoding", length.cast("string")).alias("family"), level.alias("level"), random.alias("random"))


def thresholds(tested: DataFrame) -> DataFrame:
    """(family, least level that Benjamini-Hochberg reports), from at most BINS * TOP + 1 rows a family."""
    n = tested.groupBy("family", "level").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("family").orderBy(F.desc("level"))
    n = n.withColumn("k", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("family")))
    p = F.pow(F.lit(10.0), -F.col("level") / F.lit(float(BINS)))
    return n.where(p <= F.lit(Q) * F.col("k") / F.col("m")).groupBy("family").agg(F.min("level").alias("least"))


def _marked(docs: DataFrame) -> DataFrame:
    """Adds base spans and the battery's candidate tokens outside of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, "assign", 2, 6), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    out = docs.withColumn("__base", base)
    none = F.array().cast(_TOKENS)
    return out.withColumn("__tokens", F.when(text.rlike(TOKEN), _free(_found(text, TOKEN, "random"), F.col("__base"))).otherwise(none))


def _decided(keep: Scratch, rows: DataFrame) -> DataFrame:
    """``spans`` of kept rows: the base spans and the tokens that are reported."""
    some = rows.where(F.size("__tokens") > 0)
    tokens = some.select("__row", F.explode("__tokens").alias("x")).select(F.col("__row").alias("row"), "x.s", "x.e", "x.token")
    tested = keep.keep(_tested(tokens), "tested")
    said = tested.join(thresholds(tested), "family").where("random AND level >= least")
    said = said.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("s", "e", F.lit(3).alias("k"))).cast(_SPANS).alias("__more"))
    none = F.array().cast(_SPANS)
    out = some.join(said, "__row", "left").unionByName(rows.where(F.size("__tokens") <= 0).withColumn("__more", none))
    return out.withColumn("spans", _in_order(F.concat("__base", F.coalesce("__more", none)))).withColumn("base_spans", _in_order(F.col("__base"))).drop("__base", "__tokens", "__row", "__more")


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, spans, base_spans) of every document, spans (s, e, k) by start, then kind; texts aren't shuffled."""
    keep = Scratch(spark, "secrets")
    rows = _marked(docs.select("doc_id", "text")).select("doc_id", "__base", "__tokens").withColumn("__row", F.monotonically_increasing_id())
    return _decided(keep, keep.keep(rows, "found"))


def _replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each of ``spans`` (by start; overlapping ones as one) replaced: parts are cut out of parts."""

    def pieces(rows: Column) -> Column:  # (after, s): the text in between stays, then comes a mark
        def part(i: Column) -> Column:
            own = F.slice(rows, i * BLOCK + 1, F.lit(BLOCK))

            def cut(o: Column) -> Column:
                at = o[0]["after"]
                segment = F.substring(text, at + 1, F.element_at(o, -1)["s"] - at)
                return _let(segment, lambda g: F.array_join(F.transform(o, lambda x: F.concat(F.substring(g, x["after"] - at + 1, x["s"] - x["after"]), F.lit(mark))), ""))

            return _let(own, cut)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), part), "")

    def cleaned(x: Column) -> Column:
        before = scan_array(F.transform(x, lambda y: y["e"]), F.lit(0), lambda a, y: F.greatest(a, y))
        rows = F.filter(F.zip_with(x, before, lambda y, b: F.struct(b.alias("after"), y["s"].alias("s"))), lambda y: y["s"] >= y["after"])
        end = F.aggregate(x, F.lit(0), lambda a, y: F.greatest(a, y["e"]))
        return F.concat(_let(rows, pieces), _let(end, lambda e: F.substring(text, e + 1, F.length(text) - e)))

    return _let(spans, cleaned)


def redact(spark: SparkSession, docs: DataFrame, mark: str = MARK) -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by ``mark``; all columns stay.

    Only documents with candidate tokens are set aside for the corpus-wide tests; the others are redacted in one pass.
    """
    keep = Scratch(spark, "redact")
    # the caller's columns travel in one struct, so none of their names can meet one of those below
    rest = [c for c in docs.columns if c != "text"]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in rest}
    own = F.struct(*(quoted[c] for c in rest)) if rest else F.lit(None).cast("string")
    text = F.col("text")
    rows = _marked(docs.select(own.alias("__own"), "text"))
    some = keep.keep(rows.where(F.size("__tokens") > 0).withColumn("__row", F.monotonically_increasing_id()), "some")
    plain = rows.where(F.size("__tokens") <= 0).withColumn("spans", _in_order(F.col("__base")))
    found = plain.select("__own", "text", "spans").unionByName(_decided(keep, some).select("__own", "text", "spans"))
    clean = _replaced(text, F.col("spans"), mark)
    out = found.select("__own", "spans", F.when(F.size("spans") > 0, clean).otherwise(text).alias("text"))

    def column(name: str, kind: str) -> Column:
        if name == "text":
            return text
        value = F.col("__own").getField(name)
        if name == "n_chars":  # follows the text
            value = F.when(F.size("spans") > 0, F.length("text")).otherwise(value).cast(kind)
        return value.alias(name)

    return out.select(*(column(c, t) for c, t in docs.dtypes))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of the documents."""
    found = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    more = F.size(F.filter("spans", lambda x: x["k"] == 3)).cast("long").alias("n_random")
    return found.select("doc_id", *n, F.sha2(_digest(F.col("base_spans")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), more)
