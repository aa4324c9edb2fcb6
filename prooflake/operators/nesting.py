"""Nesting of brackets and tags by prefix sums, and what stands first where it fails [DataFrame functions only].

Tokens are rows.  Their depth is a sum in blocks of ``BLOCK`` tokens plus the sums of the blocks before, so a text of any
length is spread.  An opening token and the closing one that belongs to it have the same level and nothing of that level
between them: each closing token looks at the row before it of its level, in its block, or else at the last one of that
level in the blocks before.  A closing token without an opening one, or with one of another name, is an offence; the first
one is where reading with a stack would stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def tokens(text: Column, pattern: str) -> Column:
    """Array of (i, text, gap): the matches, and the code points between a match and the one before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    return F.transform(F.arrays_zip(found.alias("t"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")), lambda x, i: F.struct(i.alias("i"), x["t"].alias("t"), x["g"].alias("g")))


def nesting(texts: DataFrame, key: str, text: str, pattern: str, name: Column, opens: Column) -> DataFrame:
    """(key, n_tokens, deepest, balanced, place): ``place`` is the offset of the first offence in code points.

    ``name`` and ``opens`` are expressions over a token ``t``.  Where tokens stay open to the end, the place is the text's
    length.  Keys are unique; a null text has no tokens and is balanced.
    """
    whole = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = whole.select("key", tokens(F.col("text"), pattern).alias("ts")).select("key", F.inline("ts"))
    rows = rows.select("key", "i", F.expr(f"i div {BLOCK}").alias("block"), F.length("t").alias("size"), "g", name.alias("name"), F.when(opens, 1).otherwise(-1).alias("sign"))
    inside = Window.partitionBy("key", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("key", "i", "block", "size", "name", "sign", F.sum("sign").over(inside).alias("depth"), (F.sum(F.col("g") + F.col("size")).over(inside) - F.col("size")).alias("offset"))
    ends = rows.groupBy("key", "block").agg(F.sum("sign").alias("d"), F.max(F.col("offset") + F.col("size")).alias("o"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = ends.select("key", "block", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("d0"), F.coalesce(F.sum("o").over(earlier), F.lit(0)).alias("o0"))
    rows = rows.join(starts, ["key", "block"]).select("key", "i", "block", "name", "sign", (F.col("depth") + F.col("d0")).alias("depth"), (F.col("offset") + F.col("o0")).alias("offset"))
    rows = rows.withColumn("level", F.when(F.col("sign") > 0, F.col("depth")).otherwise(F.col("depth") + 1))
    # the row before of the same level, in the block or in the blocks before
    one = F.struct("sign", "name")
    within = Window.partitionBy("key", "block", "level").orderBy("i")
    rows = rows.withColumn("before", F.lag(one).over(within))
    lasts = rows.groupBy("key", "block", "level").agg(F.max_by(one, "i").alias("last"))
    back = Window.partitionBy("key", "level").orderBy("block")  # at most a row a block
    lasts = lasts.select("key", "block", "level", F.lag("last").over(back).alias("carried"))
    met = rows.join(lasts, ["key", "block", "level"]).withColumn("mate", F.coalesce("before", "carried"))
    wrong = (F.col("sign") < 0) & (F.col("mate").isNull() | (F.col("mate.sign") < 0) | (F.col("mate.name") != F.col("name")) | (F.col("level") < 1))
    found = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"), F.sum("sign").alias("left"), F.min(F.when(wrong, F.col("offset"))).alias("at"))
    place = F.coalesce(F.col("at"), F.when(F.col("left") > 0, F.length("text")))
    out = whole.join(found, "key", "left").withColumn("place", place.cast("long"))
    return out.select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).alias("n_tokens"), F.greatest(F.coalesce("deepest", F.lit(0)), F.lit(0)).cast("long").alias("deepest"), F.col("place").isNull().alias("balanced"), "place")


BRACKETS = r"[()\[\]{}]"


def brackets(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Round, square and curly brackets."""
    kind = F.translate("t", ")]}", "([{")
    return nesting(texts, key, text, BRACKETS, kind, F.col("t") == kind)


def tags(texts: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """Start and end tags of the names given, which are lower-case; others and attributes don't matter."""
    pattern = f"(?i)</?(?:{'|'.join(names)})\\b"
    return nesting(texts, key, text, pattern, F.lower(F.regexp_replace("t", "[</]", "")), ~F.col("t").startswith("</"))
