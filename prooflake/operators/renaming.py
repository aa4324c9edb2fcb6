"""Sequences up to renaming: symbols get numbers in the order of their first occurrence [DataFrame functions only].

Two sequences are equal up to renaming if their numbers are.  Numbers come from the first place of each symbol, one row a
symbol, so a long sequence is no array; a class is told by 128 bits of hash that are added over (place, number), in any
order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], at: str, symbol: str) -> DataFrame:
    """Adds ``label`` from 0: the rank of a symbol's first place in its sequence.  A null symbol is one of its own."""
    firsts = rows.groupBy(*keys, symbol).agg(F.min(at).alias("__first"))
    firsts = firsts.withColumn("label", (F.row_number().over(Window.partitionBy(*keys).orderBy("__first")) - 1).cast("long"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*keys, symbol)]
    met = rows.alias("r").join(firsts.alias("f"), same)
    return met.select("r.*", "f.label")


def classes(rows: DataFrame, keys: list[str], at: str, symbol: str) -> DataFrame:
    """(keys, n, n_symbols, size, first): the size of a sequence's class and its smallest member, as a struct of the keys."""
    h = [F.sum(F.xxhash64(F.lit(k), at, "label").cast("decimal(20,0)")) for k in range(2)]
    whole = numbered(rows, keys, at, symbol).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("label") + 1).alias("n_symbols"), h[0].alias("__h"), h[1].alias("__g"))
    same = ["n", "__h", "__g"]
    per = whole.groupBy(*same).agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(*keys)).alias("first"))
    return whole.join(per, same).select(*keys, "n", "n_symbols", "size", "first")
