"""Corpus building: caps, deduplication, funnels, samples, seeding and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The first row of each key by explicit arrival columns."""
    return cap_per_key(df, key, arrival, 1)


def cap_per_key(df: DataFrame, key: list[str], arrival: list[str], k: int) -> DataFrame:
    """At most k rows a key, by arrival: Spark limits each group before it shuffles."""
    w = Window.partitionBy(*key).orderBy(*arrival)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def new_rows(df: DataFrame, known: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """Rows whose key isn't known yet, each key once."""
    return first_per_key(df.join(known.select(*key).distinct(), key, "left_anti"), key, arrival)


def hash_order(ident: Column, seed: int | str = 0) -> Column:
    """A reproducible random order that every engine computes alike."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))


def hash_sample(df: DataFrame, ident: str, n: int, by: list[str], seed: int = 0) -> DataFrame:
    """n rows of each group, without replacement."""
    return cap_per_key(df.withColumn("__h", hash_order(F.col(ident), seed)), by, ["__h", ident], n).drop("__h")


def funnel(df: DataFrame, too_long: Column, key: list[str], arrival: list[str], accepted: Column) -> DataFrame:
    """(reason, n): first failing reason in the order length, duplicate, verdict.

    Duplicates are counted among the rows that pass the length cap, as they would be met one after another.
    """
    w = Window.partitionBy(*key).orderBy(*arrival)
    short = df.where(~too_long).withColumn("__k", F.row_number().over(w)).select(F.when(F.col("__k") > 1, "duplicate").when(~accepted, "rejected").otherwise("kept").alias("reason"))
    long = df.where(too_long).select(F.lit("too_long").alias("reason"))
    return short.unionByName(long).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def seeded(curated: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Curated rows and synthetic rows as one buffer, from round 0."""
    return curated.withColumn("source", F.lit("curated")).unionByName(synthetic.withColumn("source", F.lit("synthetic"))).withColumn("discovered_round", F.lit(0).cast("long"))


def cleaned(df: DataFrame, accepted: Column) -> DataFrame:
    """(source, kept, dropped) of a buffer whose rejected rows go."""
    return df.groupBy("source").agg(F.count_if(accepted).alias("kept"), F.count_if(~accepted).alias("dropped"))
