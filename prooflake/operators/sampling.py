"""Deterministic probabilities: Laplace rates, softmax with masks and temperatures, mixing, weights, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import six
from .scan import moving_average


def laplace(successes: Column, attempts: Column) -> Column:
    return (successes + 1) / (attempts + 2)


def softmax(df: DataFrame, score: Column, by: list[str], temperature: float = 1.0, allowed: Column | None = None) -> DataFrame:
    """Adds ``p`` over the allowed rows of each group; the others go before the sums."""
    df = df if allowed is None else df.where(allowed)
    w = Window.partitionBy(*by)
    df = df.withColumn("__s", score.cast("double") / temperature)
    df = df.withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(w)))
    return df.withColumn("p", six(F.col("__e") / F.sum("__e").over(w))).drop("__s", "__e")


def mixed(df: DataFrame, p: str, by: list[str], share: float) -> DataFrame:
    """Mix a distribution with the uniform one of its group: adds ``mixed``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("mixed", six((1 - share) * F.col(p) + share / n))


def weights(df: DataFrame, fresh: Column, weight: float = 4.0) -> DataFrame:
    """Adds resampling weights: rows of the current round count more."""
    return df.withColumn("weight", F.when(fresh, F.lit(weight)).otherwise(F.lit(1.0)))


def ema(per_round: DataFrame, at: str, value: str, keep: float = 0.9) -> DataFrame:
    """(at, value, baseline): b <- keep b + (1 - keep) value in round order, from 0; any number of rounds."""
    run = moving_average(per_round, [], [at], value, keep)
    return run.select(at, six(F.col(value)).alias(value), six(F.col("average")).alias("baseline"))


def advantage(df: DataFrame, reward: Column, baseline: Column, top: float = 100) -> DataFrame:
    """Adds the advantage, and whether the entropy bonus applies (less than half of the top reward)."""
    return df.withColumn("advantage", six(reward - baseline)).withColumn("bonus", reward < top / 2)


def top_scores(df: DataFrame, ident: str, scores: str, k: int) -> DataFrame:
    """(ident, rank, place, score): the k highest entries of an array per row, within the row: no shuffle."""
    pairs = F.transform(F.col(scores), lambda x, i: F.struct((-x).alias("neg"), i.alias("place"), x.alias("score")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return df.select(ident, F.posexplode(best).alias("r", "x")).select(ident, (F.col("r") + 1).cast("long").alias("rank"), F.col("x.place").cast("long").alias("place"), F.col("x.score").cast("double").alias("score"))


def uniform(seed: int, *key: Column) -> Column:
    """An integer below 2^32 that depends on the seed and the key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *key)), 1, 8), 16, 10).cast("long")


def shuffled(df: DataFrame, ident: str, seed: int) -> DataFrame:
    """Adds ``place`` from 1 in an order that depends on the seed and the ids alone.

    The order is that of a digest; its first two digits part the rows into 256 runs, whose lengths give the offsets, so
    no task sorts more than a run.
    """
    df = df.withColumn("__h", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(ident)))).withColumn("__b", F.substring("__h", 1, 2))
    runs = df.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    runs = runs.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__from"))  # 256 rows
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", ident))
    return df.join(F.broadcast(runs), "__b").withColumn("place", F.col("__from") + inside).drop("__h", "__b", "__from")


def resampled(df: DataFrame, ident: str, weight: str, n: int, seed: int, buckets: int = 256) -> DataFrame:
    """(draw, ident) of draws 0..n-1 with replacement, each row drawn in proportion to its integer weight.

    Rows with null, zero or negative weight are never drawn; without others there are no draws.  A row of more than a
    bucket's share of the weight is cut into pieces of at most that share; pieces are spread over buckets by hash and
    lie side by side in them.  A draw is a point of the whole weight: the bounded table of bucket totals gives its
    bucket, one merge of points and pieces its row.  Weights sum to less than 2^53.
    """
    rows = df.where(F.col(weight) > 0).select(F.col(ident).alias("id"), F.col(weight).cast("long").alias("w"))
    whole = F.broadcast(rows.agg(F.sum("w").alias("whole")))  # one row
    rows = rows.join(whole).withColumn("n", F.ceil(F.col("w") * buckets / F.col("whole")).cast("long"))
    rows = rows.select("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"), "w", "n")
    cut = lambda i: F.expr(f"w * {i} div n")
    rows = rows.select("id", "piece", (cut("(piece + 1)") - cut("piece")).alias("w")).where("w > 0").withColumn("bucket", uniform(seed, F.col("id"), F.col("piece")) % buckets)
    order = Window.partitionBy("bucket").orderBy("id", "piece")
    totals = rows.groupBy("bucket").agg(F.sum("w").alias("w"))
    ends = totals.select("bucket", "w", F.sum("w").over(Window.orderBy("bucket")).alias("end"))  # as many rows as buckets
    table = ends.agg(F.array_sort(F.collect_list(F.struct("end", "w", "bucket"))).alias("table"), F.max("end").alias("total")).where("total IS NOT NULL")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).join(F.broadcast(table))  # one row
    drawn = F.pmod(uniform(seed, F.col("draw"), F.lit("a")) * (1 << 31) + F.shiftright(uniform(seed, F.col("draw"), F.lit("b")), 1), F.col("total"))
    draws = draws.withColumn("point", drawn).withColumn("in", F.filter("table", lambda x: x["end"] > F.col("point"))[0])
    draws = draws.select(F.col("in.bucket").alias("bucket"), (F.col("point") - F.col("in.end") + F.col("in.w")).alias("at"), F.lit(None).cast(df.schema[ident].dataType).alias("id"), "draw")
    rows = rows.select("bucket", (F.sum("w").over(order) - F.col("w")).alias("at"), "id", F.lit(None).cast("long").alias("draw"))
    merge = Window.partitionBy("bucket").orderBy("at", F.col("draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(draws).withColumn("hit", F.last("id", ignorenulls=True).over(merge))
    return found.where("draw IS NOT NULL").select("draw", F.col("hit").alias(ident))
