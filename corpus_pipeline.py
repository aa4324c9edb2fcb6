"""A training-corpus pipeline of four stages, each over everything that the stage before it kept.

quality rules -> n-gram Jaccard join -> secret scan -> packing.  Every stage is (spark, docs, sf_dir) -> DataFrame; its
result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prooflake.llm import ngram_join, packing, quality, secrets_scan
from prooflake.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band.

    Null, empty and blank texts fail the base rules and go; texts are measured whole, however long; repeated rows and
    documents that measure the same share a verdict; a null language is a language of its own; an empty table gives no
    rows; all columns stay as they are, whatever their names.
    """
    return quality.Quality(spark, docs).filter(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of repeated rows one.

    Rows are told apart by id and text: of an id with several texts each is judged by its own group (within a group
    the one with the smallest set id stays).  Null, empty and blank texts link with nothing and all stay, as do rows
    with a null id; whole texts are compared; an empty table gives no rows; all columns stay as they are.
    """
    keep = Scratch(spark, "one-of-each")
    found = keep.keep(ngram_join.ngram_join(spark, docs).documents.where("doc_id IS NOT NULL").select("doc_id", "set_id", "first"), "found")
    flags = found.groupBy(F.col("doc_id").alias("id")).agg((F.count(F.lit(1)) > 1).alias("several"), F.bool_or(~F.col("first")).alias("gone"))
    flags = keep.keep(flags.where("several OR gone"), "flags")
    # the caller's row in one struct: its names can't meet those used here
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("own")).join(flags, "id", "left")
    left = rows.where("several IS NULL")  # ids of one row, which stays
    # ids of several rows: by id and text
    again = ngram_join.set_ids(rows.where("several").select("id", F.col("own.text").alias("text"), "own"))
    gone = found.where("NOT first").select(F.col("doc_id").alias("id"), "set_id").distinct()
    same = Window.partitionBy("id", "set_id").orderBy("own")
    again = again.join(gone, ["id", "set_id"], "left_anti").withColumn("n", F.when(F.col("set_id").isNull(), 1).otherwise(F.row_number().over(same))).where("n = 1")
    return left.select("own.*").unionByName(again.select("own.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark.

    Null and empty texts stay as they are; whole texts are scanned; every row stays, repeated ones too; n_chars follows
    the text; an empty table gives no rows; other columns stay as they are.
    """
    return secrets_scan.redact(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in windows of 2048 ids.

    A null or empty text is a document of the end id alone; long texts are cut into full windows, nothing is dropped;
    repeated rows are documents of their own; an empty table gives no rows; other columns are left out.
    """
    import public_tokenizers

    return packing.pack(spark, docs.select(F.col("doc_id"), F.col("text")), public_tokenizers.path(packing.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", one_of_each_group),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: A language model, a tokenizer and packing aren't SQL: tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    keep = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep.keep(stage(spark, docs, sf_dir), name)
    return docs
