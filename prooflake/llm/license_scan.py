"""License scan: phrase labels and an exact containment join of text blocks with templates [DataFrame functions only].

Base labels come from phrases of consecutive words.  The method finds every block that holds at least ``PERCENT`` of a
template's distinct words.  A block is a window of 2 W words, one at every W-th word, where W is twice the words of the
longest template: blocks run over line breaks, so wrapped licenses are found, and any passage of W words lies in one.

Tokens are ordered by how many documents have them, rarest first, over the whole corpus.  A block that meets the
threshold has one of the first |T| - ceil(t |T|) + 1 tokens of the template, so blocks are joined by token with an
inverted index of these alone (prefix filter).  A block needs ceil(t |T|) distinct template words (length filter), and if
the first token it shares stands at place i of the template's order, |T| - i must still reach the threshold (positional
filter); what passes is verified exactly.  Templates are a table parameter of bounded size; texts aren't shuffled.

Defined cases: null and empty texts have no words; words are runs of ASCII letters and digits and of all characters
beyond ASCII, with A-Z lower-cased; templates without words or without a label are left out, of a label with several
templates any one is enough; repeated rows are rows of their own; an empty table gives no rows; further columns of the
input are ignored; whole texts are scanned, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .secrets_scan import _let, scan_array

#: Fixed by the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PERCENT = 80
#: Distinctive sentences of public licenses, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "gpl-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Not in a word, once A-Z are lower-cased; on raw text capitals are in words too.
_GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_RAW_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_WORD = f"[^{_RAW_GAP}]+"


def template_words(text: str) -> list[str]:
    """Distinct words of a template, by the same rule."""
    import re

    return sorted(set(re.findall(f"[^{_GAP}]+", "".join(c.lower() if c.isascii() else c for c in text))))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.filter(F.split(_lower(text), f"[{_GAP}]+"), lambda w: w != "")


def _phrase(words: str) -> str:
    """Pattern of a phrase on raw text: whole words, anything but words between."""
    return f"(?i)(?<![^{_RAW_GAP}])" + f"[{_RAW_GAP}]+".join(words.split()) + f"(?![^{_RAW_GAP}])"


def _starts(text: Column, pattern: str) -> Column:
    """Word number of each place of a phrase: the words before it."""
    gaps = F.split(text, pattern, -1)
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = lambda x: F.regexp_count(x, F.lit(_WORD)).cast("long")
    sized = F.transform(F.arrays_zip(own.alias("m"), F.slice(gaps, F.lit(1), F.size(own)).alias("g")), lambda x: F.struct(n(x["g"]).alias("g"), n(x["m"]).alias("m")))

    def placed(s: Column) -> Column:
        before = scan_array(F.transform(s, lambda y: y["g"] + y["m"]), F.lit(0).cast("long"), lambda a, y: a + y, "bigint")
        return F.zip_with(s, before, lambda y, b: b + y["g"])

    return _let(sized, placed)


def _base(text: Column) -> Column:
    """Map label -> word numbers of its phrase."""
    none = F.array().cast("array<bigint>")
    return F.struct(*(F.when(text.rlike(_phrase(p)), _starts(text, _phrase(p))).otherwise(none).alias(label) for p, label in PHRASES.items()))


def block_words(templates: dict[str, str]) -> int:
    """W: twice the words of the longest template, repeated ones too."""
    import re

    return 2 * max((len(re.findall(f"[^{_RAW_GAP}]+", t)) for t in templates.values()), default=1)


def template_index(templates: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(token, place, label, template, size, need) of the templates' prefixes, from (label, template, words) rows.

    ``found``: (token) rows, one for each document and template token in it.
    """
    tokens = templates.select("template", F.size("words").alias("size"), "label", F.explode("words").alias("token"))
    seen = found.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    order = Window.partitionBy("template").orderBy(F.coalesce("seen", F.lit(0)), "token")
    need = F.expr(f"(size * {int(percent)} + 99) div 100").cast("int")
    ranked = tokens.join(seen, "token", "left").withColumn("place", F.row_number().over(order) - 1).withColumn("need", need)
    return ranked.where("place <= size - need").select("token", "place", "label", "template", "size", "need")


def block_matches(blocks: DataFrame, index: DataFrame, templates: DataFrame, percent: int) -> DataFrame:
    """(row, label, containment) of every block (row, own: its distinct template words) that meets a threshold."""
    tokens = blocks.select("row", "own", F.monotonically_increasing_id().alias("block"), F.explode("own").alias("token"))
    pairs = tokens.join(index, "token").where(F.size("own") >= F.col("need"))
    # places are counted from 0: from the first shared one on, enough tokens must be left
    first = pairs.groupBy("block", "template").agg(F.min("place").alias("place"), F.first("row").alias("row"), F.first("own").alias("own"), F.first("size").alias("size"), F.first("need").alias("need"))
    passed = first.where("size - place >= need").join(templates.select("template", "label", "words"), "template")
    hits = passed.select("row", "label", (F.size(F.array_intersect("words", "own")) / F.col("size")).alias("containment"))
    return hits.where(F.col("containment") * 100 >= percent).groupBy("row", "label").agg(F.max("containment").alias("containment"))


def _blocks(words: Column, wide: int) -> Column:
    """Windows of 2 ``wide`` words, one at every ``wide``-th word."""
    last = F.greatest(F.lit(0), F.ceil(F.size(words) / wide).cast("int") - 2)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * wide + 1, F.lit(2 * wide)))


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, places per base label, template hits): one row per document.

    ``templates``: texts by label, or a table (label, text) with any number of texts a label; it is read to the driver.
    """
    keep = Scratch(spark, "licenses")
    if isinstance(templates, DataFrame):
        given = [(r.label, r.text) for r in templates.select("label", "text").collect()]  # the parameter, not the corpus
    else:
        given = list((TEMPLATES if templates is None else templates).items())
    given = [(k, t, w) for k, t in given if k is not None and t is not None and (w := template_words(t))]
    vocabulary = sorted({x for _, _, w in given for x in w}) or [""]
    least = min((-(-percent * len(w) // 100) for _, _, w in given), default=2**31 - 1)
    table = keep.keep(spark.createDataFrame([(i, k, w) for i, (k, _, w) in enumerate(given)], "template int, label string, words array<string>"), "templates")
    wide = block_words({i: t for i, (_, t, _) in enumerate(given)})
    known = F.array(*map(F.lit, vocabulary))
    text = F.coalesce(F.col("text"), F.lit(""))
    all_words = _words(text)
    rows = docs.select("doc_id", text.alias("text"), all_words.alias("words"))
    # a text with fewer template words than any template needs has no block to test
    tokens = F.array_intersect("words", known)
    blocks = F.filter(F.transform(_blocks(F.col("words"), wide), lambda w: F.array_intersect(w, known)), lambda w: F.size(w) >= least)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), _base(F.col("text")).alias("base"), "words", tokens.alias("tokens"))
    rows = rows.select("doc_id", "n_words", "base", "tokens", F.when(F.size("tokens") >= least, blocks).alias("blocks"))
    rows = keep.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    index = keep.keep(template_index(table, rows.select(F.explode("tokens").alias("token")), percent), "index")
    hits = block_matches(rows.select("row", F.explode("blocks").alias("own")), index, table, percent)
    hits = hits.groupBy("row").agg(F.collect_set("label").alias("labels"), F.max("containment").alias("containment"))  # at most one row a label
    hits = keep.keep(hits, "hits")
    return rows.select("row", "doc_id", "n_words", "base").join(hits, "row", "left").drop("row")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every whole text of the documents."""
    out = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    places = F.concat(*(F.col("base")[label] for label in PHRASES.values()))
    base = F.array_compact(F.array(*(F.when(F.size(F.col("base")[label]) > 0, F.lit(label)) for label in PHRASES.values())))
    more = F.coalesce("labels", F.array().cast("array<string>"))
    out = out.withColumn("places", places).withColumn("__base", base)
    score = F.when(F.size("__base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join(F.array_sort("__base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("__base", more))), ",").alias("labels"),
        score.alias("score"),
    )
