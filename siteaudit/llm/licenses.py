"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of
the same grams in license templates. A match at document position p and template
position t votes for the diagonal p - t. Votes are bit masks of template positions,
so they are combined by bit_or with partial aggregation and repeated rows can't
vote twice. Short templates ("phrases") count only with all their grams on one
diagonal: a place where the phrase's words stand consecutively. Of long templates,
diagonals with at least `MIN_VOTES` votes are merged with neighbours at most
`GAP` apart (words put in or left out), and a merged span is a hit if it covers
`COVER` of the template's grams. Every match is verified by a second, independent
64-bit hash of its words, so a place is right unless 128 bits collide.

The gram table of the templates is broadcast while it has at most `MAX_GRAMS` rows
(24 bytes each); with more, Spark joins by shuffle. Documents themselves are never
shuffled, only (doc_id, text hash, template, diagonal, mask).

Nulls and empty texts have no words and no labels. Rows alike in doc_id and text
get the same result each. Null doc_ids are handled like values. A very long text is
scanned whole; its votes are added up before they are shuffled, and the diagonals of one
template in one document, as many as places that fit, are sorted with spilling. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, text_or_empty

K = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_VOTES, GAP, COVER = 4, 3, 0.6
#: Rows of the gram table that are broadcast at most.
MAX_GRAMS = 100_000
#: Template positions that one mask holds.
_BITS = 62

# Phrases and labels of the base scan.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: The method's own templates: (words, label). Those of up to six words are phrases, too.
TEMPLATES = (
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("apache license version 2 0", "apache-2.0"),
    ("cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("cc by 4 0", "cc-by-4.0"),
    ("mozilla public license", "mpl"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("all rights reserved", "reserved"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
)
PHRASE_WORDS = 6


def words_of(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def gram_table(spark: SparkSession, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(gram, check, template, label, base, exact, grams, t): a row for each gram position of each template."""
    rows = []
    for at, (text, label) in enumerate([*phrases, *templates]):
        w = text.split()
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(at, label, at < len(phrases), at < len(phrases) or len(w) <= PHRASE_WORDS, len(w) - K + 1, t, *w[t : t + K]) for t in range(len(w) - K + 1)]
    df = spark.createDataFrame(rows, "template int, label string, base boolean, exact boolean, grams int, t int, w0 string, w1 string")
    out = df.select(_gram(F.col("w0"), F.col("w1")).alias("gram"), _check(F.col("w0"), F.col("w1")).alias("check"), "template", "label", "base", "exact", "grams", "t")
    return F.broadcast(out) if len(rows) <= max_grams else out


def _gram(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _check(a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(17), b, a)


def spans(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Verified spans: (doc_id, th, label, base, start, cover); start is a word position."""
    w = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), words_of(text_or_empty()).alias("w"))
    pairs = F.zip_with(F.slice(F.col("w"), F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice(F.col("w"), F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(_gram(a, b).alias("g"), _check(a, b).alias("c")))
    grams = w.select("doc_id", "th", F.posexplode(pairs).alias("p", "x")).select("doc_id", "th", "p", F.col("x.g").alias("gram"), F.col("x.c").alias("c"))
    hits = grams.join(gram_table(docs.sparkSession, phrases, templates, max_grams), "gram").where("c = check")
    key = ["doc_id", "th", "template", "label", "base", "exact", "grams"]
    votes = hits.groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal"), F.floor(F.col("t") / _BITS).cast("int").alias("part")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t") % _BITS)).alias("mask"), F.min("p").alias("first")
    )
    by_diagonal = Window.partitionBy(*key, "diagonal")
    votes = votes.withColumn("votes", F.sum(F.bit_count("mask")).over(by_diagonal))
    votes = votes.where(F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise(F.col("votes") >= F.least(F.lit(MIN_VOTES), F.col("grams"))))
    along = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    apart = apart & F.coalesce(F.col("diagonal") != F.lag("diagonal").over(along), F.lit(True))
    votes = votes.withColumn("span", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = votes.groupBy(*key, "span", "part").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("start"))
    merged = merged.groupBy(*key, "span").agg(F.sum(F.bit_count("mask")).alias("n"), F.min("start").alias("start"))
    return merged.withColumn("cover", F.col("n") / F.col("grams")).where(F.col("cover") >= F.when(F.col("exact"), 1.0).otherwise(COVER)).select("doc_id", "th", "label", "base", F.col("start").cast("long"), "cover")


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, max_grams: int = MAX_GRAMS) -> DataFrame:
    """The digest of op9: a row for each document."""
    each = spans(docs, phrases, templates, max_grams)
    place = F.when(F.col("base"), F.col("start"))
    found = each.groupBy("doc_id", "th").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    ).withColumnsRenamed({"doc_id": "d", "th": "h"})
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), F.regexp_count(ascii_lower(text_or_empty()), F.lit(WORD)).cast("long").alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["th"] == found["h"]), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
