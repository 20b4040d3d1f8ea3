"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Row numbers: documents fall into hash buckets by doc_id and the hash of all their
columns, so that rows of one doc_id, or without one, spread; a row's number is the
number of rows in the buckets before its own plus its rank (by doc_id, then the
hash of all its columns) within it. Bucket sizes come from one partial aggregation
and are the only thing that travels besides narrow rows. The permutation is an
alternating Feistel network over the a x b rectangle, a = ceil(sqrt(n)),
b = ceil(n / a): each round adds a keyed hash of one half to the other, modulo a
or b. Values outside 0..n-1 (fewer than a of them) walk on along their cycle.
Position p has shard p mod shards and slot p div shards, so both can be computed
for any row number, counts differ by at most one, and slots have no gaps.

Nulls: a null doc_id is a value like any other; a null text has size 1 and the
checksum 0 of the empty text. Repeated rows get a place each (rows alike in every
column share a bucket). A very long text is one row like any other; `place` carries
its size and checksum only. An empty table gives an empty result. Extra columns pass through `shard_documents` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, text_or_empty

#: Hash buckets for numbering rows: 16,384 keep a bucket below a few million rows at 10**10 documents.
BUCKETS = 16_384
ROUNDS = 6
#: Steps of cycle walking; each leaves the rest of at most a/n outside, so 64 are never used up (else it raises).
WALKS = 64


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One application of the permutation of 0..a*b-1."""
    right = F.pmod(x, F.lit(b).cast("long"))
    left = ((x - right) / F.lit(b)).cast("long")
    pair = F.struct(left.alias("l"), right.alias("r"))

    def step(acc: Column, i: Column) -> Column:
        key = lambda half: F.xxhash64(F.lit(seed), i, half)
        even = F.struct(F.pmod(acc["l"] + F.pmod(key(acc["r"]), F.lit(a).cast("long")), F.lit(a).cast("long")).alias("l"), acc["r"].alias("r"))
        odd = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + F.pmod(key(acc["l"]), F.lit(b).cast("long")), F.lit(b).cast("long")).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), pair, step, lambda acc: acc["l"] * F.lit(b).cast("long") + acc["r"])


def permute(x: Column, n: int, seed: int) -> Column:
    """A seeded permutation of 0..n-1, evaluated at x."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    end = F.lit(n).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), feistel(x, a, b, seed), lambda v, _: F.when(v < end, v).otherwise(feistel(v, a, b, seed)))
    return F.when(walked < end, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def number_rows(df: DataFrame, key: str, tie: str, name: str, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """df with a gapless global row number from 0, and the number of rows. `tie` orders rows of one key."""
    part, before = free_name(df, "part"), free_name(df, "before")
    bucket = F.pmod(F.xxhash64(key, tie), F.lit(buckets)).cast("int")
    sizes = df.select(bucket.alias(part)).groupBy(part).agg(F.count("*").alias("rows"))
    sizes = sizes.withColumn(before, F.coalesce(F.sum("rows").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = df.count()
    rank = F.row_number().over(Window.partitionBy(part).orderBy(F.col(key).asc_nulls_first(), F.col(tie)))
    # At most `buckets` rows of two numbers: a broadcast of 256 KB.
    out = df.withColumn(part, bucket).withColumn(name, rank).join(F.broadcast(sizes.select(part, before)), part)
    return out.withColumn(name, (F.col(before) + F.col(name) - 1).cast("long")).drop(part, before), n


def place(docs: DataFrame, *, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """(doc_id, tie, size, text_crc32, shard, slot) of narrow rows; tie is the hash of all columns."""
    narrow = docs.select(
        "doc_id", F.xxhash64(*docs.columns).alias("tie"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(narrow, "doc_id", "tie", "row")
    position = permute(F.col("row"), n, seed)
    return numbered.withColumn("position", position).select(
        "doc_id", "tie", "size", "text_crc32", (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / F.lit(shards)).cast("long").alias("slot")
    )


def shard_digest(docs: DataFrame, *, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """The digest of op3; the law is `rows`: shard counts differ by one at most."""
    placed = place(docs.select("doc_id", "text"), shards=shards, seed=seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, *, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """docs with `shard` and `slot`. Whole rows are dealt out once, by doc_id hash, and numbered where they land."""
    shard, slot, row = (free_name(docs, c) for c in ("shard", "slot", "row"))
    tie = free_name(docs, "tie")
    numbered, n = number_rows(docs.withColumn(tie, F.xxhash64(*docs.columns)), "doc_id", tie, row)
    position = free_name(docs, "position")
    out = numbered.withColumn(position, permute(F.col(row), n, seed))
    return out.select(*docs.columns, (F.col(position) % shards).cast("int").alias(shard), F.floor(F.col(position) / F.lit(shards)).cast("long").alias(slot))
