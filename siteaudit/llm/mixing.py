"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Sizes are summed by source. Sources in code point order (null last) weigh 3, 1, 2,
3, ... and share `share` times all words; no target passes `epochs` times its
source, and what is over is shared again by weight: the water level is found in one
window over the sources. Each source takes floor(target / size) whole epochs. For
the rest its documents are put in the order of a hash key; the key's leading digits
are a range bucket, sums by (source, bucket) give each bucket's offset, and the
prefix sum is finished inside the bucket. So a source with a third of all rows is
spread over all its buckets, and only narrow rows are shuffled. The last document
taken is cut at the exact word.

Nulls: a null source is a source of its own, sorted last; a null text has size 0
and takes 0. A null doc_id has the hash of its row in the key instead, so that such
rows spread over the buckets. Repeated rows are documents each; rows alike in all
columns are interchangeable: `mix_documents` gives as many copies of one of them as
all of them take. A very long text is one number here, its size, and the mix ends
within half of it. Sources of size 0 have target 0. An empty table gives an empty
result. Extra columns pass through `mix_documents` untouched. The windows over the
sources run in one task, on a row of three numbers for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Hex digits of the key that make a range bucket of a source: 4,096 buckets.
DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    # In order of cap / w: a source is capped if the level that the rest would share reaches its cap.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("l")))).over(Window.partitionBy())["l"]
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w"))).select("source", "source_size", "target")


def _key(id_name: str, seed: int, tie: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_name).cast("string"), F.concat(F.lit("null:"), tie.cast("string")))).cast("binary"))


def taken(docs: DataFrame, *, seed: int = 7, tie: str | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, size, tie, source_size, target, whole, part): whole epochs and words of the last, broken one."""
    tie_col = F.col(tie) if tie else F.xxhash64("text")
    narrow = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), tie_col.alias("tie"), _key("doc_id", seed, tie_col).alias("key"))
    narrow = narrow.withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights=weights, share=share, epochs=epochs)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0))).drop("bucket_size")
    goal = goal.select(F.col("source").alias("s"), "source_size", "target")
    starts = starts.join(goal, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = narrow.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - F.col("whole") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("inside"))).cast("long")
    return rows.withColumn("whole", whole).withColumn("part", part).select("doc_id", "source", "size", "tie", "source_size", "target", "whole", "part")


def mix_digest(docs: DataFrame, **options: object) -> DataFrame:
    """The digest of op6: words that the mix takes of each document, repeats counted."""
    t = taken(docs.select("doc_id", "text", "source"), **options)
    return t.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: a row for each copy taken.

    Whole documents only: the one at the cut is kept if at least half of its words
    are within the budget, so each source ends within half a document of its target.
    """
    tie = free_name(docs, "tie")
    mine = docs.withColumn(tie, F.xxhash64(*docs.columns))
    t = taken(mine, tie=tie, **options)
    copies = F.col("whole") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    many, id_, key = (free_name(docs, c) for c in ("copies", "mix_id", "mix_tie"))
    # Rows alike in every column are one: their copies are counted together, and one of them is repeated as often.
    chosen = cut(t.withColumn("copies", copies).groupBy(F.col("doc_id").alias(id_), F.col("tie").alias(key)).agg(F.sum("copies").cast("int").alias(many), F.count("*").alias("alike")).where(F.col(many) > 0))

    def rows_of(some: DataFrame) -> DataFrame:
        return mine.join(some.drop("alike"), mine["doc_id"].eqNullSafe(some[id_]) & (mine[tie] == some[key]))

    if chosen.where("alike > 1").isEmpty():
        rows = rows_of(chosen)
    else:
        rows = rows_of(chosen.where("alike = 1")).union(rows_of(chosen.where("alike > 1")).dropDuplicates([id_, key]))
    return rows.withColumn(many, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) AS cap,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
          - coalesce(sum(CAST(source_size * 2 AS DOUBLE)) OVER (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), g AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * w THEN cap
              ELSE w * first_value(level) OVER (ORDER BY CASE WHEN cap <= level * w THEN 1 ELSE 0 END, cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior,
         CASE WHEN g.source_size > 0 THEN CAST(floor(floor(g.target) / g.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - prior)) AS BIGINT) AS taken
FROM r
"""
