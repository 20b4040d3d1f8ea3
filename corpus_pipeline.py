"""A training-data pipeline over `documents`: five stages, each written as Parquet and reread by the next.

Part of the subpackage siteaudit.llm. Each stage takes (spark, docs, sf_dir); all but
the last return the columns of documents; the last adds shard and slot.

On odd rows: null and empty texts aren't toxic, are no duplicates and hold no benchmark
passage, have size 0 in the mix (as many copies as whole epochs of their source) and get
places like others. Rows without a doc_id are judged by their texts. Of rows alike in
every column with words one passes the near-duplicate stage. Very long texts are read
whole by every stage. An empty table passes all stages as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteaudit.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from siteaudit.llm.shared import new_folder, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels that op2 may use."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five words, 0.8)."""
    return near_dedup.remove_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of op6's weights: a row for each copy taken, up to two of a document."""
    return mixing.mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffled places in 16 shards: the columns of documents, shard and slot."""
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained model decides the first stage, so SQL can't express the rows; the tests work all five stages out in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them goes to the shared folder."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
