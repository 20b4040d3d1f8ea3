"""What the operators share: tables, folders, and keys that work with nulls."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, one on this machine if all runs on it (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that the driver and the executors of {master} share")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


#: Spark's own setting by which a query's shuffle files go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the shared folder; lost executors cost nothing but a reread.

    The shuffle files that led to it are of no use then and go at once, so a job of many steps holds those of one.
    """
    spark = df.sparkSession
    shared_folder(spark)
    was = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEAN, was)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, want: str) -> str:
    """A column name that no column of df has."""
    while want.lower() in {c.lower() for c in df.columns}:
        want = f"_{want}"
    return want


def about(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by the hash of a key alone: the same ones in every run, without a sort."""
    return df if total <= rows else df.where(F.pmod(key, F.lit(1 << 40)) < F.lit(int(rows / total * (1 << 40))))
