"""One entry for each query: the Spark plan and, where SQL can say it, the DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.cuts import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that takes long for each row."""
    return spread(table(spark, sf_dir, name))


def views(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark


from . import crawl_queries, graph_queries, text_queries  # noqa: E402, F401
