"""One small session for all tests."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return f"{float(v):.6f}" if not float(v).is_integer() else str(int(v))
    return str(v)


@pytest.fixture(scope="session")
def rows_of():
    """Rows of a Spark frame or a DuckDB relation as sorted tuples of plain values, columns by name."""

    def run(x):
        if hasattr(x, "toPandas"):
            names, rows = x.columns, [tuple(r) for r in x.collect()]
        else:
            names, rows = [c[0] for c in x.description], x.fetchall()
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(names), sorted(tuple(_plain(r[i]) if not isinstance(r[i], list) else str([_plain(y) for y in r[i]]) for i in order) for r in rows)

    return run
