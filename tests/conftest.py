from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Python workers import the package too.
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


def duck(where: str, **tables):
    """DuckDB over a folder of tables; tables given as lists of rows of (columns, rows) replace files."""
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{where}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows_of(frame, names) -> list:
    """Rows in an order that both engines share; doubles to nine digits."""

    import pandas as pd

    def plain(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        if isinstance(v, float):
            return round(v, 9)
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same(spark):
    """Asserts that a query and its SQL give the same rows on a folder of tables."""

    def check(query, sql: str, where: str = SMALL):
        got = query(spark, where).toPandas()
        want = duck(where).sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        assert rows_of(got, names) == rows_of(want, names)

    return check
