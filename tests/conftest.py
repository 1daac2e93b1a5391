import os
import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").appName("tests")
    for k, v in {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def tidy(value):
    """Values as both engines' results are compared: floats to six digits, arrays as tuples."""
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(tidy, value))
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


@pytest.fixture(scope="session")
def oracle():
    """A function of (SQL, folder) to (columns, counted rows) by DuckDB over the folder's tables."""
    import duckdb

    def run(sql, folder=SMALL):
        con = duckdb.connect()
        for f in sorted(os.listdir(folder)):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
        got = con.execute(sql)
        columns = [d[0] for d in got.description]
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(columns), Counter(tuple(tidy(r[i]) for i in order) for r in got.fetchall())

    return run


@pytest.fixture(scope="session")
def rows():
    """A function of a DataFrame to (columns, counted rows)."""

    def run(df):
        columns = sorted(df.columns)
        return columns, Counter(tuple(tidy(r[c]) for c in columns) for r in df.select(*(f"`{c}`" for c in columns)).collect())

    return run
