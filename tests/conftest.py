import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    if hasattr(value, "isoformat"):
        return str(value)[:19]
    return value


@pytest.fixture(scope="session")
def same_as_oracle(spark):
    """Compare a query with its oracle on the smallest test tables."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")

    def check(query, sql):
        rows = query(spark, folder)
        columns = sorted(rows.columns)
        got = sorted((tuple(_plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
        want = con.sql(sql)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(_plain(r[k]) for k in at) for r in want.fetchall()), key=repr)

    return check
