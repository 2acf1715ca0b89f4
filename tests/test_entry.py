"""Every registered query against its SQL, over the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "pages", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rows(frame):
    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return None
        return value.item() if hasattr(value, "item") else value

    ordered = frame[sorted(frame.columns)]
    return sorted(
        (tuple(map(plain, r)) for r in ordered.itertuples(index=False)),
        key=lambda r: tuple(map(str, r)),
    )


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, SF_DIR).toPandas()
    want = duck.execute(entry_module.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and rows(got) == rows(want)


@pytest.mark.parametrize(
    "name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql()))
)
def test_query_without_sql_runs(spark, name):
    assert entry_module.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
