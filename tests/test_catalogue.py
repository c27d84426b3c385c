"""Every query of the catalogue that SQL can express, against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarry.plans.governance import QUERIES
from quarry.plans.governance_oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def plain(row):
    return tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    found = sorted(plain(r[c] for c in columns) for r in frame.collect())
    result = tables.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert found == sorted(plain(r[names.index(c)] for c in columns) for r in result.fetchall())


def test_entry_has_rows_and_a_schema(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns and frame.count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
