"""Every registered relational query against its SQL, on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from emberlint import more_queries, queries, structure_queries

assert more_queries and structure_queries  # these register further queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _rows(rows, columns):
    def plain(v):
        if v is None or v != v:
            return None
        return v if isinstance(v, bool) else round(float(v), 6) if isinstance(v, (float, Decimal)) else v if isinstance(v, int) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
