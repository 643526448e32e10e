"""Every query of the image and sequence operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rasterloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(SQL[name])
    have = [c[0] for c in found.description]
    assert sorted(have) == names
    want = sorted(repr(tuple(row[have.index(c)] for c in names)) for row in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select([f"`{c}`" for c in names]).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_of_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
