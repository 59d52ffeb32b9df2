"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(records):
    clean = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr([clean(v) for v in r]) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and (len(want) or not name.startswith("detect_"))
    assert rows(got[columns].itertuples(index=False, name=None)) == rows(want[columns].itertuples(index=False, name=None))


def test_entry(spark):
    assert entry.entry(spark).count() == 200
