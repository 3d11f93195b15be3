"""Every registered query that has SQL against it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry_module.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    df = entry_module.queries()[name](spark, sf)
    sql = entry_module.oracle_sql()[name]
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want
