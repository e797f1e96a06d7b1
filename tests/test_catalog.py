"""Every query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from sylvan.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return sorted([tuple(None if v is None or v != v else f"{float(v):.8g}" if isinstance(v, (int, float)) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE])
def test_query(spark, sf, db, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), db.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
