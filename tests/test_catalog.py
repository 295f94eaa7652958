"""Every query with an oracle against DuckDB on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    """Nullable integers become floats in pandas: whole floats are integers here, on both sides."""
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    level = lambda df: sorted(str([cell(v) for v in row]) for row in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist())
    assert level(got) == level(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
