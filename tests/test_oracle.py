"""Every query with SQL returns what DuckDB does, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from docloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    clean = lambda v: "null" if v is None or v is pd.NA or v != v else int(v) if isinstance(v, bool) or isinstance(v, float) and v == int(v) else v
    return sorted(tuple(str(clean(v)) for v in r) for r in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, db, name):
    got, expected = registry.QUERIES[name](spark, DIR).toPandas(), db.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 21
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
