"""Every registered query of the corpus operators that has SQL returns what DuckDB does."""

import duckdb
import pandas as pd
import pytest

from docloom.llm import quality_rules, queries

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    clean = lambda v: "null" if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(tuple(str(clean(v)) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, db, name):
    got, expected = queries.QUERIES[name](spark, DIR).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected) and len(got)


def test_all_labels_certify(spark):
    good = [(i, " ".join(f"w{j}" for j in range(25)), "en") for i in range(500)]
    docs = spark.createDataFrame([*good, (1000, " ".join(f"w{j}" + "#" * 5 for j in range(25)), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    failed = lambda **how: [r["doc_id"] for r in quality_rules.quality_verdicts(docs, labels, **how).where("size(rule_failed) > 0").collect()]
    assert failed() == [1000]
    assert failed(holdout_rows=quality_rules.FOLD) == []
