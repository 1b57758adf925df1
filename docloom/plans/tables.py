"""The corpus tables of a session, each built once: parsing is the costly part of most queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators.verify import line_table
from docloom.plans.scratch import Rounds
from docloom.sources import corpus

_BUILT: dict[tuple[str, str], str] = {}


def _built(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        rounds = Rounds(spark, "corpus")
        rounds.write(corpus.documents(rounds.write(corpus.synthetic(spark, sf_dir), "files")), "docs")
        _BUILT[key] = rounds.root
    return _BUILT[key]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, mtime) of the synthetic corpus."""
    return spark.read.parquet(f"{_built(spark, sf_dir)}/files")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table of the synthetic corpus."""
    return spark.read.parquet(f"{_built(spark, sf_dir)}/docs")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_table(docs(spark, sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> None:
    """The corpus as temporary views, for SQL: docs, lines, links, edges, issues, lint_issues."""
    from docloom.operators import graph, lint, links, verify

    d = docs(spark, sf_dir)
    d.createOrReplaceTempView("docs")
    line_table(d).createOrReplaceTempView("lines")
    links.link_table(d).createOrReplaceTempView("links")
    graph.edges(d).createOrReplaceTempView("edges")
    verify.verify(d).createOrReplaceTempView("issues")
    lint.lint(d).createOrReplaceTempView("lint_issues")
