"""Corpora as DataFrames: any table with path, content and mtime becomes the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import ids as I

#: File-name prefixes of test documents (fixed values).
TEST_PREFIXES = ("TRAP_", "AUTOTEST_", "QUANTUM_TRAP_", "TEST_", "HARDTEST_")
STATS_PREFIXES = TEST_PREFIXES[:3]

#: Frontmatter fields that become columns, by the column's name.
FIELDS = {
    "doc_id": "id", "title": "title", "parent": "parent", "breadcrumb": "breadcrumb", "doc_type": "type", "status": "status",
    "last_updated": "last_updated", "children_count": "children_count", "content_hash": "content_hash",
}


def documents(files: DataFrame) -> DataFrame:
    """(path, content, mtime) and what is read off them. Every derived column is an expression, so a query that needs
    few of them computes few, and path filters reach the scan."""
    yaml = F.col("yaml_raw")
    return (
        files.withColumns({
            "file_name": F.substring_index("path", "/", -1),
            "rel_depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
            "size": F.octet_length("content").cast("long"),
            "has_fm": Y.has_frontmatter(F.col("content")),
            "fm_closed": Y.closing_offset(F.col("content")).isNotNull(),
            "yaml_raw": Y.yaml_text(F.col("content")),
        })
        .withColumn("stem", F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""))
        .withColumns({column: Y.field(yaml, name) for column, name in FIELDS.items()})
    )


def parsed(files: DataFrame) -> DataFrame:
    """(path, the fields of the typed frontmatter, body, parse_error, valid): every file has a row; leave out those with a
    parse_error to load what can be read. Valid is an id of dotted numbers and a title, neither empty."""
    text = files.select("path", F.regexp_replace("content", r"(?U)^\s+", "").alias("content"))
    cut = text.select("path", Y.yaml_text(F.col("content")).alias("yaml"), Y.body(F.col("content")).alias("body"))
    out = cut.withColumn("f", Y.typed(F.col("yaml"))).select("path", "f.*", F.regexp_replace("body", r"(?U)^\s+", "").alias("body"))
    good = F.col("parse_error").isNull() & (F.col("title") != "") & I.parts(F.col("id")).isNotNull()
    return out.withColumn("valid", F.coalesce(good, F.lit(False)))


def validity(parsed_docs: DataFrame) -> DataFrame:
    """One row: documents, valid ones, those that can't be read."""
    return parsed_docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if("valid").alias("valid"), F.count_if(F.col("parse_error").isNotNull()).alias("errors"))


def without_tests(docs: DataFrame, prefixes: tuple[str, ...] = TEST_PREFIXES) -> DataFrame:
    return docs.where(~F.col("file_name").rlike("^(" + "|".join(prefixes) + ")"))


def scan(docs: DataFrame, exclude: list[str] = (), root_only: bool = False, max_depth: int | None = None, hidden: bool = True) -> DataFrame:
    """Path filters; all of them push down."""
    for part in exclude:
        docs = docs.where(~F.col("path").contains(part))
    if root_only:
        docs = docs.where(~F.col("path").contains("/"))
    if max_depth is not None:
        docs = docs.where(F.col("rel_depth") < max_depth)
    if not hidden:
        docs = docs.where(~F.col("path").rlike(r"(^|/)\."))
    return docs


TABLES = ("customer", "nation", "region", "documents")
#: The synthetic corpus, in SQL that Spark and DuckDB both read but for SHA-256: a file per row of documents with its whole
#: text, below the nation of the customer at doc_id modulo the number of customers, and files for nations and regions. The
#: faults that phases and rules look for are added by rules on k, which is doc_id.
CORPUS_SQL = r"""
base AS (
  SELECT doc_id AS k, n_nationkey + 1 AS n, n_regionkey + 1 AS r, c_mktsegment AS seg, text AS body
  FROM (SELECT doc_id, text, doc_id % m AS c FROM {documents} CROSS JOIN (SELECT count(*) AS m FROM {customer}) s) d
  JOIN {customer} ON c_custkey = c JOIN {nation} ON c_nationkey = n_nationkey
),
kids AS (SELECT n, count(*) AS kids FROM base WHERE k % 41 <> 0 GROUP BY n),
parts AS (
  SELECT '0. Master.md' AS path, 0 AS day, 0 AS half,
    concat('---', chr(10), 'id: 0', chr(10), 'title: Master', chr(10), 'breadcrumb: "0"', chr(10), 'type: indice', chr(10), 'status: activo', chr(10)) AS head,
    concat('---', chr(10), chr(10), '# Master', chr(10), chr(10), 'All regions are below.', chr(10)) AS tail, 'none' AS hash
  UNION ALL
  SELECT concat('Reg-', r_regionkey + 1, '.md'), r_regionkey % 28, 0,
    concat('---', chr(10), 'id: "', r_regionkey + 1, '"', chr(10), 'title: ', r_name, chr(10), 'parent: 0', chr(10), 'parent_id: "0. Master"', chr(10),
      'breadcrumb: Master > ', r_regionkey + 1, chr(10), 'type: modulo_padre', chr(10), 'status: aceptado', chr(10), 'module: M', r_regionkey + 1, chr(10),
      'last_updated: "2024-01-', lpad(CAST(r_regionkey % 28 + 1 AS VARCHAR(2)), 2, '0'), '"', chr(10)),
    concat('---', chr(10), chr(10), '# ', r_name, chr(10), chr(10), 'Region of nations.', chr(10)), 'none'
  FROM {region}
  UNION ALL
  SELECT concat('Nat-', n_nationkey + 1, '.md'), n_nationkey % 28, 0,
    concat('---', chr(10), 'id: ', n_regionkey + 1, '.', n_nationkey + 1, chr(10), 'title: ', n_name, chr(10), 'parent: ', n_regionkey + 1, chr(10),
      'parent_id: Reg-', n_regionkey + 1, chr(10), 'breadcrumb: Master > ', n_regionkey + 1, ' > ', n_regionkey + 1, '.', n_nationkey + 1, chr(10),
      'type: seccion', chr(10), 'status: activo', chr(10), 'module: M', n_regionkey + 1, chr(10),
      'children_count: ', coalesce(kids, 0) + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END, chr(10)),
    concat('---', chr(10), chr(10), '# ', n_name, chr(10), chr(10), 'Nation of customers, see [[Reg-', n_regionkey + 1, ']].', chr(10), chr(10),
      '| Doc | Nietos |', chr(10), '|---|---|', chr(10), '| [[', n_regionkey + 1, '.', n_nationkey + 1, ' all]] | ', n_nationkey % 3, ' |', chr(10)), 'none'
  FROM {nation} LEFT JOIN kids ON kids.n = n_nationkey + 1
  UNION ALL
  SELECT concat('c/Cust-', k, '.md'), k % 28, k % 4,
    concat(CASE WHEN k % 83 = 7 THEN '' ELSE concat('---', chr(10)) END, 'id: ', CASE WHEN k % 53 = 1 THEN concat('9.9.', k % 3) ELSE concat(r, '.', n, '.', k + 1) END, chr(10),
      CASE WHEN k % 89 = 8 THEN '' ELSE concat('title: "Cust ', CASE WHEN k % 67 = 1 THEN k - 1 ELSE k END, '"', chr(10)) END,
      CASE k % 97 WHEN 5 THEN '' WHEN 20 THEN concat('parent: 0', chr(10)) WHEN 6 THEN concat('parent: null', chr(10))
        ELSE concat('parent: ', CASE WHEN k % 41 = 0 THEN '99.99' ELSE concat(r, '.', n) END, chr(10)) END,
      'parent_id: ', CASE WHEN k % 41 = 0 THEN 'Nowhere' ELSE concat('Nat-', n) END, chr(10),
      'breadcrumb: Master > ', r, CASE WHEN k % 11 = 0 THEN '' ELSE concat(' > ', r, '.', n, '.', k + 1) END, chr(10),
      'type: ', CASE WHEN k % 7 = 0 THEN 'raro' ELSE 'hoja' END, chr(10),
      CASE seg WHEN 'BUILDING' THEN concat('status: activo', chr(10)) WHEN 'MACHINERY' THEN concat('status: borrador', chr(10))
        WHEN 'AUTOMOBILE' THEN concat('status: stub', chr(10)) WHEN 'FURNITURE' THEN concat('status: obsoleto', chr(10)) ELSE '' END,
      'document_id: D', k, chr(10), CASE WHEN k % 103 = 9 THEN '' ELSE concat('module: M', r, chr(10)) END, CASE WHEN k % 9 = 4 THEN concat('draft: true', chr(10)) ELSE '' END,
      'last_updated: "2024-01-', lpad(CAST(k % 28 + 1 AS VARCHAR(2)), 2, '0'), '"', chr(10)),
    concat('---', chr(10), chr(10), '# Cust ', k, chr(10), chr(10), 'Belongs to [[Nat-', n, ']].', chr(10), chr(10),
      coalesce(body, ''), chr(10),
      CASE WHEN k % 13 = 0 THEN concat('See [[missing-', k, '|alias]].', chr(10)) ELSE '' END,
      CASE WHEN k % 19 = 0 THEN concat('[[cust-', k, ']] and [[Cust-', k + 1, '#part]]', chr(10)) ELSE '' END,
      CASE WHEN k % 17 = 0 THEN concat('[[Cust-', k, ']]', chr(10)) ELSE '' END,
      CASE k % 21 WHEN 4 THEN concat('[[c/Cust-', k, ']] and [[c/Cust-', k, '#end]]', chr(10)) WHEN 5 THEN concat('[[c/cust-', k, ']] by @', k, chr(10)) ELSE '' END,
      CASE k % 73 WHEN 0 THEN concat('[[Cust-', k - k % 97 + 5, ']]', chr(10)) WHEN 1 THEN concat('[[Cust-', k - k % 97 + 5, '#part]]', chr(10)) ELSE '' END,
      CASE WHEN k % 101 = 11 THEN concat('[[Proyecto P/Datos/Cust-', k, ']] [[D', k, ']] [D', k, ']', chr(10)) ELSE '' END,
      CASE WHEN k % 29 = 0 THEN concat('[[dir/Nat-', n, ']]', chr(10)) ELSE '' END,
      CASE WHEN k % 31 = 0 THEN concat('![[nope-', k, ']]', chr(10), '![](img-', k, '.png) ![alt](https://example.org/', k, '.png)', chr(10)) ELSE '' END,
      CASE WHEN k % 10 = 3 THEN concat('[site](https://example.org/', k, ')', chr(10)) ELSE '' END,
      CASE WHEN k % 10 = 4 THEN concat('[nation](Nat-', n, '.md)', chr(10)) ELSE '' END,
      CASE k % 43 WHEN 0 THEN concat('```mermaid', chr(10), 'foo --> bar', chr(10), '```', chr(10))
        WHEN 1 THEN concat('```mermaid', chr(10), 'graph TD', chr(10), 'A --> B', chr(10), '```', chr(10)) ELSE '' END,
      CASE k % 47 WHEN 0 THEN concat('| a | b |', chr(10), '| 1 | 2 |', chr(10), chr(10))
        WHEN 2 THEN concat('| a | b |', chr(10), '|---|---|', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10), chr(10))
        WHEN 3 THEN concat('| [[Nat-1|x]] | b |', chr(10), '|---|---|', chr(10), chr(10)) ELSE '' END,
      CASE k % 59 WHEN 0 THEN concat('# One', chr(10), '### Three', chr(10)) WHEN 1 THEN concat('# Second', chr(10))
        WHEN 2 THEN concat('## Same', chr(10), chr(10), '## same', chr(10)) ELSE '' END,
      CASE WHEN k % 61 = 0 THEN concat('TODO later', chr(10)) ELSE '' END,
      CASE WHEN k % 71 = 0 THEN concat('trailing  ', chr(10)) ELSE '' END,
      CASE k % 37 WHEN 0 THEN concat('```', chr(10), '# open', chr(10)) WHEN 5 THEN concat('```', chr(10), '## a', chr(10), '---', chr(10), '```', chr(10)) ELSE '' END,
      CASE WHEN k % 71 = 1 THEN 'no end' ELSE concat('end', chr(10)) END),
    CASE WHEN k % 23 = 0 THEN 'wrong' WHEN k % 23 < 12 THEN 'right' ELSE 'none' END
  FROM base
),
hashed AS (
  SELECT path, day, half, head, tail, hash,
    substr({sha}concat(regexp_replace(head, '(?m)^last_updated:.*\n', ''), CASE WHEN tail LIKE '%no end' THEN tail ELSE substr(tail, 1, length(tail) - 1) END){close}, 1, 16) AS h
  FROM parts
),
corpus AS (
  SELECT path, CAST(1704067200 + day * 86400 + half * 43200 AS BIGINT) AS mtime_s,
    concat(head, CASE hash WHEN 'right' THEN concat('content_hash: ', h, chr(10)) WHEN 'wrong' THEN concat('content_hash: deadbeefdeadbeef', chr(10)) ELSE '' END, tail) AS content
  FROM hashed
)
"""


def corpus_sql(sha: str = "sha256(", close: str = ")", **tables: str) -> str:
    """The WITH list of the synthetic corpus for an engine other than Spark."""
    names = {t: tables.get(t, t) for t in TABLES}
    return CORPUS_SQL.format(sha=sha, close=close, **names)


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, mtime) of the synthetic corpus over the star-schema tables of sf_dir."""
    sql = CORPUS_SQL.replace("{sha}", "sha2(").replace("{close}", ", 256)")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(f"WITH {sql} SELECT path, content, timestamp_seconds(mtime_s) AS mtime FROM corpus", **tables)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table of the synthetic corpus."""
    return documents(synthetic(spark, sf_dir))
