"""DuckDB SQL over the synthetic corpus: common table expressions that the oracle queries start from."""

from __future__ import annotations

from docloom.sources.corpus import FIELDS, corpus_sql


def _field(name: str) -> str:
    return f"nullif(regexp_extract(yaml, '(?m)^[ \\t]*{name}:[ \\t]*[\"'']*(.+?)[\"'']*[ \\t]*$', 1), '')"


def first(name: str, number: bool = False) -> str:
    """Value of a field's pattern, first match anywhere in `content`; null without one."""
    value = r"(\d+)" if number else r"[\"'']?([^\"''\n]+)[\"'']?".replace('\\"', '"')
    return f"nullif(trim(regexp_extract(content, '{name}:\\s*{value}', 1)), '')"


_REST = (
    r""",
raw AS (SELECT path, content, mtime_s, regexp_extract(path, '[^/]*$') AS file_name FROM corpus),
docs0 AS (
  SELECT path, content, mtime_s, file_name, regexp_replace(file_name, '\.[^.]*$', '') AS stem, strlen(content) AS size,
    CASE WHEN closed THEN substr(content, 4, strpos(substr(content, 4), '---') - 1) END AS yaml,
    CASE WHEN closed THEN substr(content, strpos(substr(content, 4), '---') + 6) ELSE content END AS body, closed
  FROM (SELECT *, starts_with(content, '---') AND strpos(substr(content, 4), '---') > 0 AS closed FROM raw)
),
docs AS (SELECT *, """
    + ", ".join(f"{_field(n)} AS {c}" for c, n in FIELDS.items())
    + r""" FROM docs0),
lines AS (
  SELECT path, stem, unnest(l) AS text, generate_subscripts(l, 1) AS line_no
  FROM (SELECT path, stem, string_split(regexp_replace(content, '\n\z', ''), chr(10)) AS l FROM docs)
),
fenced AS (
  SELECT *, regexp_matches(text, '^\s*(```|~~~)') AS fence,
    sum(CASE WHEN regexp_matches(text, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS n
  FROM lines
),
prose AS (SELECT * FROM fenced WHERE NOT fence AND n % 2 = 0),
up AS (
  SELECT stem AS node, regexp_extract(content, 'parent_id:\s*["'']?([^"''\s\n]+)["'']?', 1) AS parent FROM docs
  WHERE regexp_matches(content, 'parent_id:\s*["'']?([^"''\s\n]+)["'']?')
)
"""
)
PREFIX = "WITH " + corpus_sql().strip() + _REST


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
