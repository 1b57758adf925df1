"""All registered queries with the SQL that must return the same rows.

Queries on the corpus read the session's corpus tables; their SQL builds the same corpus from the star schema and
computes the answer on its own. Other queries read the star-schema and text tables directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import ids as I
from docloom.functions import links as L
from docloom.functions import text as T
from docloom.operators import diff, export, graph, history, links, lint, registry, reports, rewrite, schema, search, stats, verify
from docloom.plans import tables
from docloom.plans.oracle import PREFIX, first, words
from docloom.sources import corpus
from docloom.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _corpus(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register a query over the corpus, which has a file per row of documents."""
    QUERIES[name] = lambda spark, sf_dir: query(tables.docs(spark, sf_dir))
    if sql:
        start = sql.strip()
        recursive = start.startswith("+R")
        prefix = PREFIX.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else PREFIX
        ORACLE_SQL[name] = prefix.rstrip() + ("," + start[1 + recursive :] if start.startswith("+") else " " + sql)


def _direct(name: str, query: Callable[..., DataFrame], names: tuple[str, ...], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(*[tables.table(spark, sf_dir, t) for t in names])
    if sql:
        ORACLE_SQL[name] = sql


_PHASE_SQL: dict[int, str] = {}
_RULE_SQL: dict[str, str] = {}


def _inner(sql: str) -> str:
    """A query's SQL as a subquery of one that has the corpus's tables."""
    return "WITH " + sql.strip()[1:] if sql.strip().startswith("+") else sql


def _phase(number: int, sql: str) -> None:
    name, phase = verify.PHASES[number]
    _PHASE_SQL[number] = sql
    _corpus(f"v{number:02d}_{name}", lambda d: phase(d).select("severity", "path", "detail"), sql)


def _rule(code: str, sql: str) -> None:
    _RULE_SQL[code] = sql
    _corpus(f"{code.lower()}_{lint.RULES[code].__name__}", lambda d: lint.RULES[code](d).select("path", "line", "detail"), sql)


def _listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# --- integrity phases -----------------------------------------------------------------------------------------------
_names = {"id": "doc_id", "title": "title", "parent": "parent", "breadcrumb": "breadcrumb", "type": "doc_type", "status": "status"}
_missing = "[" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for n, c in _names.items()) + "]"
_phase(1, "SELECT 'error' AS severity, NULL::VARCHAR AS path, 'no files' AS detail WHERE (SELECT count(*) FROM docs) = 0")
_corpus("empty_corpus", lambda d: verify.file_count(d.where("path = ''")).select("severity", "detail"), "SELECT 'error' AS severity, 'no files' AS detail WHERE (SELECT count(*) FROM docs WHERE path = '') = 0")
_phase(2, f"""+ m AS (SELECT path, list_filter({_missing}, lambda x: x IS NOT NULL) AS m FROM docs)
SELECT 'error' AS severity, path, CASE WHEN NOT starts_with(content, '---') THEN 'no frontmatter' WHEN NOT closed THEN 'not closed' ELSE 'missing: ' || array_to_string(m, ', ') END AS detail
FROM m JOIN docs USING (path) WHERE len(m) > 0 OR NOT closed""")
_phase(3, """SELECT 'error' AS severity, min(path) AS path, doc_id || ': ' || string_agg(path, ', ' ORDER BY path) AS detail
FROM docs WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1""")
_phase(4, """SELECT 'error' AS severity, path, parent AS detail FROM docs
WHERE parent <> '0' AND parent NOT IN (SELECT doc_id FROM docs WHERE doc_id IS NOT NULL)""")
_phase(5, "SELECT 'warning' AS severity, path, breadcrumb AS detail FROM docs WHERE NOT contains(breadcrumb, doc_id)")
_phase(6, f"SELECT 'warning' AS severity, path, doc_type AS detail FROM docs WHERE lower(doc_type) NOT IN {_listed(verify.TYPES)}")
_phase(7, f"SELECT 'warning' AS severity, path, status AS detail FROM docs WHERE lower(status) NOT IN {_listed(verify.STATUSES)}")
_phase(8, """+ d AS (SELECT path, abs(mtime_s - epoch(strptime(last_updated, '%Y-%m-%d'))::BIGINT) // 60 AS drift
  FROM docs WHERE last_updated IS NOT NULL AND NOT starts_with(file_name, '0.'))
SELECT 'warning' AS severity, path, drift::VARCHAR AS detail FROM d WHERE drift > 1440""")
_wiki = r"""+ seen AS (
  SELECT path, link, split_part(link, '#', 1) AS name FROM (
    SELECT path, regexp_replace(trim(t), '\\+$', '') AS link
    FROM (SELECT path, unnest(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)) AS t FROM docs)
  ) WHERE link <> '' AND NOT starts_with(link, 'http') AND NOT starts_with(link, '#') AND NOT contains(link, 'Métrica') AND NOT contains(link, 'Valor')
)"""
_phase(9, _wiki + r""", stems AS (SELECT lower(stem) AS low, max(stem) AS correct FROM docs GROUP BY 1)
SELECT CASE WHEN correct IS NULL THEN 'warning' ELSE 'error' END AS severity, path, CASE WHEN correct IS NULL THEN link ELSE link || ' -> ' || correct END AS detail
FROM seen LEFT JOIN stems ON lower(name) = low
WHERE name || '.md' NOT IN (SELECT path FROM docs) AND (correct IS NOT NULL OR NOT (starts_with(link, '@') OR contains(link, '_')))""")
_phase(10, r"""+ e AS (SELECT path, regexp_replace(trim(t), '\\+$', '') AS name FROM (SELECT path, unnest(regexp_extract_all(content, '!\[\[([^\]]+)\]\]', 1)) AS t FROM docs))
SELECT 'warning' AS severity, path, name AS detail FROM e WHERE name <> '' AND name || '.md' NOT IN (SELECT path FROM docs)""")
_phase(11, r"""+ e AS (SELECT path, unnest(regexp_extract_all(content, '!\[([^\]]*)\]\(([^)]+)\)', 2)) AS image FROM docs)
SELECT 'warning' AS severity, path, image AS detail FROM e WHERE NOT starts_with(image, 'http') AND image NOT IN (SELECT path FROM docs)""")
_phase(12, "+ c AS (SELECT path, (length(content) - length(replace(content, '```', ''))) // 3 AS n FROM docs) SELECT 'warning' AS severity, path, n::VARCHAR AS detail FROM c WHERE n % 2 <> 0")
_phase(13, r"""+ b AS (SELECT path, unnest(regexp_extract_all(content, '```mermaid\s*([\s\S]*?)```', 1)) AS block FROM docs)
SELECT 'warning' AS severity, path, 'no diagram type' AS detail FROM b
WHERE trim(block) <> '' AND NOT regexp_matches(block, '""" + "|".join(verify.DIAGRAMS) + "')")
_phase(14, r"""+ m AS (SELECT path, line_no, trim(text) AS t, starts_with(trim(text), '|') AND ends_with(trim(text), '|') AS r, max(line_no) OVER (PARTITION BY path) AS total FROM lines),
g AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line_no) AS run FROM m),
e AS (SELECT path, run, min(line_no) AS f, max(line_no) AS l, max(total) AS total, bool_or(regexp_matches(t, '---|:--|--:|:-:')) AS sep FROM g WHERE r GROUP BY path, run)
SELECT 'warning' AS severity, path, f::VARCHAR AS detail FROM e WHERE NOT sep AND l < total""")
_phase(15, r"""+ h AS (SELECT path, line_no, trim(text) AS t, length(regexp_extract(trim(text), '^#+')) AS level FROM lines WHERE starts_with(trim(text), '#')),
one AS (SELECT path, count(*) AS n FROM h WHERE starts_with(t, '# ') GROUP BY path HAVING count(*) > 1),
j AS (SELECT path, line_no, level, lag(level) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM h),
f AS (SELECT path, arg_min('H' || prev || ' to H' || level, line_no) AS detail FROM j WHERE level > prev + 1 GROUP BY path)
SELECT 'warning' AS severity, path, n || ' H1' AS detail FROM one UNION ALL SELECT 'warning', path, detail FROM f""")
_phase(16, f"+ w AS (SELECT path, {words('body')} AS n FROM docs) SELECT 'warning' AS severity, path, n::VARCHAR AS detail FROM w WHERE n < 50")
_phase(17, "+ p AS (SELECT path, list_filter([" + ", ".join(f"'{x}'" for x in verify.PLACEHOLDERS) + """], lambda x: contains(content, x))[1] AS found FROM docs)
SELECT 'warning' AS severity, path, found AS detail FROM p WHERE found IS NOT NULL""")
_phase(18, """SELECT 'warning' AS severity, min(path) AS path, lower(title) || ': ' || string_agg(path, ', ' ORDER BY path) AS detail
FROM docs WHERE title IS NOT NULL GROUP BY lower(title) HAVING count(*) > 1""")
_phase(19, r"""+ refs AS (SELECT lower(unnest(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1))) AS ref FROM docs)
SELECT 'warning' AS severity, path, stem AS detail FROM docs WHERE NOT starts_with(file_name, '0.') AND (parent IS NULL OR parent = '0') AND lower(stem) NOT IN (SELECT ref FROM refs)""")
_phase(20, r"""+ a AS (SELECT parent, count(*) AS n FROM docs WHERE doc_id IS NOT NULL AND parent <> '0' GROUP BY parent)
SELECT 'warning' AS severity, path, children_count || ' vs ' || coalesce(n, 0) AS detail FROM docs LEFT JOIN a ON a.parent = docs.doc_id
WHERE regexp_full_match(children_count, '\d+') AND children_count::BIGINT <> coalesce(n, 0)""")
_hash = r"""substr(sha256(array_to_string(list_filter(string_split(regexp_replace(content, '\n\z', ''), chr(10)),
  lambda x: NOT (starts_with(x, 'last_updated:') OR starts_with(x, 'content_hash:') OR starts_with(x, 'file_create:'))), chr(10))), 1, 16)"""
_phase(21, f"SELECT 'warning' AS severity, path, content_hash AS detail FROM docs WHERE content_hash IS NOT NULL AND trim(content_hash) <> {_hash}")

_issues = "+ issues AS (" + " UNION ALL ".join(f"SELECT {n} AS phase, severity FROM ({_inner(x)})" for n, x in _PHASE_SQL.items()) + ")"
_quick = _issues.replace("+ issues AS (", "+ all_issues AS (") + f", issues AS (SELECT * FROM all_issues WHERE phase NOT IN {verify.SLOW})"
_names = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, (n, _) in verify.PHASES.items()) + ") n(phase, name)"
_summary = f""" SELECT n.phase, name, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS passed
FROM {_names} LEFT JOIN issues USING (phase) %s GROUP BY ALL"""
_corpus("verify_summary", verify.summary, _issues + _summary % "")
_corpus("verify_quick", lambda d: verify.summary(d, quick=True), _quick + _summary % f"WHERE phase NOT IN {verify.SLOW}")

# --- lint -------------------------------------------------------------------------------------------------------------
_rule("L001", "SELECT path, 1::BIGINT AS line, '' AS detail FROM docs WHERE NOT starts_with(content, '---')")
_rule("L002", r"""+ h AS (SELECT path, line_no, length(regexp_extract(text, '^#+')) AS level FROM prose WHERE starts_with(text, '#')),
j AS (SELECT *, lag(level) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM h)
SELECT path, line_no AS line, 'H' || prev || ' to H' || level AS detail FROM j WHERE level > prev + 1""")
_rule("L003", r"SELECT path, line_no AS line, '' AS detail FROM lines WHERE regexp_matches(text, '[ \t]$')")
_rule("L004", "SELECT path, NULL::BIGINT AS line, '' AS detail FROM docs WHERE NOT ends_with(content, chr(10))")
_rule("L005", "SELECT path, line_no AS line, strlen(text)::VARCHAR AS detail FROM lines WHERE strlen(text) > 800")
_rule("L006", r"""+ t AS (SELECT path, line_no, trim(text) AS x FROM lines),
k AS (SELECT *, starts_with(x, '```') AS f, sum(CASE WHEN starts_with(x, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS n FROM t),
o AS (SELECT path, line_no FROM k WHERE f AND n % 2 = 1 AND regexp_full_match(x, '`+')),
c AS (SELECT o.path, o.line_no, coalesce(min(k.line_no), o.line_no + 50) AS stop FROM o LEFT JOIN k ON k.path = o.path AND k.line_no > o.line_no AND k.line_no < o.line_no + 50 AND k.x = '```' GROUP BY 1, 2),
s AS (SELECT c.path, c.line_no, coalesce(max(starts_with(x, '##')::INT), 0) + coalesce(max((starts_with(x, '|') AND ends_with(x, '|'))::INT), 0)
  + coalesce(max((starts_with(x, '```') AND strlen(x) > 3)::INT), 0) + coalesce(max((x = '---')::INT), 0) AS score
  FROM c LEFT JOIN k ON k.path = c.path AND k.line_no > c.line_no AND k.line_no < c.stop GROUP BY 1, 2)
SELECT path, line_no AS line, '' AS detail FROM s WHERE score < 2""")
_rule("L007", r"""+ h AS (SELECT path, line_no, lower(trim(regexp_replace(text, '^#+', ''))) AS head FROM prose WHERE regexp_matches(text, '^#+ ')),
m AS (SELECT *, min(line_no) OVER (PARTITION BY path, head) AS f FROM h WHERE head <> '' AND NOT starts_with(head, '!'))
SELECT path, line_no AS line, f::VARCHAR AS detail FROM m WHERE line_no > f""")
_rule("L008", "SELECT path, NULL::BIGINT AS line, x AS detail FROM docs, (VALUES ('id'), ('title')) v(x) WHERE starts_with(content, '---') AND NOT contains(content, x || ':')")
_tables = r"""+ m AS (SELECT path, line_no, n, fence, regexp_matches(trim(text), '^\|.+\|$') AND NOT fence AS r, regexp_matches(trim(text), '^\|[-:\s|]+\|$') AS sep FROM fenced),
g AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER w AS run, coalesce(lead(sep) OVER w, false) AS nsep FROM m WINDOW w AS (PARTITION BY path ORDER BY line_no)),
t AS (SELECT *, min(line_no) OVER (PARTITION BY path, run) AS f FROM g WHERE r AND n % 2 = 0)"""
_rule("L009", _tables + " SELECT path, line_no AS line, '' AS detail FROM t WHERE line_no = f AND NOT nsep")
_rule("L010", r"SELECT path, line_no AS line, '' AS detail FROM lines WHERE regexp_matches(text, '!\[\]\([^)]+\)')")
_rule("L011", _tables + """, s AS (SELECT path, run, line_no, sep, max(CASE WHEN sep THEN 0 ELSE 1 END) OVER (PARTITION BY path, run ORDER BY line_no) AS started FROM t),
u AS (SELECT *, row_number() OVER (PARTITION BY path, run ORDER BY line_no) AS i, min(line_no) OVER (PARTITION BY path, run) AS f FROM s WHERE sep AND started = 1)
SELECT path, line_no AS line, f::VARCHAR AS detail FROM u WHERE i > 1""")
_rule("L012", r"""+ l AS (SELECT path, line_no, unnest(regexp_extract_all(text, '\[\[[^\]\|\\]+\|[^\]]+\]\]')) AS link FROM lines WHERE starts_with(trim(text), '|'))
SELECT path, line_no AS line, link AS detail FROM l WHERE NOT contains(link, '\|')""")
_rule("L013", r"""+ r AS (SELECT path, line_no, string_split(text, '|') AS c FROM lines WHERE starts_with(path, 'Nat-') AND regexp_matches(text, '^\| \[\[[0-9]')),
x AS (SELECT path, line_no, regexp_extract(c[2], '\[\[([^\] ]+)', 1) AS id, trim(c[3])::BIGINT AS claimed FROM r),
d AS (SELECT id, (SELECT count(*) FROM docs f WHERE NOT contains(f.path, '/') AND regexp_matches(f.file_name, '^' || replace(x.id, '.', '\.') || '\.[0-9]')) AS n FROM (SELECT DISTINCT id FROM x) x)
SELECT path, line_no AS line, x.id || ': ' || claimed || ' vs ' || n AS detail FROM x JOIN d USING (id) WHERE n <> claimed""")
_rule("L014", r"""+ f AS (SELECT path, line_no, unnest(regexp_extract_all(text, '\[\[Proyecto[^\]]*/Datos/([^\]]+)\]\]')) AS link FROM lines) SELECT path, line_no AS line, substr(link, 1, 50) AS detail FROM f""")
#: Severity, and whether it can be fixed, of each rule (fixed values).
_RULES = {
    "L001": ("warning", 0), "L002": ("warning", 0), "L003": ("info", 1), "L004": ("info", 1), "L005": ("warning", 0), "L006": ("hint", 0), "L007": ("warning", 0),
    "L008": ("error", 0), "L009": ("warning", 0), "L010": ("warning", 0), "L011": ("error", 1), "L012": ("error", 1), "L013": ("warning", 1), "L014": ("info", 0),
}
_found = "+ found AS (" + " UNION ALL ".join(f"SELECT '{_RULES[c][0]}' AS severity, {_RULES[c][1]} AS fixable, path FROM ({_inner(x)})" for c, x in _RULE_SQL.items()) + ")"
_corpus("lint_summary", lint.summary, _found + """ SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
  count(*) FILTER (severity = 'hint') AS hints, count(*) FILTER (fixable = 1) AS fixable, count(DISTINCT path) AS files FROM found""")
_corpus("lint_fix", lambda d: rewrite.lint_fix(d).select("path", F.sha2("content", 256).alias("sha")), r"""+ f AS (
  SELECT path, content, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(content, '\n\z', ''), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '\n+\z', '') || chr(10) AS new FROM docs)
SELECT path, sha256(new) AS sha FROM f WHERE new <> content""")

# --- links ------------------------------------------------------------------------------------------------------------
_links = r"""+ wl AS (SELECT path, stem, line_no AS line, 'wiki' AS kind, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) AS target FROM prose),
ml AS (SELECT path, stem, line_no AS line, 'markdown' AS kind, unnest(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+)\)', 2)) AS target FROM prose),
ll AS (SELECT * FROM wl UNION ALL SELECT * FROM ml WHERE NOT regexp_matches(target, '^https?://')),
nn AS (SELECT *, trim(split_part(split_part(split_part(replace(target, '\|', '|'), '|', 1), '/', -1), '#', 1)) AS name FROM ll),
st AS (SELECT path, line, kind, target, name, CASE
  WHEN kind = 'wiki' AND contains(split_part(target, '|', 1), '/') THEN 'nonstandard' WHEN target = stem OR ends_with(target, '/' || stem) THEN 'circular'
  WHEN EXISTS (SELECT 1 FROM docs f WHERE ends_with(lower(f.stem), lower(nn.name)) OR contains(lower(f.path), lower(nn.name)) OR (regexp_matches(nn.name, '^[0-9]') AND starts_with(lower(f.stem), lower(nn.name)))) THEN 'valid'
  ELSE 'broken' END AS status FROM nn)"""
_corpus("links_classify", links.classify, _links + " SELECT * FROM st")
_corpus("links_totals", links.totals, _links + """ SELECT count(*) AS links, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'broken') AS broken,
  count(*) FILTER (status = 'circular') AS circular, count(*) FILTER (status = 'nonstandard') AS nonstandard, count(*) FILTER (status = 'external') AS external, round(count(*) FILTER (status IN ('valid', 'external')) / count(*) * 100, 6) AS health FROM st""")
_corpus("links_find_refs", lambda d: links.references(d, "Nat-3"), "SELECT path, line_no AS line, substr(text, 1, 50) AS fragment FROM lines WHERE contains(text, '[[Nat-3]]') OR contains(text, '[[Nat-3|')")
_extract = r"""+ xw AS (SELECT path, unnest(regexp_extract_all(content, '!?\[\[[^\]|]+(?:\|[^\]]+)?\]\]')) AS raw FROM docs),
xm AS (SELECT path, unnest(regexp_extract_all(content, '!?\[[^\]]*\]\([^)]+\)')) AS raw FROM docs),
xl AS (
  SELECT path, 'wiki' AS link_type, regexp_extract(raw, '\[\[([^\]|]+)', 1) AS target FROM xw WHERE NOT starts_with(raw, '!')
  UNION ALL SELECT path, CASE WHEN regexp_matches(raw, '\]\(https?://') THEN 'external' ELSE 'markdown' END, regexp_extract(raw, '\]\(([^)]+)\)', 1) FROM xm WHERE NOT starts_with(raw, '!') AND NOT starts_with(raw, '[]')
  UNION ALL SELECT path, 'embed', NULL FROM (SELECT path, unnest(regexp_extract_all(content, '!\[\[([^\]]+)\]\]')) FROM docs)
  UNION ALL SELECT path, 'md_embed', NULL FROM (SELECT path, unnest(regexp_extract_all(content, '!\[([^\]]*)\]\(([^)]+)\)')) FROM docs))"""
_corpus("links_unresolved", links.unresolved, _extract + """, t AS (SELECT path, split_part(target, '#', 1) AS t FROM xl WHERE link_type IN ('wiki', 'markdown')),
n AS (SELECT path, CASE WHEN contains(t, '.') THEN t ELSE t || '.md' END AS target FROM t WHERE t <> '')
SELECT path, target FROM n WHERE target NOT IN (SELECT path FROM docs) AND split_part(target, '/', -1) NOT IN (SELECT file_name FROM docs)""")
_corpus("links_unique_targets", lambda d: links.unique_targets(d).select("path", F.array_join("targets", ";").alias("targets")), _extract + """, t AS (
  SELECT path, list_sort(list_distinct(list(trim(target)))) AS l FROM xl WHERE link_type IN ('wiki', 'markdown') GROUP BY 1) SELECT path, coalesce(array_to_string(l, ';'), '') AS targets FROM docs LEFT JOIN t USING (path)""")
_corpus("links_extract", lambda d: d.select("path", F.explode(L.extract(F.col("content"))).alias("l")).groupBy("l.link_type").agg(F.count(F.lit(1)).alias("n")), _extract + " SELECT link_type, count(*) AS n FROM xl GROUP BY 1")
_corpus("links_to_markdown", lambda d: d.select("path", F.sha2(L.to_markdown(F.col("content")), 256).alias("sha")), r"""
SELECT path, sha256(regexp_replace(regexp_replace(content, '(^|[^!])\[\[([^\]|]+)\|([^\]]+)\]\]', '\1[\3](\2.md)', 'g'), '(^|[^!])\[\[([^\]|]+)\]\]', '\1[\2](\2.md)', 'g')) AS sha FROM docs""")

# --- graph ------------------------------------------------------------------------------------------------------------
_edges = r"""+ up2 AS (SELECT node, parent FROM up WHERE parent NOT IN ('null', '')),
ed AS (SELECT parent AS src, node AS dst, 'hierarchy' AS kind FROM up2
  UNION ALL SELECT * FROM (SELECT stem AS src, unnest(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)) AS dst, 'link' AS kind FROM docs) WHERE src <> dst
  UNION ALL SELECT * FROM (SELECT stem AS src, regexp_replace(split_part(unnest(regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+\.md)\)', 2)), '/', -1), '\.md$', '') AS dst, 'link' AS kind FROM docs) WHERE src <> dst)"""
_corpus("deps_edges", lambda d: graph.edges(d).groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n")), _edges + " SELECT src, dst, kind, count(*) AS n FROM ed GROUP BY ALL")
_corpus("deps_roles", graph.roles, _edges + """ SELECT d.node, parent IS NULL AS is_root, d.node NOT IN (SELECT parent FROM up2) AS is_leaf,
  CASE WHEN parent IS NULL THEN 'no_parent' WHEN parent NOT IN (SELECT stem FROM docs) THEN 'missing_parent' END AS orphan_reason,
  CASE WHEN parent NOT IN (SELECT stem FROM docs) THEN parent END AS invalid_parent
FROM (SELECT DISTINCT stem AS node FROM docs) d LEFT JOIN up2 ON up2.node = d.node""")
_corpus("deps_impact", lambda d: graph.impact(d, "Nat-2"), _edges + """ SELECT node, 'child' AS relation FROM up2 WHERE parent = 'Nat-2'
UNION ALL SELECT DISTINCT src, 'reference' FROM ed WHERE kind = 'link' AND contains(dst, 'Nat-2')""")
_corpus("deps_mermaid", lambda d: graph.mermaid(graph.edges(d).where("kind = 'hierarchy'")), _edges + r""", m AS (
  SELECT DISTINCT '    ' || regexp_replace(src, '[^A-Za-z0-9]', '_', 'g') || ' --> ' || regexp_replace(dst, '[^A-Za-z0-9]', '_', 'g') AS line FROM ed WHERE kind = 'hierarchy')
SELECT 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS mermaid FROM m""")
_corpus("trace", lambda d: graph.trace(d, "Reg-1", 3, True), _edges + r""", below AS (
  SELECT u.parent AS source, u.node AS target, 1 AS depth FROM up2 u WHERE parent = 'Reg-1'
  UNION ALL SELECT u.parent, u.node, 2 FROM up2 u JOIN up2 v ON u.parent = v.node WHERE v.parent = 'Reg-1'),
wk AS (SELECT stem AS src, trim(split_part(split_part(unnest(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)), '/', -1), '|', 1)) AS dst FROM docs),
lk AS (SELECT src AS source, dst AS target, 'link' AS ref_type FROM wk WHERE src = 'Reg-1' AND dst <> src UNION ALL SELECT src, dst, 'backlink' FROM wk WHERE dst = 'Reg-1' AND src <> dst)
SELECT source, target, 'child' AS ref_type, depth FROM below UNION ALL SELECT node, parent, 'parent', 1 FROM up2 WHERE node = 'Reg-1'
UNION ALL SELECT source, target, ref_type, 1 FROM (SELECT * FROM lk ORDER BY ref_type DESC, source, target LIMIT 100)""")
_tree = r"""+R tw AS (SELECT stem AS node, max({w}) AS words FROM docs GROUP BY 1), tp AS (SELECT node, max(parent) AS parent FROM up WHERE parent NOT IN ('null', '') GROUP BY 1),
tn AS (SELECT node, words, parent, parent IS NOT NULL AND parent IN (SELECT node FROM tw) AS known, (SELECT count(*) FROM tp c WHERE c.parent = tw.node) AS children FROM tw LEFT JOIN tp USING (node)),
tl AS (SELECT *, node = max(node) OVER (PARTITION BY CASE WHEN known THEN parent END) AS is_last FROM tn),
tt AS (
  SELECT node, 0 AS depth, parent, children, is_last, ''::VARCHAR AS bars, node::VARCHAR AS place, words, parent IS NOT NULL AS is_orphan FROM tl WHERE NOT known
  UNION ALL SELECT c.node, t.depth + 1, c.parent, c.children, c.is_last, t.bars || CASE WHEN t.is_last THEN '    ' ELSE '│   ' END, t.place || '/' || c.node, c.words, false FROM tl c JOIN tt t ON c.known AND c.parent = t.node)""".replace("{w}", words("content"))
_corpus("tree", lambda d: graph.tree(d).select("node", "depth", "doc_kind", "children", "is_last", "is_orphan", "words", F.array_join("sort_path", "/").alias("place")), _tree + """
SELECT node, depth, CASE WHEN depth = 0 AND starts_with(node, '0.') THEN 'master' WHEN children > 0 AND depth <= 1 THEN 'module_root' WHEN children > 0 THEN 'branch' ELSE 'leaf' END AS doc_kind,
  children, is_last, is_orphan, words, place FROM tt""")
_corpus("tree_text", lambda d: graph.tree_text(graph.tree(d)).select(F.array_join("sort_path", "/").alias("place"), "line"), _tree + """
SELECT place, CASE WHEN depth = 0 THEN '' ELSE substr(bars, 1, 4 * (depth - 1)) || CASE WHEN is_last THEN '└── ' ELSE '├── ' END END || node AS line FROM tt""")
_corpus("tree_root", lambda d: graph.tree_text(graph.tree(d, root="Nat-1")).select(F.array_join("sort_path", "/").alias("place"), "line"), """+ k AS (SELECT DISTINCT stem FROM docs WHERE starts_with(stem, 'Nat-1'))
SELECT stem AS place, stem AS line FROM k""")
_corpus("tree_totals", lambda d: graph.tree_totals(graph.tree(d)), _tree + " SELECT count(*) AS nodes, max(depth) AS max_depth, count(*) FILTER (is_orphan) AS orphans, sum(words)::BIGINT AS words FROM tt")
_corpus("tree_levels", lambda d: graph.level_order(graph.tree(d)), _tree + " SELECT node, depth, (row_number() OVER (PARTITION BY depth ORDER BY string_split(place, '/')))::INT AS place FROM tt")
_corpus("tree_postorder", lambda d: graph.post_order(graph.subtree(graph.tree(d), "Reg-1")).select("node", F.transform("key", lambda k: F.when(k["end"], F.lit("]")).otherwise(k["name"])).alias("k")).select("node", F.array_join("k", "/").alias("key")),
        _tree + " SELECT node, place || '/]' AS key FROM tt WHERE list_contains(string_split(place, '/'), 'Reg-1')")
_corpus("tree_leaves", lambda d: graph.leaves(graph.tree(d)).select("node"), _tree + " SELECT node FROM tt WHERE children = 0")
_corpus("trace_totals", lambda d: graph.trace_totals(graph.trace(d, "Reg-1", 3, True)), _edges + r""", below AS (
  SELECT u.parent AS source, u.node AS target, 1 AS depth FROM up2 u WHERE parent = 'Reg-1' UNION ALL SELECT u.parent, u.node, 2 FROM up2 u JOIN up2 v ON u.parent = v.node WHERE v.parent = 'Reg-1'),
wk AS (SELECT stem AS src, trim(split_part(split_part(unnest(regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1)), '/', -1), '|', 1)) AS dst FROM docs),
lk AS (SELECT src AS source, dst AS target, 'link' AS ref_type FROM wk WHERE src = 'Reg-1' AND dst <> src UNION ALL SELECT src, dst, 'backlink' FROM wk WHERE dst = 'Reg-1' AND src <> dst),
a AS (SELECT source, target, depth FROM below UNION ALL SELECT node, parent, 1 FROM up2 WHERE node = 'Reg-1' UNION ALL SELECT source, target, 1 FROM (SELECT * FROM lk ORDER BY ref_type DESC, source, target LIMIT 100)),
n AS (SELECT count(DISTINCT x) AS n FROM (SELECT source AS x FROM a UNION ALL SELECT target FROM a))
SELECT count(*) AS "references", max(depth) AS max_depth, (SELECT n FROM n) AS documents, (SELECT n FROM n) - 1 AS impact FROM a""")
_corpus("deps_totals", lambda d: graph.graph_totals(graph.edges(d), d.select(F.col("stem").alias("node"))), _edges + """, n AS (SELECT stem AS x FROM docs UNION SELECT src FROM ed UNION SELECT dst FROM ed)
SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, count(*) FILTER (kind = 'hierarchy') AS hierarchy, count(*) FILTER (kind = 'link') AS links FROM ed""")
_corpus("id_tree", graph.id_tree, r"""+ o AS (SELECT DISTINCT doc_id FROM docs WHERE regexp_full_match(doc_id, '\d+(\.\d+)*')),
p AS (SELECT doc_id, CASE WHEN contains(doc_id, '.') THEN regexp_replace(doc_id, '\.[^.]*$', '') END AS parent_id, len(string_split(doc_id, '.'))::BIGINT AS depth, split_part(doc_id, '.', 1)::INT AS module FROM o)
SELECT doc_id, parent_id, depth, module, doc_id NOT IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL) AS is_leaf FROM p""")


def _supply(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Edges between parts from all rows of lineitem."""
    n = part.agg(F.count(F.lit(1)).alias("n"))
    return lineitem.select("l_partkey", "l_suppkey").distinct().crossJoin(F.broadcast(n)).select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("n")).alias("dst"))


_supplied = """e AS (SELECT DISTINCT l_partkey AS src, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS dst FROM lineitem), f AS (SELECT src, dst FROM e WHERE src <> dst)"""
_direct("cycles", lambda x, p: graph.cycles(_supply(x, p), 3).select(F.array_join("path", ",").alias("path")), ("lineitem", "part"), f"""
WITH {_supplied}
SELECT a.src || ',' || a.dst AS path FROM f a JOIN f b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || ',' || a.dst || ',' || b.dst FROM f a JOIN f b ON a.dst = b.src JOIN f c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
_direct("cyclic", lambda x, p: graph.cyclic(_supply(x, p)), ("lineitem", "part"), f"""
WITH RECURSIVE {_supplied}, r AS (SELECT src, dst FROM f UNION SELECT r.src, f.dst FROM r JOIN f ON r.dst = f.src)
SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src GROUP BY 1""")

# --- statistics -------------------------------------------------------------------------------------------------------
_corpus("stats_by_module", stats.by_module, f"SELECT split_part(doc_id, '.', 1) AS module_id, count(*) AS documents, sum({words('body')})::BIGINT AS words FROM docs WHERE doc_id IS NOT NULL GROUP BY 1")
_corpus("stats_by_status", stats.by_status, "SELECT coalesce(status, 'sin_status') AS status, count(*) AS n FROM docs GROUP BY 1")
_corpus("stats_by_type", stats.by_type, "SELECT coalesce(doc_type, 'sin_tipo') AS doc_type, count(*) AS n FROM docs GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
_corpus("stats_sizes", lambda d: stats.sizes(d).drop("label"), "SELECT sum(size)::BIGINT AS bytes, round(avg(size), 6) AS average FROM docs")
_corpus("stats_project", stats.project, rf"""+ w AS (SELECT unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)) AS t FROM prose),
x AS (SELECT lower(trim(split_part(split_part(t, '#', 1), '/', -1))) AS name FROM w)
SELECT count(*) AS documents, count(*) FILTER (closed) AS healthy, sum({words('body')})::BIGINT AS words, count(DISTINCT split_part(doc_id, '.', 1)) AS modules, max(len(string_split(doc_id, '.')))::BIGINT AS max_depth,
  (SELECT count(*) FROM x) AS links, (SELECT count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM docs f WHERE contains(lower(f.stem), x.name))) AS broken FROM docs""")
_corpus("stats_quick", stats.quick, f"SELECT count(*) AS files, sum({words('content')})::BIGINT AS words, sum(size)::BIGINT AS bytes, count(*) FILTER (starts_with(content, '---')) AS with_frontmatter FROM docs")
_corpus("modules", stats.modules, rf"""+ m AS (SELECT coalesce({first('module')}, 'sin_modulo') AS module, {words('content')} AS w FROM docs), g AS (SELECT module, count(*) AS documents, sum(w)::BIGINT AS words FROM m GROUP BY 1)
SELECT module, documents, words, words // documents AS average, (CASE WHEN words // documents <= 50 THEN 40 WHEN words // documents <= 200 THEN 70 WHEN words // documents <= 500 THEN 90 ELSE 100 END)::BIGINT AS health FROM g""")
_corpus("module_children", lambda d: stats.module_children(d, "sin_modulo"), f"SELECT path FROM docs WHERE {first('module')} IS NULL")
_corpus("module_registry", stats.module_registry, rf"""+ m AS (SELECT doc_id, title, {words('body')} AS w, len(string_split(doc_id, '.')) AS depth FROM docs WHERE regexp_full_match(doc_id, '\d+(\.\d+)*'))
SELECT split_part(doc_id, '.', 1)::INT AS module, count(*) AS documents, sum(w)::BIGINT AS words, count(*) FILTER (title IS NOT NULL AND w >= 50) AS healthy,
  round(count(*) FILTER (title IS NOT NULL AND w >= 50) / count(*) * 100, 6) AS coverage, max(depth)::BIGINT AS max_depth, min(CASE WHEN depth = 1 THEN doc_id END) AS root_doc FROM m GROUP BY 1""")
_corpus("health", stats.health, rf"""+ q AS (SELECT count(*) AS n, count(*) FILTER (starts_with(content, '---')) AS f, sum({words('content')}) AS w FROM docs),
b AS (SELECT floor(f / n * 100) AS cover, CASE WHEN w // n >= 500 THEN 100 WHEN w // n >= 300 THEN 85 WHEN w // n >= 100 THEN 60 ELSE 30 END AS s FROM q),
m(metric, value, weight) AS (SELECT 'coverage', cover::DOUBLE, 1.0::DOUBLE FROM b UNION ALL SELECT 'links', 95, 0.8 UNION ALL SELECT 'structure', s, 1.2 FROM b UNION ALL SELECT 'metadata', cover, 0.5 FROM b),
o AS (SELECT * FROM m UNION ALL SELECT 'overall', round((SELECT sum(value * weight) / sum(weight) FROM m)), NULL)
SELECT metric, value, weight, CASE WHEN value >= 90 THEN 'excellent' WHEN value >= 70 THEN 'good' WHEN value >= 50 THEN 'warning' ELSE 'critical' END AS status,
  CASE WHEN metric <> 'overall' THEN NULL WHEN value >= 90 THEN 'A' WHEN value >= 80 THEN 'B' WHEN value >= 70 THEN 'C' WHEN value >= 60 THEN 'D' ELSE 'F' END AS grade FROM o""")
_ten = "(SELECT coalesce(string_agg(path, ',' ORDER BY path), '') FROM (SELECT DISTINCT path FROM %s ORDER BY path LIMIT 10))"
_audit = _links + ", " + _found[1:] + ", low AS (SELECT path FROM docs WHERE " + words("content") + """ < 100),
f AS (SELECT 1 AS seq, 'links' AS category, 4 AS severity, 'broken links' AS title, (SELECT count(*) FROM st WHERE status = 'broken') AS n, """ + _ten % "st WHERE status = 'broken'" + """ AS affected
  UNION ALL SELECT 2, 'links', 3, 'links with a path', (SELECT count(*) FROM st WHERE status = 'nonstandard'), """ + _ten % "st WHERE status = 'nonstandard'" + """
  UNION ALL SELECT 3, 'content', 4, 'lint errors', (SELECT count(*) FROM found WHERE severity = 'error'), """ + _ten % "found WHERE severity = 'error'" + """
  UNION ALL SELECT 4, 'content', 2, 'lint warnings', (SELECT count(*) FROM found WHERE severity = 'warning'), ''
  UNION ALL SELECT 5, 'content', 3, 'little content', (SELECT CASE WHEN count(*) > 10 THEN count(*) ELSE 0 END FROM low), """ + _ten % "low" + "), a AS (SELECT * FROM f WHERE n > 0)"
_corpus("audit", lambda d: stats.audit(d).select("rank", "category", "severity", "title", "n", F.array_join("affected", ",").alias("affected")), _audit + """
SELECT (row_number() OVER (ORDER BY severity DESC, seq))::INT AS rank, category, severity, title, n, affected FROM a""")
_corpus("audit_score", lambda d: stats.audit_score(stats.audit(d)), _audit + """
SELECT greatest(0, 100 - 2 * sum(severity))::BIGINT AS score, sum(CASE WHEN severity >= 5 THEN 60 WHEN severity = 4 THEN 30 WHEN severity = 3 THEN 15 WHEN severity = 2 THEN 5 ELSE 2 END)::BIGINT AS minutes FROM a""")
_corpus("report", stats.report, rf"""+ r AS (SELECT {words('body')} AS w, len(regexp_extract_all(content, '\[\[([^\]]+)\]\]')) AS l FROM docs)
SELECT count(*) AS documents, sum(w)::BIGINT AS words, (sum(w) // count(*))::BIGINT AS average, sum(l)::BIGINT AS wiki_links FROM r""")
_corpus("report_modules", stats.report_modules, "SELECT split_part(doc_id, '.', 1) AS module_id, count(*) AS n FROM docs WHERE doc_id IS NOT NULL GROUP BY 1")
_corpus("dashboard", lambda d: stats.dashboard(d, "errors").groupBy("id").agg(F.count(F.lit(1)).alias("n")), _issues + " SELECT 'E' || lpad(phase::VARCHAR, 2, '0') AS id, count(*) AS n FROM issues WHERE severity = 'error' GROUP BY 1")
_corpus("dashboard_all", lambda d: stats.dashboard(d).groupBy("id", "severity").agg(F.count(F.lit(1)).alias("n")), _issues + " SELECT upper(severity[1]) || lpad(phase::VARCHAR, 2, '0') AS id, severity, count(*) AS n FROM issues GROUP BY ALL")
_corpus("dashboard_score", stats.dashboard_score, _issues + " SELECT round((21 - (SELECT count(DISTINCT phase) FROM issues WHERE severity = 'error')) / 21 * 100, 6) AS health")
_corpus("gate", registry.gate, _links + ", " + _found[1:] + ", " + _issues[1:] + """, g AS (SELECT (SELECT count(*) FROM issues WHERE severity = 'error') AS verify_errors,
  (SELECT count(*) FROM found WHERE severity = 'error') AS lint_errors, (SELECT count(*) FROM st WHERE status = 'broken') AS broken_links)
SELECT *, verify_errors + lint_errors + broken_links = 0 AS passed FROM g""")
_buckets = "(VALUES " + ", ".join(f"('{n}', {a}, {b if b is not None else 'NULL'})" for n, a, b in stats.BUCKETS) + ") b(name, least, most)"
_direct("coverage", lambda d: stats.coverage(d.withColumnRenamed("text", "content")), ("documents",), f"""
WITH w AS (SELECT {words('text')} AS n FROM documents)
SELECT name, least::BIGINT AS least, most::BIGINT AS most, (SELECT count(*) FROM w WHERE n >= least AND (most IS NULL OR n <= most)) AS n FROM {_buckets}""")
_direct("coverage_summary", lambda d: stats.coverage_summary(d.withColumnRenamed("text", "content")), ("documents",), f"""
WITH w AS (SELECT {words('text')} AS n FROM documents)
SELECT count(*) AS files, sum(n)::BIGINT AS words, (sum(n) // count(*))::BIGINT AS average, round(count(*) FILTER (n >= 201) / count(*) * 100, 6) AS percent FROM w""")
_direct("coverage_classes", lambda d: stats.coverage_classes(d.withColumnRenamed("text", "content")), ("documents",), f"""
WITH w AS (SELECT least({words('text')} // 50, 7) AS c FROM documents)
SELECT count(*) AS total, {", ".join(f"count(*) FILTER (c = {i}) AS c{i}" for i in range(8))}, round(count(*) FILTER (c = 7) / count(*) * 100, 6) AS acceptable,
  round(count(*) FILTER (c = 0) / count(*) * 100, 6) AS critical, round(sum([0.0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 1.0][c + 1]::DOUBLE) / count(*) * 100)::BIGINT AS score FROM w""")
_direct("activity", lambda o: stats.activity(o, "o_orderdate").drop("level"), ("orders",), """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, n, (n * 30 // (SELECT max(n) FROM m))::BIGINT AS bar FROM m""")
_direct("recent", lambda o: stats.recent(o, "o_orderdate", F.lit("2030-01-01").cast("timestamp"), 20, "o_orderkey").select("o_orderkey", "age"), ("orders",), """
SELECT o_orderkey, (date_diff('second', o_orderdate, TIMESTAMP '2030-01-01') // 86400) || 'd' AS age FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")

# --- search, diff, functions ------------------------------------------------------------------------------------------


def _text_lines(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("line_no"), "text")


_dl = "l AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) AS line_no FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS x FROM documents))"
_direct("search", lambda d: search.search(_text_lines(d), "tion", key="doc_id").select("doc_id", "line_no", "start", "length"), ("documents",), f"""
WITH {_dl} SELECT doc_id, line_no::INT AS line_no, strlen(substr(text, 1, strpos(text, 'tion') - 1))::BIGINT AS start, 4::BIGINT AS length FROM l WHERE contains(text, 'tion')""")
_direct("search_ignore_case", lambda d: search.search(_text_lines(d), "THE", True, key="doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), ("documents",), f"""
WITH {_dl} SELECT doc_id, count(*) AS n FROM l WHERE contains(lower(text), 'the') GROUP BY 1""")
_direct("search_totals", lambda d: search.totals(_text_lines(d), search.search(_text_lines(d), "tion", key="doc_id"), "doc_id"), ("documents",), f"""
WITH {_dl} SELECT count(*) FILTER (contains(text, 'tion')) AS matches, count(DISTINCT CASE WHEN contains(text, 'tion') THEN doc_id END) AS files_with_matches, count(DISTINCT doc_id) AS files, count(*) AS lines FROM l""")
_direct("search_top", lambda d: search.search(_text_lines(d), "tion", most=50, key="doc_id").select("doc_id", "line_no"), ("documents",), f"""
WITH {_dl} SELECT doc_id, line_no::INT AS line_no FROM l WHERE contains(text, 'tion') ORDER BY doc_id, line_no LIMIT 50""")
_direct("search_fuzzy", lambda c: search.fuzzy(c, "c_mktsegment", "MACHINARY", 2).select("c_custkey", "distance"), ("customer",), """
SELECT c_custkey, levenshtein(c_mktsegment, 'MACHINARY')::INT AS distance FROM customer WHERE levenshtein(c_mktsegment, 'MACHINARY') <= 2""")
_direct("search_context", lambda d: search.context(_text_lines(d), "tion,", 1, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), ("documents",), f"""
WITH {_dl} SELECT doc_id, count(*) AS n FROM l WHERE EXISTS (SELECT 1 FROM l m WHERE m.doc_id = l.doc_id AND abs(m.line_no - l.line_no) <= 1 AND contains(m.text, 'tion,')) GROUP BY 1""")
_direct("duplicate_texts", lambda d: d.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1"), ("documents",),
        "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS least FROM documents GROUP BY 1 HAVING count(*) > 1")
_direct("quality_rows", lambda d, l: d.join(l, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), ("documents", "labels"),
        "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
_direct("external_pages", lambda p: p.select("page_id", L.is_external(F.col("url")).alias("external")), ("pages",), "SELECT page_id, regexp_matches(url, '^https?://') AS external FROM pages")


def _diff(d: DataFrame) -> DataFrame:
    """All documents against a version of all: every seventh dropped, every fifth with another line, every eleventh also
    under a new name."""
    old = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), "doc_id", F.col("text").alias("content"))
    kept = old.where("doc_id % 7 <> 3").withColumn("content", F.when(F.expr("doc_id % 5 = 2"), F.concat("content", F.lit("\nedited"))).otherwise(F.col("content")))
    added = old.where("doc_id % 11 = 5").withColumn("file_name", F.concat(F.lit("new-"), "file_name"))
    named = lambda x: x.drop("doc_id").withColumn("path", F.col("file_name"))
    return diff.corpora(named(old), named(kept.unionByName(added)))


_direct("diff", _diff, ("documents",), """
WITH f AS (SELECT doc_id, text, len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)))::BIGINT AS n FROM documents)
SELECT doc_id || '.md' AS file_name, 'deleted' AS change, n AS old_lines, NULL::BIGINT AS new_lines FROM f WHERE doc_id % 7 = 3
UNION ALL SELECT doc_id || '.md', 'modified', n, len(string_split(text, chr(10))) + 1 FROM f WHERE doc_id % 7 <> 3 AND doc_id % 5 = 2
UNION ALL SELECT 'new-' || doc_id || '.md', 'added', NULL, n FROM f WHERE doc_id % 11 = 5""")
_direct("line_similarity", lambda d: d.alias("a").join(d.alias("b"), F.col("a.doc_id") + 1 == F.col("b.doc_id")).select(F.col("a.doc_id").alias("doc_id"), diff.line_changes(F.col("a.text"), F.col("b.text")).alias("c")).select("doc_id", "c.*"), ("documents",), r"""
WITH x AS (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents),
p AS (SELECT a.doc_id, len(list_filter(b.l, lambda y: NOT list_contains(a.l, y))) AS ad, len(list_filter(a.l, lambda y: NOT list_contains(b.l, y))) AS re, greatest(len(a.l), len(b.l)) AS m FROM x a JOIN x b ON a.doc_id + 1 = b.doc_id)
SELECT doc_id, ad::BIGINT AS added, re::BIGINT AS removed, least(ad, re)::BIGINT AS modified, round(greatest(0, (m - (ad + re) / 2) / m * 100), 6)::DOUBLE AS similarity FROM p""")
_direct("char_similarity", lambda p: p.select("p_partkey", F.round(T.similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity")), ("part",), """
SELECT p_partkey, round(len(list_filter(string_split(p_name, ''), lambda c: contains(p_type, c))) / greatest(strlen(p_name), strlen(p_type)), 9) AS similarity FROM part""")
_direct("labels_format", lambda d: d.select("doc_id", T.file_size_label(F.octet_length("text").cast("long")).alias("size"), T.word_count_label(T.words(F.col("text"))).alias("words")), ("documents",), f"""
WITH s AS (SELECT doc_id, strlen(text) AS n, {words('text')} AS w FROM documents)
SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', round(n / 1073741824, 2)) WHEN n >= 1048576 THEN printf('%.2f MB', round(n / 1048576, 2)) WHEN n >= 1024 THEN printf('%.2f KB', round(n / 1024, 2)) ELSE n || ' B' END AS size,
  CASE WHEN w >= 1000000 THEN printf('%.1fM', round(w / 1000000, 1)) WHEN w >= 1000 THEN printf('%.1fK', round(w / 1000, 1)) ELSE w::VARCHAR END AS words FROM s""")
_corpus("prose_words", lambda d: d.select("path", Y.count_prose_words(Y.body(F.col("content"))).alias("n")), rf"""+ bl AS (
  SELECT path, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT path, string_split(regexp_replace(body, '\n\z', ''), chr(10)) AS l FROM docs)),
bf AS (SELECT path, text, starts_with(trim(text), '```') AS f, sum(CASE WHEN starts_with(trim(text), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS k FROM bl)
SELECT path, sum(CASE WHEN f OR k % 2 = 1 THEN 0 ELSE {words("translate(text, '#*_`', '    ')")} END)::BIGINT AS n FROM bf GROUP BY 1""")
_corpus("id_ancestors", lambda d: d.where("doc_id is not null").select("path", F.array_join(I.ancestors(F.col("doc_id")), "/").alias("ancestors"), F.array_join(I.breadcrumb(F.col("breadcrumb")), "/").alias("crumbs")), r"""
SELECT path, array_to_string(list_transform(range(1, len(string_split(doc_id, '.'))), lambda i: array_to_string(string_split(doc_id, '.')[1:i], '.')), '/') AS ancestors,
  array_to_string(list_filter(list_transform(string_split(breadcrumb, '>'), lambda s: trim(s)), lambda s: s <> ''), '/') AS crumbs FROM docs WHERE doc_id IS NOT NULL""")

# --- rewrites, schema, export -----------------------------------------------------------------------------------------
_corpus("sync_changes", lambda d: rewrite.changes(rewrite.sync(d, "2024-06-01 00:00:00", children=True)), rf"""+ s AS (
  SELECT path, stem, {first('content_hash')} AS stored, {_hash} AS h, coalesce({first('last_updated')}, 'N/A') AS day, {first('children_count', True)} AS said FROM docs),
k AS (SELECT parent, count(*) AS n FROM up WHERE parent NOT IN ('null', '') GROUP BY 1)
SELECT path, 'last_updated' AS field, day AS old_value, '2024-06-01 00:00:00' AS new_value FROM s WHERE stored <> h
UNION ALL SELECT path, 'content_hash', stored, h FROM s WHERE stored <> h
UNION ALL SELECT path, 'children_count', said, coalesce(n, 0)::VARCHAR FROM s LEFT JOIN k ON k.parent = s.stem WHERE said::BIGINT <> coalesce(n, 0)""")
_corpus("sync_states", lambda d: rewrite.sync(d, "2024-06-01 00:00:00").groupBy("state").agg(F.count(F.lit(1)).alias("n")), rf"""+ s AS (SELECT {first('content_hash')} AS stored, {_hash} AS h FROM docs)
SELECT CASE WHEN stored IS NULL THEN 'initialize' WHEN stored <> h THEN 'update' ELSE 'unchanged' END AS state, count(*) AS n FROM s GROUP BY 1""")
_corpus("fix_dates", rewrite.fix_dates, rf"""+ s AS (SELECT path, mtime_s, {first('last_updated')} AS said FROM docs)
SELECT path, 'last_updated' AS field, said AS old_value, strftime(make_timestamp(mtime_s * 1000000), '%Y-%m-%d %H:%M:%S') AS new_value FROM s WHERE said IS NOT NULL AND abs(mtime_s - epoch(strptime(said, '%Y-%m-%d'))::BIGINT) // 3600 >= 24""")
_corpus("fix_hashes", rewrite.fix_hashes, rf"""+ s AS (SELECT path, {first('content_hash')} AS old_value, {_hash} AS new_value FROM docs)
SELECT path, 'content_hash' AS field, old_value, new_value FROM s WHERE old_value <> new_value""")
_corpus("fix_tables", lambda d: rewrite.fix_tables(d).withColumn("line_no", F.col("line_no").cast("long")), r"""+ r AS (SELECT path, line_no, text, string_split(text, '|') AS c FROM lines WHERE starts_with(path, 'Nat-') AND regexp_matches(text, '^\| \[\[[0-9]')),
x AS (SELECT path, line_no, text, regexp_extract(c[2], '\[\[([^\] ]+)', 1) AS id, trim(c[3])::BIGINT AS claimed FROM r),
d AS (SELECT id, (SELECT count(*) FROM docs f WHERE NOT contains(f.path, '/') AND starts_with(f.file_name, x.id || '.') AND regexp_matches(substr(f.file_name, length(x.id) + 2), '^[0-9]')) AS n FROM (SELECT DISTINCT id FROM x) x)
SELECT path, line_no, regexp_replace(text, '\d+(\s*\|\s*)$', n || '\1') AS text FROM x JOIN d USING (id) WHERE n <> claimed""")
_corpus("set_field", lambda d: rewrite.set_field(d, "status", "review").select("path", F.sha2("content", 256).alias("sha")), r"SELECT path, sha256(regexp_replace(content, 'status:[^\n]*', 'status: review')) AS sha FROM docs")
_corpus("remove_field", lambda d: rewrite.remove_field(d, "draft").select("path", F.sha2("content", 256).alias("sha")), r"SELECT path, sha256(regexp_replace(content, '(?m)^draft:\s*.*\n?', '', 'g')) AS sha FROM docs")
_corpus("mark_archived", lambda d: rewrite.mark_archived(d, ["D11", "Nat-3", "D112"]).select("path", F.sha2("content", 256).alias("sha")), "SELECT path, sha256(" + "".join(["replace("] * 9) + "content"
        + "".join(f", '{x}', '{x} (ARCHIVADO)')" for i in ("D11", "Nat-3", "D112") for x in (f"[[{i}]]", f"[{i}]", f"parent_id: {i}")) + ") AS sha FROM docs")
_corpus("rename_links", lambda d: rewrite.rename_links(d, "Nat-3", "Nation-3").select("path", F.sha2("content", 256).alias("sha")), "SELECT path, sha256(replace(replace(content, '[[Nat-3]]', '[[Nation-3]]'), '(Nat-3.md)', '(Nation-3.md)')) AS sha FROM docs")
_corpus("archivable", lambda d: rewrite.archivable(d, "stub,obsoleto"), rf"""+ s AS (SELECT path, stem, lower({first('status')}) AS status, {first('document_id')} AS document_id FROM docs) SELECT * FROM s WHERE contains(status, 'stub') OR contains(status, 'obsoleto')""")
_corpus("next_id", lambda d: rewrite.next_id(d, "1.1"), "SELECT '1.1.' || (count(*) FILTER (starts_with(doc_id, '1.1.')) + 1) AS doc_id, '1.1' AS parent FROM docs")
_corpus("schema_violations", schema.violations, f"""SELECT path, 'status' AS field, 'invalid_value' AS violation, 'one of: draft, active, deprecated, archived, reviewed' AS suggestion FROM docs WHERE status NOT IN ('draft', 'active', 'deprecated', 'archived', 'reviewed')
UNION ALL SELECT path, 'id', 'missing_required', NULL FROM docs WHERE doc_id IS NULL UNION ALL SELECT path, 'title', 'missing_required', NULL FROM docs WHERE title IS NULL""")
_corpus("schema_defaults", schema.defaults, "SELECT path, 'status' AS field, 'draft' AS default FROM docs WHERE status IS NULL".replace("AS default", 'AS "default"'))
_corpus("predictions", lambda d: schema.predictions(d, "2024-02-20"), r"""+ s AS (SELECT path, date_diff('day', strptime(last_updated, '%Y-%m-%d')::DATE, DATE '2024-02-20') AS n FROM docs WHERE last_updated IS NOT NULL),
k AS (SELECT path, len(regexp_extract_all(content, '\[\[([^\]]+)\]\]')) + len(regexp_extract_all(content, '\[([^\]]*)\]\(([^)]+)\)')) AS n FROM docs)
SELECT path, 'stale_document' AS kind, CASE WHEN n > 60 THEN 'high' ELSE 'medium' END AS confidence, n::BIGINT AS n FROM s WHERE n > 30
UNION ALL SELECT path, 'broken_link_risk', 'low', n::BIGINT FROM k WHERE n > 10""")
_routes = "(VALUES " + ", ".join(f"({k}, '{a}', '{r[1]}', {str(r[2]).lower()})" for k, a in schema.ANOMALIES.items() if k.isdigit() for r in schema.ROUTES if r[0] == a) + ") r(phase, anomaly, action, auto_safe)"
_corpus("fix_routes", lambda d: schema.routed(verify.verify(d), "phase").groupBy("anomaly", "action", "auto_safe").agg(F.count(F.lit(1)).alias("n")), _issues + f" SELECT anomaly, action, auto_safe, count(*) AS n FROM issues JOIN {_routes} USING (phase) GROUP BY ALL")
_corpus("compiled", lambda d: export.compiled(d).select("path", "title", "module", "anchor", F.length("section").cast("long").alias("n")), rf"""
SELECT path, coalesce({first('title')}, stem) AS title, {first('module')} AS module, lower(replace(replace(stem, '.', '-'), ' ', '-')) AS anchor, length(CASE WHEN closed THEN regexp_replace(body, '^\s+|\s+$', '', 'g') ELSE content END)::BIGINT AS n
FROM docs WHERE NOT regexp_matches(content, 'draft:\s*true')""")
_corpus("compiled_contents", lambda d: export.contents(export.compiled(d)), rf"""SELECT path, '- [' || coalesce({first('title')}, stem) || '](#' || lower(replace(replace(stem, '.', '-'), ' ', '-')) || ')' AS line FROM docs WHERE NOT regexp_matches(content, 'draft:\s*true')""")
_corpus("export_index", lambda d: export.index(d, "M1", ("Cust-", "C_")), rf"""SELECT path, CASE WHEN starts_with(file_name, 'Cust-') THEN 'C_' || substr(file_name, 6) ELSE file_name END AS target, {first('title')} AS title, {words('content')}::BIGINT AS words, substr(sha256(content), 1, 16) AS hash FROM docs WHERE contains({first('module')}, 'M1')""")
_corpus("export_budget", lambda d: export.token_budget(d, 20_000), "+ s AS (SELECT path, ceil(length(content) / 4)::BIGINT AS tokens FROM docs), t AS (SELECT path, tokens, sum(tokens) OVER (ORDER BY path)::BIGINT AS total FROM s) SELECT * FROM t WHERE total <= 20000")
_corpus("export_json", lambda d: export.to_json(d.select("path", "doc_id", "title")), """
SELECT '{' || array_to_string(list_filter(['"path":"' || path || '"', '"doc_id":"' || doc_id || '"', '"title":"' || title || '"'], lambda x: x IS NOT NULL), ',') || '}' AS json FROM docs""")
_corpus("html_sections", lambda d: export.compiled(d).select("path", F.sha2(export.html_section(F.col("title"), F.col("section")), 256).alias("sha")), rf"""+ s AS (
  SELECT path, coalesce({first('title')}, stem) AS title, CASE WHEN closed THEN regexp_replace(body, '^\s+|\s+$', '', 'g') ELSE content END AS section FROM docs WHERE NOT regexp_matches(content, 'draft:\s*true'))
SELECT path, sha256('<section><h2>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h2><pre>' || replace(replace(replace(section, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></section>') AS sha FROM s""")

# --- streams and telemetry --------------------------------------------------------------------------------------------
_direct("watch_events", lambda e: watch.from_history(e.select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("mtime"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), ("events",), """
WITH h AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS l FROM events)
SELECT CASE WHEN l IS NULL THEN 'created' ELSE 'modified' END AS kind, count(*) AS n FROM h WHERE l IS NULL OR l <> ts GROUP BY 1""")
_direct("watch_between", lambda e: watch.between(e.where("ts < '2024-01-15'").groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("mtime")), e.groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("mtime"))), ("events",), """
WITH a AS (SELECT user_id AS path, max(ts) AS m FROM events WHERE ts < '2024-01-15' GROUP BY 1), b AS (SELECT user_id AS path, max(ts) AS m FROM events GROUP BY 1)
SELECT path, CASE WHEN a.m IS NULL THEN 'created' ELSE 'modified' END AS kind FROM b LEFT JOIN a USING (path) WHERE a.m IS NULL OR a.m <> b.m""")
_direct("telemetry", lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")), ("events",), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
_direct("trend", lambda e: rewrite.latest_trend(e.withColumn("at", F.struct("ts", "event_id")), "event_type", "at", "value", 50), ("events",), """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events)
SELECT event_type, round(avg(CASE WHEN i <= 50 THEN value END), 6) AS recent, round(avg(value), 6) AS overall FROM r GROUP BY 1""")

# --- typed frontmatter, generated texts, scores, histories --------------------------------------------------------------
_typed = r"""+ kv AS (SELECT path, unnest(string_split(yaml, chr(10))) AS l FROM docs WHERE closed),
f AS (SELECT path, split_part(l, ':', 1) AS key, nullif(trim(trim(substr(l, strpos(l, ':') + 1)), '"'), 'null') AS v FROM kv WHERE contains(l, ':')),
p AS (SELECT d.path, max(v) FILTER (key = 'id') AS id, max(v) FILTER (key = 'title') AS title, max(v) FILTER (key = 'parent') AS parent, max(v) FILTER (key = 'type') AS doc_type,
    max(v) FILTER (key = 'status') AS status, max(v) FILTER (key = 'children_count')::BIGINT AS children_count, bool_or(closed) AS closed FROM docs d LEFT JOIN f ON f.path = d.path GROUP BY 1),
e AS (SELECT *, CASE WHEN NOT closed THEN 'missing frontmatter' WHEN id IS NULL THEN 'missing field: id' WHEN title IS NULL THEN 'missing field: title' END AS parse_error FROM p),
y AS (SELECT * EXCLUDE (closed), parse_error IS NULL AND title <> '' AND regexp_full_match(id, '\d+(\.\d+)*') AS valid FROM e)"""
_corpus("frontmatter_typed", lambda d: corpus.parsed(d).select("path", "id", "title", "parent", "doc_type", "status", "children_count", "parse_error", "valid"), _typed + " SELECT * FROM y")
_corpus("frontmatter_bodies", lambda d: corpus.parsed(d).where("parse_error is null").select("path", F.sha2("body", 256).alias("sha")), _typed + r"""
SELECT path, sha256(regexp_replace(body, '^\s+', '')) AS sha FROM docs JOIN y USING (path) WHERE parse_error IS NULL""")
_corpus("validity", lambda d: corpus.validity(corpus.parsed(d)), _typed + " SELECT count(*) AS documents, count(*) FILTER (valid) AS valid, count(*) FILTER (parse_error IS NOT NULL) AS errors FROM y")
_direct("frontmatter_build", lambda d: d.select("doc_id", F.concat(Y.build({"id": F.col("doc_id"), "title": F.concat(F.lit("Doc "), "doc_id"), "domain": F.col("source"), "tags": Y.bracketed(F.array("lang", "source"))}), F.coalesce("text", F.lit(""))).alias("c")).select("doc_id", F.sha2("c", 256).alias("sha")), ("documents",), """
SELECT doc_id, sha256('---' || chr(10) || 'id: ' || doc_id || chr(10) || 'title: Doc ' || doc_id || chr(10) || coalesce('domain: ' || source || chr(10), '') ||
  'tags: [' || array_to_string([lang, source], ', ') || ']' || chr(10) || '---' || chr(10) || coalesce(text, '')) AS sha FROM documents""")
_direct("frontmatter_lists", lambda d: d.select("doc_id", Y.typed(F.format_string("\nid: %d\ntags: [%s, '%s']\nactors:\n  - %s\n  - \"b c\"\ntitle: T # note\ntype: x\n", "doc_id", "lang", "source", "lang")).alias("f")).select("doc_id", F.array_join("f.tags", "/").alias("tags"), F.array_join("f.actors", "/").alias("actors"), "f.title", "f.doc_type", "f.parse_error"), ("documents",), """
SELECT doc_id, lang || '/' || source AS tags, lang || '/b c' AS actors, 'T' AS title, 'x' AS doc_type, NULL::VARCHAR AS parse_error FROM documents""")
_corpus("relative_depth", lambda d: d.select("path", I.relative_depth(F.col("doc_id"), "1.1").alias("depth")), "SELECT path, greatest(len(regexp_replace(regexp_extract(doc_id, '^[0-9.]*'), '[^.]', '', 'g')) - 1, 0)::BIGINT AS depth FROM docs")
_corpus("graph_nodes", lambda d: graph.nodes(graph.edges(d)), _edges + " SELECT src AS node FROM ed UNION SELECT dst FROM ed")

_by_module = f"+ m AS (SELECT coalesce({first('module')}, 'sin_modulo') AS module, {words('content')} AS w FROM docs), g AS (SELECT module, count(*) AS documents, sum(w)::BIGINT AS words FROM m GROUP BY 1)"
_corpus("readme_modules", reports.readme_modules, _by_module + " SELECT * FROM g")
_corpus("readme_text", lambda d: reports.readme(d, "Docs", badges=True, template="{{PROJECT_NAME}}: {{DOC_COUNT}} in {{MODULE_COUNT}}, {{DATE}}\n", date="2024-01-01").select("part", "text"), _by_module + """,
t AS (SELECT sum(documents)::BIGINT AS d, sum(words)::BIGINT AS w, count(*) AS m FROM g), n AS (SELECT chr(10) AS n)
SELECT 0 AS part, '![Docs](https://img.shields.io/badge/docs-' || d || '-blue)' || n || '![Words](https://img.shields.io/badge/words-' || w || '-green)' || n AS text FROM t, n
UNION ALL SELECT 1, '# Docs' || n || n FROM n UNION ALL SELECT 2, '- documents: ' || d || n || '- words: ' || w || n || '- modules: ' || m || n || n FROM t, n
UNION ALL SELECT 3, '| module | documents |' || n || '|---|---|' || n FROM n UNION ALL SELECT 4, '| ' || module || ' | ' || documents || ' |' || n FROM g, n
UNION ALL SELECT 5, 'Docs: ' || d || ' in ' || m || ', 2024-01-01' || n FROM t, n""")
_corpus("report_text", lambda d: reports.markdown(stats.report_modules(d).select(F.col("module_id").cast("int").alias("seq"), F.concat(F.lit("Module "), "module_id").alias("title"), F.col("n").cast("string").alias("content"), F.lit(2).alias("level")), "Report", "now"), """
SELECT 0 AS part, '' AS place, '# Report' || chr(10) || chr(10) || '*now*' || chr(10) || chr(10) AS text
UNION ALL SELECT 1, lpad(m, 20, '0'), '## Module ' || m || chr(10) || chr(10) || n || chr(10) || chr(10) FROM (SELECT split_part(doc_id, '.', 1) AS m, count(*) AS n FROM docs WHERE doc_id IS NOT NULL GROUP BY 1)""")
_direct("changelog", lambda o: reports.changelog(o.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("m")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("changes")).select(F.col("m").cast("int").alias("seq"), F.col("m").alias("version"), F.lit("2024").alias("date"), "changes")), ("orders",), """
WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS m, o_orderstatus AS s FROM orders)
SELECT m::INT AS seq, '[' || m || '] - 2024' AS title, string_agg('- ' || s, chr(10) ORDER BY s) AS content, 2 AS level FROM m GROUP BY m""")
_sections = rf"""+ s AS (SELECT path, stem, coalesce({first('title')}, stem) AS title, CASE WHEN closed THEN regexp_replace(body, '^\s+|\s+$', '', 'g') ELSE content END AS section
  FROM docs WHERE NOT regexp_matches(content, 'draft:\s*true'))"""
_corpus("compiled_text", lambda d: reports.compiled(d, "now").select("part", "place", F.sha2("text", 256).alias("sha")), _sections + """, t AS (
SELECT 0 AS part, '' AS place, '# Contents' || chr(10) || chr(10) AS text
UNION ALL SELECT 1, path, '- [' || title || '](#' || lower(translate(stem, '. ', '--')) || ')' || chr(10) FROM s
UNION ALL SELECT 2, '', chr(10) || chr(10) || '---' || chr(10) || 'generated: now' || chr(10) || '---' || chr(10) || chr(10)
UNION ALL SELECT 3, path, chr(10) || '---' || chr(10) || chr(10) || '## ' || title || ' {' || stem || '}' || chr(10) || chr(10) || section || chr(10) || chr(10) FROM s) SELECT part, place, sha256(text) AS sha FROM t""")
_corpus("compiled_html", lambda d: reports.compiled_html(d, "Docs").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("length")), _sections + """,
h AS (SELECT length(section) + 4 * len(regexp_extract_all(section, '&')) + 3 * len(regexp_extract_all(section, '[<>]')) + length(title) + 4 * len(regexp_extract_all(title, '&')) + 3 * len(regexp_extract_all(title, '[<>]')) AS l FROM s)
SELECT 0 AS part, 1::BIGINT AS n, length('<!DOCTYPE html>.<html>.<head><meta charset="UTF-8"><title>Docs</title></head>.<body>.')::BIGINT AS length
UNION ALL SELECT 1, count(*), sum(l + length('<section><h2></h2><pre></pre></section>.'))::BIGINT FROM h UNION ALL SELECT 2, 1, length('</body>.</html>.')""")
_corpus("compiled_summary", reports.compiled_summary, rf"SELECT count(*) AS documents, sum({words('content')})::BIGINT AS words, count(DISTINCT {first('module')}) AS modules FROM docs WHERE NOT regexp_matches(content, 'draft:\s*true')")
_corpus("tree_mermaid", lambda d: reports.tree_mermaid(graph.tree(d)), _tree + r""" SELECT 0 AS part, '' AS place, 'graph TD' || chr(10) AS text
UNION ALL SELECT 1, node, '    ' || regexp_replace(node, '[^A-Za-z0-9]', '_', 'g') || '["' || node || '"]' || chr(10) FROM tt
UNION ALL SELECT 2, node, '    ' || regexp_replace(parent, '[^A-Za-z0-9]', '_', 'g') || ' --> ' || regexp_replace(node, '[^A-Za-z0-9]', '_', 'g') || chr(10) FROM tt WHERE parent IS NOT NULL""")
_corpus("trace_mermaid", lambda d: reports.trace_mermaid(graph.trace(d, "Nat-3", 3)).where("part = 1").select("place"), _edges + """
SELECT DISTINCT 'Nat-3' || chr(9) || node AS place FROM up2 WHERE parent = 'Nat-3' UNION SELECT node || chr(9) || parent FROM up2 WHERE node = 'Nat-3'
UNION SELECT u.node || chr(9) || u.parent FROM up2 u JOIN up2 v ON v.parent = u.node WHERE v.node = 'Nat-3' UNION SELECT src || chr(9) || dst FROM ed WHERE kind = 'link' AND src = 'Nat-3'""")

_meta = f"""+ e AS (SELECT path, stem AS id, coalesce({first('title')}, stem) AS title, {first('module')} AS module, {words('content')}::BIGINT AS word_count, file_name, stem FROM docs),
x AS (SELECT path, id, title, module, word_count, coalesce(replace(replace(module, ' ', '_'), '.', '-') || '_' || file_name, file_name) AS exported_as FROM e WHERE contains(module, 'M2') OR starts_with(stem, 'Nat-'))"""
_corpus("export_metadata", lambda d: export.metadata(d, ("M2", "Nat-"), True), _meta + " SELECT * FROM x")
_corpus("export_totals", lambda d: export.index_totals(export.metadata(d, ("M2", "Nat-"), True)), _meta + " SELECT count(*) AS total_files, count(DISTINCT module) AS modules, sum(word_count)::BIGINT AS words FROM x")

_six = " + ".join(f"({c} IS NOT NULL)::INT" for c in reports.REQUIRED)
_corpus("scores", reports.scores, f"""+ s AS (SELECT path, least({words('body')}, 300) / 300 * 100 AS h, ({_six}) / 6 * 100 AS c FROM docs), q AS (SELECT *, (h + c) / 2 AS q FROM s)
SELECT path, round(h, 6) AS health, round(c, 6) AS completeness, round(q, 6) AS quality, CASE WHEN q >= 80 THEN 'none' WHEN q >= 60 THEN 'warning' WHEN q >= 40 THEN 'high' ELSE 'critical' END AS alert, h > 80 AS healthy, c > 90 AS complete FROM q""")
_corpus("issues_by_severity", lambda d: reports.by_severity(reports.at_least(verify.verify(d), "warning")), _issues + " SELECT severity, count(*) AS n FROM issues GROUP BY 1")
_kinds = "(VALUES " + ", ".join(f"({k}, '{r[3]}', {str(r[2]).lower()})" for k, a in schema.ANOMALIES.items() if k.isdigit() for r in schema.ROUTES if r[0] == a) + ") r(phase, urgency, safe)"
_corpus("repair_summary", lambda d: reports.repair_summary(schema.routed(verify.verify(d), "phase")), _issues + f""" SELECT count(*) FILTER (urgency = 'low') AS trivial, count(*) FILTER (urgency = 'medium') AS minor,
  count(*) FILTER (urgency = 'high') AS major, count(*) FILTER (urgency = 'critical') AS critical, count(*) FILTER (safe) AS auto FROM issues JOIN {_kinds} USING (phase)""")
_heal = r"""CASE WHEN regexp_matches(yaml, '(?m)^last_updated:') THEN regexp_replace(yaml, '(?m)^last_updated:[^\n]*', 'last_updated: 2024-06-01 10:00') ELSE yaml || 'last_updated: 2024-06-01 10:00' || chr(10) END"""
_corpus("heal_dates", lambda d: rewrite.heal_dates(d, "2024-06-01 10:00").select("path", F.sha2("content", 256).alias("sha"), "healed"), f"SELECT path, sha256(CASE WHEN closed THEN '---' || {_heal} || '---' || body ELSE content END) AS sha, closed AS healed FROM docs")
_trimmed = r"array_to_string(list_transform(string_split(regexp_replace(content, '\n\z', ''), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10))"
_corpus("heal_whitespace", lambda d: rewrite.heal_whitespace(d).select("path", F.sha2("content", 256).alias("sha")), f"SELECT path, sha256({_trimmed}) AS sha FROM docs")
_corpus("auto_fix", lambda d: rewrite.auto_fix(d, "2024-06-01 10:00").select("path", F.array_join("fixes", ",").alias("fixes")), rf"""+ f AS (SELECT path, closed, content, regexp_replace({_trimmed}, '\n+\z', '') || chr(10) AS new FROM docs)
SELECT path, CASE WHEN closed THEN 'lint,date' ELSE 'lint' END AS fixes FROM f WHERE new <> content""")
_corpus("change_totals", lambda d: history.change_totals(rewrite.changes(rewrite.sync(d, "2024-06-01 00:00:00"))), rf"""+ s AS (SELECT path, {first('content_hash')} AS stored, {_hash} AS h FROM docs) SELECT 2 * count(*) AS changes, count(DISTINCT path) AS files FROM s WHERE stored <> h""")
_corpus("batch_rate", lambda d: history.batch_rate(d.select(F.col("content").contains("status:").alias("success"))), "SELECT count(*) AS items, count(*) FILTER (contains(content, 'status:')) AS succeeded, round(count(*) FILTER (contains(content, 'status:')) / count(*) * 100, 6) AS rate FROM docs")
_corpus("batch_rate_empty", lambda d: history.batch_rate(d.where("path = ''").select(F.lit(True).alias("success"))), "SELECT 0::BIGINT AS items, 0::BIGINT AS succeeded, 100.0::DOUBLE AS rate")
_corpus("module_registry_totals", lambda d: stats.registry_totals(stats.module_registry(d)), rf"""+ m AS (SELECT doc_id, title, {words('body')} AS w FROM docs WHERE regexp_full_match(doc_id, '\d+(\.\d+)*')),
g AS (SELECT count(*) AS n, count(*) FILTER (title IS NOT NULL AND w >= 50) / count(*) * 100 AS c FROM m GROUP BY split_part(doc_id, '.', 1)) SELECT count(*) AS modules, sum(n)::BIGINT AS documents, round(avg(c), 4) AS coverage FROM g""")
_runs = lambda e: e.select("event_type", "user_id", "event_id", "ts", (F.col("value") >= 20).alias("success"), F.col("value").cast("double").alias("seconds"), F.lit(100).cast("long").alias("docs"))
_rs = """WITH r AS (SELECT event_type, count(*) AS runs, round(count(*) FILTER (value >= 20) / count(*) * 100, 6) AS success_rate, round(sum(value) / count(*), 6) AS average,
  round(CASE WHEN sum(value) > 0 THEN count(*) * 100 / sum(value) ELSE 0 END, 6) AS per_second FROM events GROUP BY 1)"""
_direct("run_stats", lambda e: history.stats(_runs(e), "event_type"), ("events",), _rs + " SELECT * FROM r")
_direct("run_suggestions", lambda e: history.suggestions(history.stats(_runs(e), "event_type")).select("event_type", "suggestion"), ("events",), _rs + """
SELECT event_type, 'validate before commands' AS suggestion FROM r WHERE success_rate < 90 UNION ALL SELECT event_type, 'cache what is read' FROM r WHERE per_second < 10 AND runs > 5""")
_direct("run_recent", lambda e: history.recent(_runs(e).withColumn("at", F.struct("ts", "event_id")), "event_type", "at", 10).select("event_type", "event_id", "place"), ("events",), """
SELECT event_type, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 10""")
_hooks = "# on change\n\nlint $FILE\necho done $FILE\n"
_direct("hook_commands", lambda e: registry.hook_commands(watch.from_history(e.select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("mtime"))), _hooks).groupBy("path", "seq", "command").agg(F.count(F.lit(1)).alias("n")), ("events",), """
WITH h AS (SELECT user_id::VARCHAR AS path, count(DISTINCT ts) AS n FROM events GROUP BY 1)
SELECT path, 0 AS seq, 'lint ' || path AS command, n FROM h UNION ALL SELECT path, 1, 'echo done ' || path, n FROM h""")
