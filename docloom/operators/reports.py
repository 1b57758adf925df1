"""Generated texts (README, report, changelog, compiled corpus, Mermaid) as ordered pieces, and scores.

A generated text is a table (part, place, text): ordered by part and place, its rows are the text. So no row holds more than
one document, and `write_text` streams the pieces into one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import text as T
from docloom.operators import export


def _piece(df: DataFrame, part: int, text: Column, place: Column | None = None) -> DataFrame:
    return df.select(F.lit(part).alias("part"), (F.lit("") if place is None else place).alias("place"), text.alias("text"))


def _pieces(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def readme_modules(docs: DataFrame) -> DataFrame:
    """(module, documents, words) by the `module:` field; documents without one are "sin_modulo"."""
    module = F.coalesce(Y.first_field(F.col("content"), "module"), F.lit("sin_modulo"))
    return docs.groupBy(module.alias("module")).agg(F.count(F.lit(1)).alias("documents"), F.sum(T.words(F.col("content"))).alias("words"))


def readme(docs: DataFrame, title: str, badges: bool = False, stats: bool = True, toc: bool = True, template: str | None = None, date: str = "") -> DataFrame:
    """Pieces of a README: badges, title, totals, modules by falling number of documents, a template with its marks filled in."""
    modules = readme_modules(docs)
    totals = modules.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("d"), F.coalesce(F.sum("words"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("m"))
    parts = [_piece(totals, 1, F.lit(f"# {title}\n\n"))]
    if badges:
        badge = "![%s](https://img.shields.io/badge/%s-%%d-%s)\n"
        parts.append(_piece(totals, 0, F.format_string(badge % ("Docs", "docs", "blue") + badge % ("Words", "words", "green"), "d", "w")))
    if stats:
        parts.append(_piece(totals, 2, F.format_string("- documents: %d\n- words: %d\n- modules: %d\n\n", "d", "w", "m")))
    if toc:
        parts.append(_piece(totals, 3, F.lit("| module | documents |\n|---|---|\n")))
        place = F.concat(F.lpad((F.lit(10**18) - F.col("documents")).cast("string"), 20, "0"), "module")
        parts.append(_piece(modules, 4, F.format_string("| %s | %d |\n", "module", "documents"), place))
    if template is not None:
        filled = F.lit(template)
        for mark, value in {"PROJECT_NAME": F.lit(title), "DOC_COUNT": F.col("d"), "WORD_COUNT": F.col("w"), "MODULE_COUNT": F.col("m"), "DATE": F.lit(date)}.items():
            filled = F.replace(filled, F.lit("{{" + mark + "}}"), value.cast("string"))
        parts.append(_piece(totals, 5, filled))
    return _pieces(parts)


def markdown(sections: DataFrame, title: str, generated: str) -> DataFrame:
    """Pieces of a report from sections (seq, title, content, level)."""
    head = sections.sparkSession.range(1)
    text = F.concat(F.expr("repeat('#', level)"), F.lit(" "), "title", F.lit("\n\n"), "content", F.lit("\n\n"))
    return _pieces([_piece(head, 0, F.lit(f"# {title}\n\n*{generated}*\n\n")), _piece(sections, 1, text, F.lpad(F.col("seq").cast("string"), 20, "0"))])


def changelog(entries: DataFrame) -> DataFrame:
    """Sections (seq, title, content, level) from entries (seq, version, date, changes)."""
    lines = F.array_join(F.transform("changes", lambda c: F.concat(F.lit("- "), c)), "\n")
    return entries.select("seq", F.concat(F.lit("["), "version", F.lit("] - "), "date").alias("title"), lines.alias("content"), F.lit(2).alias("level"))


def compiled(docs: DataFrame, generated: str, module_prefix: str | None = None) -> DataFrame:
    """Pieces of the compiled Markdown: contents, head, then every document that is no draft in order of path."""
    d = export.compiled(docs, module_prefix)
    one = docs.sparkSession.range(1)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    section = F.concat(F.lit("\n---\n\n## "), "title", F.lit(" {"), stem, F.lit("}\n\n"), "section", F.lit("\n\n"))
    return _pieces([
        _piece(one, 0, F.lit("# Contents\n\n")), _piece(export.contents(d), 1, F.concat("line", F.lit("\n")), F.col("path")),
        _piece(one, 2, F.lit(f"\n\n---\ngenerated: {generated}\n---\n\n")), _piece(d, 3, section, F.col("path")),
    ])


def compiled_html(docs: DataFrame, title: str, module_prefix: str | None = None) -> DataFrame:
    """Pieces of the compiled HTML page."""
    d = export.compiled(docs, module_prefix)
    one = docs.sparkSession.range(1)
    head = f'<!DOCTYPE html>\n<html>\n<head><meta charset="UTF-8"><title>{title}</title></head>\n<body>\n'
    body = F.concat(export.html_section(F.col("title"), F.col("section")), F.lit("\n"))
    return _pieces([_piece(one, 0, F.lit(head)), _piece(d, 1, body, F.col("path")), _piece(one, 2, F.lit("</body>\n</html>\n"))])


def compiled_summary(docs: DataFrame, module_prefix: str | None = None) -> DataFrame:
    """One row for the compiled JSON: documents that are no drafts, their words, their modules."""
    d = docs.where(~Y.is_draft(F.col("content")))
    d = d if module_prefix is None else d.where(F.col("stem").startswith(module_prefix))
    module = Y.first_field(F.col("content"), "module")
    return d.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(T.words(F.col("content"))), F.lit(0)).alias("words"), F.count_distinct(module).alias("modules"))


def tree_mermaid(nodes: DataFrame) -> DataFrame:
    """Pieces of a Mermaid graph of rows of `graph.tree`."""
    name = T.node_id(F.col("node"))
    label = F.translate("node", '"[]', "'()")
    arrows = nodes.where("parent is not null")
    return _pieces([
        _piece(nodes.sparkSession.range(1), 0, F.lit("graph TD\n")), _piece(nodes, 1, F.concat(F.lit("    "), name, F.lit('["'), label, F.lit('"]\n')), F.col("node")),
        _piece(arrows, 2, F.concat(F.lit("    "), T.node_id(F.col("parent")), F.lit(" --> "), name, F.lit("\n")), F.col("node")),
    ])


def trace_mermaid(references: DataFrame) -> DataFrame:
    """Pieces of a Mermaid graph of rows of `graph.trace`, each pair once."""
    pairs = references.select("source", "target").distinct()
    line = F.concat(F.lit("    "), T.node_id(F.col("source")), F.lit(" --> "), T.node_id(F.col("target")), F.lit("\n"))
    return _pieces([_piece(references.sparkSession.range(1), 0, F.lit("graph TD\n")), _piece(pairs, 1, line, F.concat("source", F.lit("\t"), "target"))])


def write_text(pieces: DataFrame, file: str) -> int:
    """Streams the pieces in their order into one file on the driver, partition by partition; returns its bytes."""
    n = 0
    with open(file, "wb") as out:
        for row in pieces.orderBy("part", "place").select("text").toLocalIterator():
            n += out.write(row["text"].encode())
    return n


def quality(health: Column, completeness: Column) -> Column:
    return (health + completeness) / 2


def alert(score: Column) -> Column:
    """Level of alert of a quality score."""
    return F.when(score >= 80, "none").when(score >= 60, "warning").when(score >= 40, "high").otherwise("critical")


REQUIRED = ("doc_id", "title", "parent", "breadcrumb", "doc_type", "status")


def scores(docs: DataFrame) -> DataFrame:
    """(path, health, completeness, quality, alert, healthy, complete): health by words of the body up to 300,
    completeness by the share of required fields."""
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in REQUIRED])
    health = F.least(T.words(Y.body(F.col("content"))), F.lit(300)) / 300 * 100
    d = docs.select("path", health.alias("health"), (present / len(REQUIRED) * 100).alias("completeness"))
    d = d.withColumn("quality", quality(F.col("health"), F.col("completeness")))
    return d.select("path", *[F.round(c, 6).alias(c) for c in ("health", "completeness", "quality")], alert(F.col("quality")).alias("alert"),
                    (F.col("health") > 80).alias("healthy"), (F.col("completeness") > 90).alias("complete"))


def at_least(issues: DataFrame, severity: str) -> DataFrame:
    """Issues of a severity or a worse one."""
    rank = Y.named(F.col("severity"), {k: str(v) for k, v in Y.SEVERITY_RANK.items()}).cast("int")
    return issues.where(rank >= Y.SEVERITY_RANK[severity])


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


#: Kind of repair by urgency, and which kinds need no asking.
REPAIRS = {"low": "trivial", "medium": "minor", "high": "major", "critical": "critical"}


def repair_summary(routed: DataFrame) -> DataFrame:
    """One row over `schema.routed`: repairs of each kind, and those that are safe to automate."""
    kinds = [F.count_if(F.col("urgency") == u).alias(kind) for u, kind in REPAIRS.items()]
    return routed.agg(*kinds, F.count_if("auto_safe").alias("auto"))

