"""Lint rules: each is a DataFrame of issues (code, severity, path, line, fixable, detail) over the document table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import ids as I
from docloom.functions import links as L
from docloom.functions import text as T
from docloom.operators.verify import line_table, table_run

MAX_LINE_BYTES = 800
#: A link that spells out the project's folder; the folder's name is the corpus's own.
ABSOLUTE_LINK = r"\[\[Proyecto[^\]]*/Datos/([^\]]+)\]\]"


def _issues(df: DataFrame, code: str, severity: str, fixable: bool, line: Column | None = None, detail: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), "path", (F.lit(None) if line is None else line).cast("long").alias("line"),
        F.lit(fixable).alias("fixable"), (F.lit("") if detail is None else detail).cast("string").alias("detail"),
    )


def fenced_lines(docs: DataFrame, only: Column | None = None) -> DataFrame:
    """Lines with `fence` (the line opens or closes a block) and `inside` (it lies in one); `only` chooses lines, and what is
    neither chosen nor a fence isn't sorted, nor are documents without a fence's characters."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = (F.contains("text", F.lit("```")) | F.contains("text", F.lit("~~~"))) & F.col("text").rlike(T.FENCE)
    could = F.contains("content", F.lit("```")) | F.contains("content", F.lit("~~~"))
    chosen = F.lit(True) if only is None else only
    seen = line_table(docs.where(could)).where(chosen | fence).withColumn("fence", fence).withColumn("n", F.sum(F.col("fence").cast("int")).over(w))
    plain = line_table(docs.where(~could)).where(chosen).withColumn("fence", F.lit(False)).withColumn("n", F.lit(0).cast("long"))
    return seen.unionByName(plain).withColumn("inside", ~F.col("fence") & (F.col("n") % 2 == 1))


def prose(docs: DataFrame, only: Column | None = None) -> DataFrame:
    return fenced_lines(docs, only).where(~F.col("fence") & ~F.col("inside"))


def frontmatter(docs: DataFrame) -> DataFrame:
    return _issues(docs.where(~F.col("has_fm") & ~F.contains("path", F.lit("_summaries/"))), "L001", "warning", False, F.lit(1))


def header_hierarchy(docs: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line_no")
    heads = prose(docs, F.col("text").startswith("#")).withColumn("level", F.length(F.regexp_extract("text", "^#+", 0)))
    jumps = heads.withColumn("last", F.lag("level").over(w)).where("level > last + 1")
    return _issues(jumps, "L002", "warning", False, F.col("line_no"), F.concat(F.lit("H"), "last", F.lit(" to H"), "level"))


def _blank_end() -> Column:
    return F.substring("text", -2, 2).rlike("[ \t]$")


def trailing_whitespace(docs: DataFrame) -> DataFrame:
    return _issues(line_table(docs).where(_blank_end()), "L003", "info", True, F.col("line_no"))


def final_newline(docs: DataFrame) -> DataFrame:
    return _issues(docs.where(~F.col("content").endswith("\n")), "L004", "info", True)


def _length_counts() -> Column:
    return ~F.contains("path", F.lit("/_")) & ~F.col("path").startswith("_")


def line_length(docs: DataFrame, most: int = MAX_LINE_BYTES) -> DataFrame:
    long = line_table(docs.where(_length_counts())).withColumn("n", F.octet_length("text")).where(F.col("n") > most)
    return _issues(long, "L005", "warning", False, F.col("line_no"), F.col("n"))


def code_language(docs: DataFrame) -> DataFrame:
    """Opening fences that name no language, unless the block looks like a documentation sample: two of headings, table
    rows, inner blocks and rules among the next 49 lines, up to the closing fence."""
    order = Window.partitionBy("path").orderBy("line_no")
    trimmed = line_table(docs.where(F.contains("content", F.lit("```")))).withColumn("text", T.trim(F.col("text")))
    ticks = trimmed.withColumn("fence", F.col("text").startswith("```"))
    ticks = ticks.withColumn("n", F.sum(F.col("fence").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ticks = ticks.withColumn("ahead", F.collect_list("text").over(order.rowsBetween(1, 49)))
    opened = ticks.where(F.col("fence") & (F.col("n") % 2 == 1) & (F.regexp_replace("text", "^`+", "") == ""))
    close = F.array_position("ahead", "```")
    block = F.when(close > 0, F.slice("ahead", F.lit(1), (close - 1).cast("int"))).otherwise(F.col("ahead"))
    has = lambda test: F.exists("block", test).cast("int")
    signs = (
        has(lambda x: x.startswith("##")) + has(lambda x: x.startswith("|") & x.endswith("|"))
        + has(lambda x: x.startswith("```") & (F.length(x) > 3)) + has(lambda x: x == "---")
    )
    return _issues(opened.withColumn("block", block).where(signs < 2), "L006", "hint", False, F.col("line_no"))


def duplicate_headers(docs: DataFrame) -> DataFrame:
    rest = F.regexp_replace("text", "^#+", "")
    heads = prose(docs, F.col("text").startswith("#")).where(rest.startswith(" ")).withColumn("head", F.lower(T.trim(rest)))
    heads = heads.where((F.col("head") != "") & ~F.col("head").startswith("!"))
    first = heads.withColumn("first", F.min("line_no").over(Window.partitionBy("path", "head"))).where("line_no > first")
    return _issues(first, "L007", "warning", False, F.col("line_no"), F.col("first"))


def required_fields(docs: DataFrame) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(~F.contains("content", F.lit(f"{x}:")), F.lit(x)) for x in ("id", "title")]))
    return _issues(docs.where("has_fm").select("path", F.explode(missing).alias("x")), "L008", "error", False, detail=F.col("x"))


def _table_rows(docs: DataFrame) -> DataFrame:
    """Lines with their table run: `row`, `sep`, and `run`, which differs between runs that other lines part."""
    order = Window.partitionBy("path").orderBy("line_no")
    text = T.trim(F.col("text"))
    row, sep = text.rlike(L.TABLE_ROW), text.rlike(L.TABLE_SEPARATOR)
    marked = fenced_lines(docs.where(F.contains("content", F.lit("|"))), F.contains("text", F.lit("|")) & (row | sep)).withColumn("row", row & ~F.col("fence")).withColumn("sep", sep)
    follows = F.lead(F.when(F.col("sep"), F.col("line_no"))).over(order) == F.col("line_no") + 1
    marked = marked.withColumn("next_sep", F.coalesce(follows, F.lit(False))).where("row")
    return marked.withColumn("run", table_run()).where("not inside")


def table_headers(docs: DataFrame) -> DataFrame:
    rows = _table_rows(docs).withColumn("first", F.min("line_no").over(Window.partitionBy("path", "run")))
    return _issues(rows.where("line_no = first and not next_sep"), "L009", "warning", False, F.col("line_no"))


def _no_alt() -> Column:
    return F.contains("text", F.lit("![](")) & F.col("text").rlike(L.IMAGE_NO_ALT)


def image_alt(docs: DataFrame) -> DataFrame:
    return _issues(line_table(docs).where(_no_alt()), "L010", "warning", False, F.col("line_no"))


def double_separator(docs: DataFrame) -> DataFrame:
    """Separators after the first in a table, which starts at its first row that is none."""
    w = Window.partitionBy("path", "run").orderBy("line_no")
    rows = _table_rows(docs).withColumn("started", F.max((~F.col("sep")).cast("int")).over(w)).where("started = 1 and sep")
    numbered = rows.withColumn("i", F.row_number().over(w)).withColumn("first", F.min("line_no").over(Window.partitionBy("path", "run")))
    return _issues(numbered.where("i > 1"), "L011", "error", True, F.col("line_no"), F.col("first"))


def unescaped_pipe(docs: DataFrame) -> DataFrame:
    could = F.contains("text", F.lit("[[")) & F.contains("text", F.lit("|"))
    found = line_table(docs.where(F.contains("content", F.lit("[[")))).where(could & T.trim(F.col("text")).startswith("|"))
    found = found.withColumn("link", F.explode(L.all_of(F.col("text"), L.UNESCAPED_PIPE, 0))).where(~F.contains("link", F.lit("\\|")))
    return _issues(found, "L012", "error", True, F.col("line_no"), F.col("link"))


def descendants(docs: DataFrame) -> DataFrame:
    """(id, n): files of the root folder whose dotted number goes on below the id. Each name is exploded to its number's
    prefixes, so the count is an aggregation and no pairwise comparison."""
    names = docs.where(~F.contains("path", F.lit("/"))).select(F.regexp_extract("file_name", r"^(\d+(?:\.\d+)*)", 1).alias("number")).where("number <> ''")
    return names.select(F.explode(I.ancestors(F.col("number"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def table_counts(docs: DataFrame) -> DataFrame:
    """(path, line_no, id, claimed): data rows of tables with a Nietos column."""
    rows = line_table(docs.where(F.contains("content", F.lit("Nietos"))))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("text").rlike(r"\|\s*Nietos\s*\|")
    cells = F.split(F.replace("text", F.lit("\\|"), F.lit("\u0001")), r"\|")
    at = F.array_position(F.transform(cells, lambda c: F.contains(c, F.lit("Nietos"))), True)
    head = F.when(is_head, F.struct(F.col("line_no").alias("line"), at.alias("col")))
    marked = rows.withColumn("head", F.last(head, ignorenulls=True).over(w))
    barrier = F.max(F.when(~T.trim(F.col("text")).startswith("|"), F.col("line_no"))).over(w)
    data = marked.withColumn("barrier", F.coalesce(barrier, F.lit(0))).where((F.col("line_no") >= F.col("head.line") + 2) & (F.col("barrier") < F.col("head.line")))
    data = data.withColumn("cells", cells).where(F.size("cells") >= F.col("head.col"))
    link = F.regexp_extract(F.get("cells", F.lit(1)), r"\[\[([^\]\|]+)", 1)
    name = F.regexp_replace(F.substring_index(F.substring_index(link, "\u0001", 1), " ", 1), r"\.+$", "")
    claimed = F.trim(F.get("cells", (F.col("head.col") - 1).cast("int")))
    return data.where(link != "").select("path", "line_no", name.alias("id"), F.coalesce(F.when(claimed.rlike(r"^\d+$"), claimed.cast("long")), F.lit(0)).alias("claimed"))


def count_mismatch(docs: DataFrame) -> DataFrame:
    wrong = table_counts(docs).join(descendants(docs), "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> claimed")
    return _issues(wrong, "L013", "warning", True, F.col("line_no"), F.concat("id", F.lit(": "), "claimed", F.lit(" vs "), "n"))


def absolute_link(docs: DataFrame, pattern: str = ABSOLUTE_LINK) -> DataFrame:
    found = line_table(docs.where(F.contains("content", F.lit("[[")))).where(F.col("text").rlike(pattern)).withColumn("link", F.explode(L.all_of(F.col("text"), pattern, 0)))
    return _issues(found, "L014", "info", False, F.col("line_no"), F.substring("link", 1, 50))


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "L001": frontmatter, "L002": header_hierarchy, "L003": trailing_whitespace, "L004": final_newline, "L005": line_length,
    "L006": code_language, "L007": duplicate_headers, "L008": required_fields, "L009": table_headers, "L010": image_alt,
    "L011": double_separator, "L012": unescaped_pipe, "L013": count_mismatch, "L014": absolute_link,
}
DOCS = {
    "L001": "A document starts with frontmatter.", "L002": "Heading levels grow one at a time.", "L003": "Lines don't end in blanks.",
    "L004": "A file ends with a line end.", "L005": "Lines stay under the limit.", "L006": "Code blocks name their language.",
    "L007": "Headings of a file differ.", "L008": "Frontmatter has id and title.", "L009": "A table's first row is followed by a separator.",
    "L010": "Images have alternative text.", "L011": "A table has one separator.", "L012": "Pipes of links in tables are escaped.",
    "L013": "Counts in tables match the files.", "L014": "Links don't spell out the project's folder.",
}


#: Rules over single lines, each as in its own function: what fits, severity, whether it can be fixed, detail.
LOCAL: dict[str, tuple[Callable[[], Column], str, bool, Callable[[], Column]]] = {
    "L003": (_blank_end, "info", True, lambda: F.lit("")),
    "L005": (lambda: _length_counts() & (F.octet_length("text") > MAX_LINE_BYTES), "warning", False, lambda: F.octet_length("text").cast("string")),
    "L010": (_no_alt, "warning", False, lambda: F.lit("")),
}


def _local(docs: DataFrame, rules: list[str]) -> DataFrame:
    """Issues of rules over single lines: all in one pass over the lines."""
    fits = {r: LOCAL[r][0]() for r in rules}
    issue = lambda r: F.struct(F.lit(r).alias("code"), F.lit(LOCAL[r][1]).alias("severity"), F.lit(LOCAL[r][2]).alias("fixable"), LOCAL[r][3]().alias("detail"))
    found = line_table(docs).where(reduce(lambda a, b: a | b, fits.values()))
    each = F.array_compact(F.array(*[F.when(fits[r], issue(r)) for r in rules]))
    return found.select("path", F.col("line_no").cast("long").alias("line"), F.explode(each).alias("x")).select("x.code", "x.severity", "path", "line", "x.fixable", "x.detail")


def lint(docs: DataFrame, rules: list[str] | None = None) -> DataFrame:
    chosen = list(rules or RULES)
    local = [r for r in dict.fromkeys(chosen) if r in LOCAL] if len(set(chosen)) == len(chosen) else []
    parts = [RULES[r](docs) for r in chosen if r not in local] + ([_local(docs, local)] if local else [])
    return reduce(DataFrame.unionByName, parts)


def explain(spark, code: str | None = None) -> DataFrame:
    return spark.createDataFrame([(c, d) for c, d in DOCS.items() if code in (None, c)], "code string, text string")


def summary(docs: DataFrame) -> DataFrame:
    """One row: issues by severity, fixable ones, files that have any."""
    by = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}s")
    return lint(docs).agg(by("error"), by("warning"), by("info"), by("hint"), F.count_if("fixable").alias("fixable"), F.count_distinct("path").alias("files"))


def fix(content: Column) -> Column:
    """Blanks at line ends gone, blank lines at the end gone, one final line end."""
    stripped = F.array_join(F.transform(T.lines(content), T.trim_end), "\n")
    return F.concat(F.regexp_replace(stripped, r"\n+\z", ""), F.lit("\n"))
