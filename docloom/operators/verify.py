"""Integrity phases: each is a DataFrame of issues (phase, severity, path, detail) over the document table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import links as L
from docloom.functions import text as T

#: Required fields, known types and statuses, placeholders, diagram words.
REQUIRED = ("id", "title", "parent", "breadcrumb", "type", "status")
TYPES = (
    "hoja", "modulo_padre", "seccion", "contenedor", "indice", "indice_maestro", "especificacion", "documento", "padre", "integracion",
    "testing", "feature", "estrategia", "configuracion", "config", "perfil", "edge_case", "arquitectura", "seguridad", "plugin",
    "optimizacion", "infraestructura", "esquema", "ux", "referencia", "proceso", "planificacion", "logica", "legal", "vision", "reglas",
    "programa", "privacidad", "politica", "plantilla", "manejo_errores", "guia", "formulario", "flujo", "fallback", "componente",
    "automatizacion", "api", "analytics", "algoritmo", "admin", "accesibilidad",
)
STATUSES = ("activo", "aceptado", "preparado", "borrador", "pendiente", "futuro", "deprecado", "stub", "draft", "review", "approved")
PLACEHOLDERS = (
    "TBD", "TODO", "FIXME", "XXX", "PENDING", "[PENDIENTE]", "[TODO]", "[TBD]", "Lorem ipsum", "placeholder", "PLACEHOLDER",
    "Contenido pendiente", "Por definir",
)
DIAGRAMS = ("graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "pie", "gantt", "erDiagram")
UNCHECKED_FILE = "0. Contexualizador.md"
MIN_WORDS = 50


def _found(severity: str, detail: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def _none() -> Column:
    return F.array().cast("array<struct<severity:string,detail:string>>")


def _if(condition: Column, severity: str, detail: Column) -> Column:
    """What a phase finds in one document: an array of one finding, or of none."""
    return F.array_compact(F.array(F.when(condition, _found(severity, detail))))


def _local(docs: DataFrame, phases: list[int]) -> DataFrame:
    """Issues of phases that need nothing but the document: all in one pass over the table."""

    def numbered(i: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(i).alias("phase"), x["severity"].alias("severity"), x["detail"].alias("detail"))

    each = [F.transform(LOCAL[i](), numbered(i)) for i in phases]
    return docs.select("path", F.explode(F.concat(*each)).alias("x")).select("x.phase", "x.severity", "path", "x.detail")


def _phase(number: int) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: _local(docs, [number])


def _issues(df: DataFrame, phase: int, severity: str, detail: Column) -> DataFrame:
    return df.select(F.lit(phase).alias("phase"), F.lit(severity).alias("severity"), "path", detail.cast("string").alias("detail"))


def file_count(docs: DataFrame) -> DataFrame:
    none = docs.agg(F.count(F.lit(1)).alias("n")).where("n = 0").withColumn("path", F.lit(None).cast("string"))
    return _issues(none, 1, "error", F.lit("no files"))


def _shared(docs: DataFrame, phase: int, severity: str, key: Column) -> DataFrame:
    """Groups of files with one key, one issue each: the files' names in order, by the first."""
    groups = docs.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)
    detail = F.concat("key", F.lit(": "), F.array_join("paths", ", "))
    return _issues(groups.withColumn("path", F.get("paths", F.lit(0))), phase, severity, detail)


def unique_ids(docs: DataFrame) -> DataFrame:
    return _shared(docs, 3, "error", F.col("doc_id"))


def valid_parents(docs: DataFrame) -> DataFrame:
    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias("parent")).distinct()
    orphaned = docs.where("parent is not null and parent <> '0'").select("path", "parent").join(ids, "parent", "left_anti")
    return _issues(orphaned, 4, "error", F.col("parent"))


def wiki_targets(docs: DataFrame) -> DataFrame:
    """(path, link, name): wiki links that phase 9 looks at, with their anchors cut."""
    found = docs.select("path", F.explode(L.all_of(F.col("content"), L.WIKI_NAME)).alias("raw"))
    link = F.regexp_replace(T.trim(F.col("raw")), r"\\+$", "")
    seen = found.select("path", link.alias("link")).where((F.col("link") != "") & ~F.col("link").startswith("http") & ~F.col("link").startswith("#"))
    return seen.where(~F.contains("link", F.lit("Métrica")) & ~F.contains("link", F.lit("Valor"))).withColumn("name", F.substring_index("link", "#", 1))


def internal_links(docs: DataFrame) -> DataFrame:
    """Targets must be files, by their path from the corpus's root. Failing that, a stem that differs in case at most is an
    error, and anything else but mentions a warning."""
    files = docs.select(F.regexp_replace("path", r"\.md$", "").alias("name")).distinct()
    stems = docs.groupBy(F.lower("stem").alias("low")).agg(F.max("stem").alias("correct"))
    lost = wiki_targets(docs).join(files, "name", "left_anti").withColumn("low", F.lower("name")).join(stems, "low", "left")
    wrong = F.col("correct").isNotNull()
    lost = lost.where(wrong | ~(F.col("link").startswith("@") | F.contains("link", F.lit("_"))))
    detail = F.when(wrong, F.concat("link", F.lit(" -> "), "correct")).otherwise(F.col("link"))
    return lost.select(F.lit(9).alias("phase"), F.when(wrong, "error").otherwise("warning").alias("severity"), "path", detail.alias("detail"))


def embeds(docs: DataFrame) -> DataFrame:
    name = F.regexp_replace(T.trim(F.col("raw")), r"\\+$", "")
    holds = docs.where(F.contains("content", F.lit("![[")))
    found = holds.select("path", F.explode(L.all_of(F.col("content"), L.EMBED)).alias("raw")).select("path", name.alias("name")).where("name <> ''")
    files = docs.select(F.regexp_replace("path", r"\.md$", "").alias("name")).distinct()
    return _issues(found.join(files, "name", "left_anti"), 10, "warning", F.col("name"))


def images(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`files` (path) lists what is there besides the documents."""
    holds = docs.where(F.contains("content", F.lit("![")))
    found = holds.select("path", F.explode(L.all_of(F.col("content"), L.IMAGE, 2)).alias("image")).where(~F.col("image").startswith("http"))
    known = docs.select(F.col("path").alias("image"))
    known = known if files is None else known.union(files.select("path"))
    return _issues(found.join(known.distinct(), "image", "left_anti"), 11, "warning", F.col("image"))


def line_table(docs: DataFrame) -> DataFrame:
    """(path, line_no from 1, text)."""
    return docs.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")


def table_run() -> Column:
    """The same for rows of a table that follow each other, where all other lines are left out."""
    return F.col("line_no") - F.row_number().over(Window.partitionBy("path").orderBy("line_no"))


def tables(docs: DataFrame) -> DataFrame:
    """Runs of table lines without a separator; a run that reaches the end of the file is not reported."""
    text = T.trim(F.col("text"))
    separators = ("---", ":--", "--:", ":-:")
    held = docs.where(F.contains("content", F.lit("|")))
    sized = T.let(T.lines(F.col("content")), lambda x: F.transform(x, lambda t, i: F.struct(i.alias("i"), t.alias("text"), F.size(x).alias("lines"))))
    rows = held.select("path", F.explode(F.filter(sized, lambda x: F.contains(x["text"], F.lit("|")))).alias("x")).select("path", (F.col("x.i") + 1).alias("line_no"), "x.text", "x.lines")
    rows = rows.where(text.startswith("|") & text.endswith("|")).withColumn("sep", reduce(lambda a, b: a | b, [F.contains("text", F.lit(x)) for x in separators]))
    runs = rows.withColumn("run", table_run())
    ends = runs.groupBy("path", "run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.max("sep").alias("sep"), F.max("lines").alias("lines"))
    return _issues(ends.where(~F.col("sep") & (F.col("last") < F.col("lines"))), 14, "warning", F.col("first"))


def duplicate_titles(docs: DataFrame) -> DataFrame:
    return _shared(docs, 18, "warning", F.lower("title"))


def orphans(docs: DataFrame) -> DataFrame:
    """No parent but "0", and no link names the stem; a link with an anchor or a folder names another."""
    linked = docs.select(F.explode(L.all_of(F.col("content"), L.WIKI_NAME)).alias("raw")).select(F.lower("raw").alias("low")).distinct()
    alone = docs.where(~F.col("file_name").startswith("0.") & (F.col("parent").isNull() | F.col("parent").isin("0", "")))
    return _issues(alone.withColumn("low", F.lower("stem")).join(linked, "low", "left_anti"), 19, "warning", F.col("stem"))


def children_count(docs: DataFrame) -> DataFrame:
    actual = docs.where("doc_id is not null and parent is not null and parent <> '0'").groupBy(F.col("parent").alias("doc_id")).agg(F.count(F.lit(1)).alias("actual"))
    said = docs.where(F.col("children_count").rlike(r"^\d+$") & F.col("doc_id").isNotNull()).join(actual, "doc_id", "left")
    n = F.coalesce("actual", F.lit(0))
    return _issues(said.where(F.col("children_count").cast("long") != n), 20, "warning", F.concat("children_count", F.lit(" vs "), n.cast("string")))


def _yaml() -> Column:
    columns = dict(zip(REQUIRED, ("doc_id", "title", "parent", "breadcrumb", "doc_type", "status"), strict=True))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in columns.items()]))
    problem = (
        F.when(~F.col("has_fm"), "no frontmatter").when(~F.col("fm_closed"), "not closed")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    )
    return T.let(F.when(F.col("file_name") != UNCHECKED_FILE, problem), lambda p: _if(p.isNotNull(), "error", p))


def _dates(tolerance_minutes: int = 1440) -> Column:
    drift = F.floor(F.abs(F.unix_timestamp("mtime") - Y.parse_date(F.col("last_updated"))) / 60)
    return T.let(F.when(~F.col("file_name").startswith("0."), drift), lambda d: _if(d > tolerance_minutes, "warning", d))


def _fences() -> Column:
    return T.let(T.occurrences(F.col("content"), "```"), lambda n: _if(n % 2 != 0, "warning", n))


def _diagrams() -> Column:
    """Mermaid blocks that are not empty and name no diagram."""
    odd = lambda b: ~reduce(lambda x, y: x | y, [F.contains(b, F.lit(d)) for d in DIAGRAMS]) & (T.trim(b) != "")
    found = F.transform(F.filter(L.all_of(F.col("content"), L.MERMAID), odd), lambda _: _found("warning", F.lit("no diagram type")))
    return F.when(F.contains("content", F.lit("```mermaid")), found).otherwise(_none())


def _headings() -> Column:
    """Several H1; and the first jump of more than one level, fences or not."""
    marked = F.filter(T.lines(F.col("content")), lambda x: F.contains(x, F.lit("#")))
    heads = F.filter(F.transform(marked, T.trim), lambda x: x.startswith("#"))
    h1 = lambda h: F.size(F.filter(h, lambda x: x.startswith("# ")))
    levels = lambda h: F.transform(h, lambda x: F.length(F.regexp_extract(x, "^#+", 0)))

    def jump(v: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: F.get(v, i) > F.get(v, i - 1) + 1)
        name = lambda i: F.concat(F.lit("H"), F.get(v, i - 1).cast("string"), F.lit(" to H"), F.get(v, i).cast("string"))
        return T.let(F.get(places, F.lit(0)), lambda i: _if(i.isNotNull(), "warning", name(i)))

    several = lambda n: _if(n > 1, "warning", F.concat(n.cast("string"), F.lit(" H1")))
    return T.let(heads, lambda h: F.concat(T.let(h1(h), several), T.let(levels(h), jump)))


def _short(least: int = MIN_WORDS) -> Column:
    few = lambda b: F.when(~T.has_words(b, least), T.words(b))
    return T.let(Y.body(F.col("content")), lambda b: T.let(few(b), lambda n: _if(n.isNotNull(), "warning", n)))


def _placeholder() -> Column:
    first = F.coalesce(*[F.when(F.contains("content", F.lit(p)), F.lit(p)) for p in PLACEHOLDERS])
    return T.let(first, lambda p: _if(p.isNotNull(), "warning", p))


def _hash() -> Column:
    stored = F.trim(F.col("content_hash"))
    return F.when(stored.isNotNull(), _if(stored != T.stable_hash(F.col("content")), "warning", F.col("content_hash"))).otherwise(_none())


#: Phases over single documents.
LOCAL: dict[int, Callable[[], Column]] = {
    2: _yaml, 5: lambda: _if(~F.contains("breadcrumb", "doc_id"), "warning", F.col("breadcrumb")), 6: lambda: _if(~F.lower("doc_type").isin(*TYPES), "warning", F.col("doc_type")),
    7: lambda: _if(~F.lower("status").isin(*STATUSES), "warning", F.col("status")), 8: _dates, 12: _fences, 13: _diagrams, 15: _headings, 16: _short, 17: _placeholder, 21: _hash,
}
hash_integrity = _phase(21)


PHASES: dict[int, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    1: ("file_count", file_count), 2: ("yaml_validation", _phase(2)), 3: ("unique_ids", unique_ids), 4: ("valid_parents", valid_parents),
    5: ("breadcrumbs", _phase(5)), 6: ("types", _phase(6)), 7: ("status", _phase(7)), 8: ("dates_sync", _phase(8)), 9: ("internal_links", internal_links),
    10: ("embeds", embeds), 11: ("images", images), 12: ("code_blocks", _phase(12)), 13: ("mermaid", _phase(13)), 14: ("tables", tables),
    15: ("headings", _phase(15)), 16: ("min_content", _phase(16)), 17: ("placeholders", _phase(17)), 18: ("duplicates", duplicate_titles),
    19: ("orphans", orphans), 20: ("children_count", children_count), 21: ("hash_integrity", _phase(21)),
}
#: Other names of phases (fixed values).
ALIASES = {
    "files": 1, "yaml": 2, "ids": 3, "parents": 4, "breadcrumb": 5, "type": 6, "dates": 8, "links": 9, "code": 12, "content": 16, "children": 20, "hash": 21,
}
SLOW = (16, 17, 19)


def phase_number(name: str) -> int | None:
    """A phase by number or name; None if there is none."""
    if name.isdigit():
        return int(name) if int(name) in PHASES else None
    known = {n: i for i, (n, _) in PHASES.items()} | ALIASES
    return known.get(name.lower())


def verify(docs: DataFrame, phases: list[int] | None = None, quick: bool = False) -> DataFrame:
    """Issues of the chosen phases; `quick` leaves the slow ones out."""
    chosen = [i for i in (phases or PHASES) if not (quick and i in SLOW)]
    local = [i for i in chosen if i in LOCAL]
    parts = [PHASES[i][1](docs) for i in chosen if i not in LOCAL] + ([_local(docs, local)] if local else [])
    return reduce(DataFrame.unionByName, parts)


def summary(docs: DataFrame, quick: bool = False) -> DataFrame:
    """One row per phase: errors, warnings, and whether it passed."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, n) for i, (n, _) in PHASES.items() if not (quick and i in SLOW)], "phase int, name string")
    found = verify(docs, quick=quick).groupBy("phase").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    joined = names.join(F.broadcast(found), "phase", "left")  # one row per phase
    errors = F.coalesce("e", F.lit(0)).cast("long")
    return joined.select("phase", "name", errors.alias("errors"), F.coalesce("w", F.lit(0)).cast("long").alias("warnings"), (errors == 0).alias("passed"))
