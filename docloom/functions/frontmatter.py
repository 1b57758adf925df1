"""Frontmatter functions over Columns: borders, fields, bodies, edits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Patterns of single fields, first match anywhere in the file (fixed values).
FIELD_PATTERNS = {
    "document_id": r"document_id:\s*[\"']?([^\"'\n]+)[\"']?",
    "parent_id": r"parent_id:\s*[\"']?([^\"'\s\n]+)[\"']?",
    "module": r"module:\s*[\"']?([^\"'\n]+)[\"']?",
    "title": r"title:\s*[\"']?([^\"'\n]+)[\"']?",
    "status": r"status:\s*[\"']?([^\"'\n]+)[\"']?",
    "last_updated": r"last_updated:\s*[\"']?([^\"'\n]+)[\"']?",
    "content_hash": r"content_hash:\s*[\"']?([^\"'\n]+)[\"']?",
    "children_count": r"children_count:\s*(\d+)",
    "total_children": r"total_children:\s*(\d+)",
    "type": r"type:\s*[\"']?([^\"'\n]+)[\"']?",
}


def has_frontmatter(content: Column) -> Column:
    return content.startswith("---")


def closing_offset(content: Column) -> Column:
    """Characters between the opening and the next '---', wherever it stands; null if there is none."""
    at = F.call_function("instr", F.substring(content, F.lit(4), F.length(content)), F.lit("---"))
    return F.when(has_frontmatter(content) & (at > 0), at - 1)


def yaml_text(content: Column) -> Column:
    return F.substring(content, F.lit(4), closing_offset(content))


def body(content: Column) -> Column:
    """What follows the second '---'; the whole content if there is none."""
    n = closing_offset(content)
    return F.when(n.isNull(), content).otherwise(F.substring(content, n + 7, F.length(content)))


def body_after_line(content: Column) -> Column:
    """The variant for body hashes: the closing mark starts a line, and the rest is trimmed."""
    at = F.call_function("instr", F.substring(content, F.lit(4), F.length(content)), F.lit("\n---"))
    rest = F.substring(content, at + 7, F.length(content))
    return F.when(has_frontmatter(content) & (at > 0) & (F.length(rest) > 0), T.trim(rest)).otherwise(content)


def field(yaml: Column, name: str) -> Column:
    """Value of the first line `name: value` with a value that is not empty once blanks and quotes are gone."""
    pattern = rf"(?m)^\h*{re.escape(name)}:\h*+[\"']*+(.+?)[\"']*\h*$"
    return F.nullif(F.regexp_extract(yaml, pattern, 1), F.lit(""))


def first_field(content: Column, name: str) -> Column:
    """Value of the field's pattern, first match anywhere in the file, trimmed; null without one."""
    return F.when(content.rlike(FIELD_PATTERNS[name]), T.trim(F.regexp_extract(content, FIELD_PATTERNS[name], 1)))


def is_draft(content: Column) -> Column:
    return content.rlike(r"draft:\s*true")


def count_prose_words(content: Column) -> Column:
    """Words outside ``` fences, with the marks # * _ and backticks taken for blanks."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, line: Column) -> Column:
        fence = T.trim(line).startswith("```")
        n = a["n"] + F.when(fence | a["inside"], F.lit(0).cast("long")).otherwise(T.words(F.translate(line, "#*_`", "    ")))
        return F.struct((a["inside"] != fence).alias("inside"), n.alias("n"))

    return F.aggregate(T.lines(content), start, step, lambda a: a["n"])


def update_field(content: Column, name: str, value: Column) -> Column:
    """The first `name:` to the end of its line replaced; unchanged without one."""
    return T.replace_first(content, rf"{re.escape(name)}:[^\n]*", F.concat(F.lit(f"{name}: "), value))


def add_field(content: Column, name: str, value: Column) -> Column:
    """A line before the closing '---', unless there is no closed frontmatter."""
    n = closing_offset(content)
    added = F.concat(F.substring(content, F.lit(1), n + 3), F.lit(f"{name}: "), value, F.lit("\n"), F.substring(content, n + 4, F.length(content)))
    return F.when(n.isNull(), content).otherwise(added)


def add_first_field(content: Column, name: str, value: Column) -> Column:
    """A line after the first '---' line, unless the field is there already."""
    at = F.call_function("instr", content, F.lit("---\n"))
    added = F.concat(F.substring(content, F.lit(1), at + 3), F.lit(f"{name}: "), value, F.lit("\n"), F.substring(content, at + 4, F.length(content)))
    return F.when((at == 0) | content.contains(f"{name}:"), content).otherwise(added)


def remove_field(content: Column, name: str) -> Column:
    return F.regexp_replace(content, rf"(?m)^{re.escape(name)}:\s*.*\n?", "")


def parse_date(x: Column) -> Column:
    """Seconds since 1970 of RFC 3339, 'Y-m-d H:M:S' or 'Y-m-d', in the session's time zone; null otherwise."""
    stamps = [F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")]
    return F.unix_timestamp(F.coalesce(*stamps))


#: Names of statuses and document types as written, to the name that is meant (fixed values).
STATUS_NAMES = {
    "active": "active", "activo": "active", "draft": "draft", "borrador": "draft", "deprecated": "deprecated", "deprecado": "deprecated",
    "archived": "archived", "archivado": "archived", "reviewed": "reviewed", "revisado": "reviewed",
}
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1, "hint": 0}


def named(x: Column, names: dict) -> Column:
    """names[lower(x)], or null."""
    pairs = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.try_element_at(pairs, F.lower(x))


def build(fields: dict[str, Column]) -> Column:
    """Frontmatter of fields in their order; a null field has no line, an array is written in brackets."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\n"))
    return F.concat(F.lit("---\n"), *[F.coalesce(line(n, v), F.lit("")) for n, v in fields.items()], F.lit("---\n"))


def bracketed(items: Column) -> Column:
    """An array as a YAML flow sequence."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


#: Fields of the typed frontmatter (fixed values).
TEXTS = ("id", "title", "parent", "breadcrumb", "status", "created", "last_updated", "author", "domain", "priority", "description", "content_hash", "version")
LISTS = ("actors", "tags", "references")
NUMBERS = ("children_count", "descendants_count")


def _raw(yaml: Column, name: str) -> Column:
    return F.regexp_extract(yaml, rf"(?m)^(?:{name}):[ \t]*(.*?)[ \t\r]*$", 1)


def _bare(raw: Column) -> Column:
    """A scalar without its quotes or comment; null for an empty one or null."""
    quoted = raw.rlike(r"^([\"']).*\1")
    plain = F.regexp_replace(raw, r"(^|[ \t]+)#.*$", "")
    return F.when(quoted, F.regexp_extract(raw, r"^([\"'])(.*?)\1", 2)).otherwise(F.when(~F.lower(plain).isin("", "~", "null"), plain))


def _list(yaml: Column, name: str) -> Column:
    """Items in brackets, or on lines with a dash; null without the field."""
    raw = _raw(yaml, name)
    inner = F.split(F.regexp_extract(raw, r"^\[(.*)\]", 1), ",")
    block = F.split(F.regexp_extract(yaml, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*- .*(?:\n|\z))+)", 1), "\n")
    dashed = F.transform(F.filter(block, lambda x: x.rlike("^[ \t]*- ")), lambda x: F.regexp_extract(x, r"^[ \t]*- [ \t]*(.*)$", 1))
    items = F.when(raw.startswith("["), inner).when(F.size(dashed) > 0, dashed)
    return F.filter(F.transform(items, lambda x: _bare(F.trim(x))), lambda x: x.isNotNull())


def typed(yaml: Column) -> Column:
    """The frontmatter as a struct: texts, lists, numbers, and `parse_error`, null where it can be read. Fields are those at
    the start of a line; id and title must be there, a field may stand once, numbers must be whole."""
    known = "|".join((*TEXTS, *LISTS, *NUMBERS, "doc_type", "type"))
    seen = F.transform(F.regexp_extract_all(yaml, F.lit(rf"(?m)^({known}):"), F.lit(1)), lambda k: F.when(k == "type", "doc_type").otherwise(k))
    bad = reduce(lambda a, b: a | b, [_raw(yaml, n).rlike(r"\S") & _bare(_raw(yaml, n)).isNotNull() & ~F.coalesce(_bare(_raw(yaml, n)).rlike(r"^\+?\d+$"), F.lit(False)) for n in NUMBERS])
    error = (
        F.when(yaml.isNull(), "missing frontmatter").when(F.size(F.array_distinct(seen)) < F.size(seen), "duplicate field")
        .when(_bare(_raw(yaml, "id")).isNull(), "missing field: id").when(_bare(_raw(yaml, "title")).isNull(), "missing field: title").when(bad, "no number")
    )
    texts = [_bare(_raw(yaml, n)).alias(n) for n in TEXTS] + [_bare(_raw(yaml, "doc_type|type")).alias("doc_type")]
    numbers = [_bare(_raw(yaml, n)).try_cast("long").alias(n) for n in NUMBERS]
    return F.struct(*texts, *[_list(yaml, n).alias(n) for n in LISTS], *numbers, error.alias("parse_error"))
