"""Document-id functions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(x: Column) -> Column:
    """Numbers of a dotted id, or null if one of them is no number."""
    found = F.transform(F.split(x, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), p.try_cast("int")))
    return F.when(~F.exists(found, lambda p: p.isNull()), found)


def depth(x: Column) -> Column:
    return F.size(parts(x))


def module(x: Column) -> Column:
    return F.get(parts(x), F.lit(0))


def parent(x: Column) -> Column:
    """The id without its last part; null at the root."""
    return F.when(x.contains("."), F.regexp_replace(x, r"\.[^.]*$", ""))


def ancestors(x: Column) -> Column:
    """Prefixes of the id from the module down, without the id."""
    names = F.split(x, r"\.")
    n = F.size(names)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(names, F.lit(1), i), "."))
    )


def numeric_prefix(stem: Column) -> Column:
    """Leading dotted number of a name, or null."""
    return F.nullif(F.regexp_extract(stem, r"^(\d+(?:\.\d+)*)", 1), F.lit(""))


def dots(x: Column) -> Column:
    """Depth by the dots among the leading digits and dots."""
    lead = F.regexp_extract(x, r"^[0-9.]*", 0)
    return (F.length(lead) - F.length(F.replace(lead, F.lit("."), F.lit("")))).cast("long")


def relative_depth(x: Column, root: str | None) -> Column:
    """`dots` below those of a root, never below zero."""
    return dots(x) if root is None else F.greatest(dots(x) - dots(F.lit(root)), F.lit(0).cast("long"))


def breadcrumb(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ">"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
