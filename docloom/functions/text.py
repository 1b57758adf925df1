"""Text functions over Columns: lines, words, trimming, byte lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A code fence opens or closes on a line that starts with one of these, after blanks.
FENCE = r"(?U)^\s*(```|~~~)"


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(content: Column) -> Column:
    """Lines without their ends; a final line end starts no further line."""
    parts = F.split(content, "\n")
    bare = F.when(F.contains(content, F.lit("\r")), F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(parts)
    return let(bare, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def words(content: Column) -> Column:
    """Number of words between Unicode white space."""
    return F.size(F.filter(F.split(content, r"(?U)\s+"), lambda w: w != "")).cast("long")


def has_words(content: Column, n: int) -> Column:
    """Whether there are n words (n >= 1) or more; the text is read no further than they are."""
    return content.rlike(rf"(?U)\A\s*+(?:\S++\s++){{{n - 1}}}\S")


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def trim_end(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def occurrences(x: Column, part: str) -> Column:
    """How often `part` occurs, not overlapping."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("long")


def byte_offset(x: Column, part: Column) -> Column:
    """Bytes before the first `part`, or null."""
    at = F.call_function("instr", x, part)
    return F.when(at > 0, F.octet_length(F.substring(x, F.lit(1), at - 1)).cast("long"))


def sha16(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


#: Lines that change without the document changing (fixed values).
VOLATILE = ("last_updated:", "content_hash:", "file_create:")


def stable_hash(content: Column, trimmed: bool = False) -> Column:
    """First 16 hex digits of the SHA-256 of the lines but the volatile ones; `trimmed` ignores their indentation."""
    test = lambda x: trim(x) if trimmed else x
    kept = F.filter(lines(content), lambda x: ~(test(x).startswith(VOLATILE[0]) | test(x).startswith(VOLATILE[1]) | test(x).startswith(VOLATILE[2])))
    return sha16(F.array_join(kept, "\n"))


def multi_hash(parts: Column) -> Column:
    """SHA-256 of an array of contents, each followed by a zero byte."""
    return F.sha2(F.concat(F.array_join(parts, "\x00"), F.lit("\x00")), 256)


def similarity(a: Column, b: Column) -> Column:
    """Characters of a that occur in b, over the longer byte length; 1 for two empty strings."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    common = F.size(F.filter(F.filter(F.split(a, ""), lambda c: c != ""), lambda c: F.contains(b, c)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(common / longest)


def word_count_label(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fK", n / 1000)).otherwise(n.cast("string"))


def file_size_label(n: Column) -> Column:
    kib, mib, gib = 1 << 10, 1 << 20, 1 << 30
    return (
        F.when(n >= gib, F.format_string("%.2f GB", n / gib)).when(n >= mib, F.format_string("%.2f MB", n / mib))
        .when(n >= kib, F.format_string("%.2f KB", n / kib)).otherwise(F.format_string("%d B", n))
    )


def age_label(seconds: Column) -> Column:
    unit = lambda n, s: F.format_string("%d" + s, F.floor(seconds / n).cast("long"))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def sparkline_level(value: Column, most: Column) -> Column:
    """Bar height 0 to 7."""
    return F.when(most > 0, F.round(value / most * 7)).otherwise(0).cast("int")


def slug(x: Column) -> Column:
    return F.lower(F.translate(x, ". ", "--"))


def escape_markdown(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\`*_\[\]|])", r"\\$1")


def node_id(x: Column) -> Column:
    """A Mermaid-safe identifier."""
    return F.regexp_replace(x, r"[^A-Za-z0-9]", "_")


def replace_first(content: Column, pattern: str, new: Column) -> Column:
    """The first match of `pattern` (no groups) replaced by the literal `new`."""
    found = F.regexp_extract(content, pattern, 0)
    at = F.call_function("instr", content, found)
    return F.when(found == "", content).otherwise(
        F.concat(F.substring(content, F.lit(1), at - 1), new, F.substring(content, at + F.length(found), F.length(content)))
    )
