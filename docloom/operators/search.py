"""Full-text search over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def search(lines: DataFrame, query: str, ignore_case: bool = False, regex: bool = False, most: int | None = None, key: str = "path") -> DataFrame:
    """(key, line_no, text, start, length): the first match of each line, `start` in bytes. `regex` is an extension."""
    text, what = (F.lower("text"), query.lower()) if ignore_case else (F.col("text"), query)
    if regex:
        found = F.regexp_extract("text", ("(?i)" if ignore_case else "") + query, 0)
        hits = lines.where(F.col("text").rlike(("(?i)" if ignore_case else "") + query)).withColumn("_m", found)
        out = hits.select(key, "line_no", "text", T.byte_offset(F.col("text"), F.col("_m")).alias("start"), F.octet_length("_m").cast("long").alias("length"))
    else:
        hits = lines.where(F.contains(text, F.lit(what)))
        out = hits.select(key, "line_no", "text", T.byte_offset(text, F.lit(what)).alias("start"), F.lit(len(what.encode())).cast("long").alias("length"))
    return out if most is None else out.orderBy(key, "line_no").limit(most)


def totals(lines: DataFrame, hits: DataFrame, key: str = "path") -> DataFrame:
    """One row: matches, files with matches, files and lines searched."""
    a = hits.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct(key).alias("files_with_matches"))
    return a.crossJoin(lines.agg(F.count_distinct(key).alias("files"), F.count(F.lit(1)).alias("lines")))  # one row each


def fuzzy(df: DataFrame, column: str, query: str, distance: int = 2) -> DataFrame:
    """Rows whose column is within an edit distance of the query (an extension)."""
    return df.withColumn("distance", F.levenshtein(F.col(column), F.lit(query), distance)).where("distance >= 0")


def context(lines: DataFrame, query: str, around: int = 1, key: str = "path") -> DataFrame:
    """Matching lines with the lines around them (an extension)."""
    near = F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("line_no")
    wanted = lines.where(F.contains("text", F.lit(query))).select(key, near).distinct()
    return lines.join(wanted, [key, "line_no"], "left_semi")


def scored(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows that contain the query, case ignored: 100 for equality, 50 otherwise."""
    low = F.lower(column)
    return df.where(F.contains(low, F.lit(query.lower()))).withColumn("score", F.when(low == query.lower(), 100).otherwise(50))


def excerpt(text: Column, query: str, around: int = 20) -> Column:
    """Text around the first match."""
    at = F.call_function("instr", text, F.lit(query))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(query) + around))
