"""Comparison of two corpora and of two texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def corpora(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_name, change, old_lines, new_lines): files by name, added, deleted, or modified where both stand in the root
    folder and differ. One full outer join."""
    cut = lambda d, p: d.groupBy("file_name").agg(F.max_by("content", "path").alias(f"{p}_content"), F.max("path").alias(f"{p}_path"))
    both = cut(old, "old").join(cut(new, "new"), "file_name", "full_outer")
    root = ~F.contains("old_path", F.lit("/")) & ~F.contains("new_path", F.lit("/"))
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").when(root & (F.col("old_content") != F.col("new_content")), "modified")
    n = lambda c: F.size(T.lines(F.col(c))).cast("long")
    out = both.withColumn("change", change).where("change is not null")
    return out.select("file_name", "change", F.when(F.col("old_content").isNotNull(), n("old_content")).alias("old_lines"), F.when(F.col("new_content").isNotNull(), n("new_content")).alias("new_lines"))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def line_changes(a: Column, b: Column) -> Column:
    """Struct (added, removed, modified, similarity) of two texts' lines; repeated lines count each."""
    x, y = T.lines(a), T.lines(b)
    added = F.size(F.filter(y, lambda l: ~F.array_contains(x, l)))
    removed = F.size(F.filter(x, lambda l: ~F.array_contains(y, l)))
    most = F.greatest(F.size(x), F.size(y))
    alike = F.when(most == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), (most - (added + removed) / 2) / most * 100))
    return F.struct(added.cast("long").alias("added"), removed.cast("long").alias("removed"), F.least(added, removed).cast("long").alias("modified"), F.round(alike, 6).alias("similarity"))


def side_by_side(a: DataFrame, b: DataFrame, width: int = 40) -> DataFrame:
    """(line_no, mark, row): lines (line_no, text) of both texts next to each other."""
    joined = a.select("line_no", F.col("text").alias("l")).join(b.select("line_no", F.col("text").alias("r")), "line_no", "full_outer")
    mark = F.when(F.col("l").isNull(), "+").when(F.col("r").isNull(), "-").when(F.col("l") != F.col("r"), "~").otherwise(" ")
    row = F.concat(F.rpad(F.coalesce("l", F.lit("")), width, " "), F.lit(" | "), F.coalesce("r", F.lit("")))
    return joined.select("line_no", mark.alias("mark"), row.alias("row"))
