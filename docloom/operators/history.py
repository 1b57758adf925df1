"""Memory of runs: totals, the latest, suggestions; results of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, runs, success_rate, average, per_second) over runs (success, seconds, docs); rates are 0 without runs or time."""
    n = F.count(F.lit(1))
    time = F.coalesce(F.sum("seconds"), F.lit(0.0))
    rate = F.when(n > 0, F.count_if("success") / n * 100).otherwise(0.0)
    return runs.groupBy(*keys).agg(
        n.alias("runs"), F.round(rate, 6).alias("success_rate"), F.round(F.when(n > 0, time / n).otherwise(0.0), 6).alias("average"),
        F.round(F.when(time > 0, F.sum("docs") / time).otherwise(0.0), 6).alias("per_second"),
    )


def suggestions(totals: DataFrame) -> DataFrame:
    """(the columns of `stats`, suggestion): what its figures suggest, a row each."""
    found = F.array_compact(F.array(
        F.when(F.col("success_rate") < 90, "validate before commands"), F.when((F.col("per_second") < 10) & (F.col("runs") > 5), "cache what is read")
    ))
    return totals.withColumn("suggestion", F.explode(found))


def recent(runs: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """The last n runs of each key, the latest first as `place` 1."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).where(F.col("place") <= n)


def batch_rate(items: DataFrame) -> DataFrame:
    """One row over items (success): their number, successes, and the rate of success, 100 without items."""
    n = F.count(F.lit(1))
    return items.agg(n.alias("items"), F.count_if("success").alias("succeeded"), F.when(n > 0, F.round(F.count_if("success") / n * 100, 6)).otherwise(100.0).alias("rate"))


def change_totals(changes: DataFrame) -> DataFrame:
    """One row over changes (path, field): how many, in how many files."""
    return changes.agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("path").alias("files"))
