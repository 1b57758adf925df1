"""Change watching: created and modified files as a stream, or between two snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "path string, mtime timestamp, kind string"


def between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind): created and modified files by their times; deletions are not events."""
    old = before.select("path", F.col("mtime").alias("old"))
    kind = F.when(F.col("old").isNull(), "created").when(F.col("old") != F.col("mtime"), "modified")
    return after.join(old, "path", "left").select("path", kind.alias("kind")).where("kind is not null")


def from_history(versions: DataFrame) -> DataFrame:
    """(path, mtime, kind) for a history (path, mtime): the first time of a path creates it, each further time modifies it."""
    w = Window.partitionBy("path").orderBy("mtime")
    last = F.lag("mtime").over(w)
    return versions.select("path", "mtime", F.when(last.isNull(), "created").otherwise("modified").alias("kind"), last.alias("_l")).where("_l is null or _l <> mtime").drop("_l")


def _step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    out = []
    for t in sorted({pd.Timestamp(t) for f in frames for t in f["mtime"]}):
        if last is None or t.value // 1000 > last:
            out.append((key[0], t, "created" if last is None else "modified"))
            last = t.value // 1000
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(out, columns=["path", "mtime", "kind"])


def events(files: DataFrame) -> DataFrame:
    """The events of a stream of files (path, mtime): the state is one time per path."""
    return files.select("path", "mtime").groupBy("path").applyInPandasWithState(_step, EVENTS, "last long", "append", GroupStateTimeout.NoTimeout)


def watch(files: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 0.5):
    """Starts a query that hands each batch of events to `on_batch`; returns it."""
    q = events(files).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return q.trigger(processingTime=f"{int(seconds * 1000)} milliseconds").foreachBatch(on_batch).start()


def verify_changed(check: Callable[[DataFrame], DataFrame], docs: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A batch function that checks the documents which changed."""

    def run(batch: DataFrame, number: int) -> None:
        changed = batch.where("kind = 'modified'").select("path").distinct()
        sink(check(docs().join(changed, "path", "left_semi")), number)

    return run
