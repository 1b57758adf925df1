"""Pieces shared by the corpus operators: scratch tables, bounded broadcasts, Arrow text access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's default of 10,000 rows makes Arrow batches of texts that take a good part of an executor's memory, in the JVM
#: and in Python; where the session has that default, the operators set 1,000 until their scratch tables go.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A table of at most so many rows may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, else the context's checkpoint folder.

    Without either, a temporary folder serves where driver and executors are one machine, and a cluster is refused: a folder
    of one machine would lose what its executors write.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not where and context.getCheckpointDir():
        where = context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="docloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block; what was there before is put back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables in the shared folder, dropped together once their readers are done.

    A written table survives lost executors and is not computed again for its second reader.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self._shortened = spark.conf.get(_BATCH_ROWS) == "10000"
        if self._shortened:
            spark.conf.set(_BATCH_ROWS, "1000")
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = path
        self._fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "snappy").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self) -> None:
        self._fs.delete(self._path, True)
        if self._shortened:
            self.spark.conf.set(_BATCH_ROWS, "10000")

    def finish(self, df: DataFrame) -> DataFrame:
        """The result as a checkpoint, which Spark removes when nothing refers to it; the scratch tables go."""
        out = df.checkpoint(eager=True)
        self.drop()
        return out


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table that is expected to be small: broadcast only if a count shows that it has at most `rows` rows.

    Otherwise a sort-merge join, whose hot keys adaptive execution splits.
    """
    fits = small.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(small) if fits else small.hint("merge"), on, how)


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a unique long column that is the same whenever it is read, and that column's name, which docs doesn't use.

    It is doc_id where that is unique and never null; otherwise rows are numbered once, in a scratch table.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"] and dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    return scratch.table(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in body(value), inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_binary(), pa.large_string()):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; nulls are empty."""
    return [x or "" for x in column.to_pylist()]


def spans_of_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes each, a longer row alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def slices(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column` (a longer row alone), to bound a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffers(batch.column(column))
        for a, b in spans_of_bytes(offs, most):
            yield batch.slice(a, b - a)
