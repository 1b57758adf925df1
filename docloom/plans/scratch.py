"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; a temporary folder only where all is one machine."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if where:
        return where
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="docloom-")


class Rounds:
    """Tables written one after the other, so that no plan grows with their number and none is computed twice. Spark removes
    the folder at its end."""

    def __init__(self, spark: SparkSession, name: str = "rounds"):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        self.n = 0

    def write(self, df: DataFrame, name: str | None = None) -> DataFrame:
        self.n += 1
        where = f"{self.root}/{name or self.n}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)
