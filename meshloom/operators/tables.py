"""Tables that steps write and read again: lineage is cut there, and what was decided once stays decided."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/meshloom-tables"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where all runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or LOCAL_FALLBACK).rstrip("/")


class Tables:
    """A folder for one run's tables: its own, or that of an earlier run that shall go on."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame | None:
        """A table that was written whole, by this run or one before it; None where there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.root}/{name}")

    def last(self, name: str) -> int | None:
        """The greatest n of the tables <name>-n that were written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return max((int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in found), default=None)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def only_marked_broadcasts(spark: SparkSession):
    """Within, no table is broadcast but those marked so. Spark tells the size of a generated mesh from that of its range: exploded
    cells, and joins of them, are many times as large, and would be collected on the driver."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)
