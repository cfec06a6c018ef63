"""Folders for intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode when it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_roots[sc.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name (not yet made) in the shared folder."""
    return f"{shared_root(spark)}/nodeloom/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop file system, path) of a path that Spark reads, wherever it is."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def delete(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path, True)


@contextlib.contextmanager
def listed_by_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Inside, a reader that is made lists its folders with two tasks a core at most, each several folders, instead of one task a folder.

    What a task sends to the driver beside the files it has found, and the time until it starts, then no longer grow with the folders.
    """
    key, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 2 * spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, min(most, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Scratch tables of one piece of work, deleted together."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, scratch(spark, name)

    def store(self, rows: DataFrame, name: str, *by: str) -> DataFrame:
        """Write rows (in folders by the columns ``by``) and read them back."""
        path = f"{self.folder}/{name}"
        writer = rows.write.partitionBy(*by) if by else rows.write
        writer.parquet(path)
        with listed_by_few_tasks(self.spark):
            return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.folder)
