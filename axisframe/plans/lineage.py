"""Cutting lineage through a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the cluster; where that is unset and all runs on this machine (tests), a new folder.

    On a cluster without the setting there is no folder that all executors see, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="axisframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/axisframe/{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def temporary(spark: SparkSession) -> str:
    """A path in the shared folder whose files are deleted when the driver ends."""
    path = new_path(spark)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """A table in the shared folder with the rows of ``df``; deleted when the driver ends."""
    return write_table(df, temporary(df.sparkSession))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def _in_tasks(df: DataFrame, n: int) -> DataFrame:
    return df.coalesce(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, n), (1 << 31) - 1))


def sized(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """``df`` in no more tasks than a table of at most ``rows`` rows of about ``width`` bytes is worth: files of 128 MB, but two tasks a core at least."""
    return _in_tasks(df, -(-rows * width // (128 << 20)))


def merged(df: DataFrame, least: int = 8 << 20) -> DataFrame:
    """``df`` without splits that are too small to be worth a task: by Spark's estimate of its size, ``least`` bytes a task, but two tasks a core at least.

    Tables in many small files or blocks otherwise give as many small tasks and small output files. Where splits are
    larger than that it changes nothing.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return _in_tasks(df, -(-size // least))


def from_driver(spark: SparkSession, rows: list, schema, most: int = 200_000) -> DataFrame:
    """A table of rows the driver holds, to be joined: broadcast up to ``most`` of them, beyond that left to a shuffle."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= most else df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``materialise`` whose tables are deleted at the end of the block: results must have been written elsewhere by then."""
    folder, count = new_path(spark), iter(range(1 << 30))
    try:
        yield lambda df: write_table(df, f"{folder}/{next(count)}")
    finally:
        remove(spark, folder)
