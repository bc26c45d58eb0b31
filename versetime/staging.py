"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where neither that setting nor a checkpoint
    folder exists and all runs in one process, as in tests, a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="versetime-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/versetime/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts the lineage: a lost executor costs a reread of files, not a rerun of all that made them,
    and a Python stage runs once however often its result is used.
    """
    return _written(df, new_shared_path(df.sparkSession, name))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A :func:`staged` whose tables go at the end of the block.

    What is used after it must have been staged by itself, so that a lost executor needs none of them again.
    """
    paths = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        paths.append(new_shared_path(spark, name))
        return _written(df, paths[-1])

    try:
        yield stage
    finally:
        for path in paths:
            _deleted(spark, path)


def rolling(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """A :func:`staged` for rounds that each need the table before alone: that goes once the next is written."""
    paths: list[str] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        paths.append(new_shared_path(spark, name))
        written = _written(df, paths[-1])
        if len(paths) > 1:
            _deleted(spark, paths.pop(0))
        return written

    return stage
