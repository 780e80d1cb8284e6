"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file; one that is there stays."""
    target, files = _path(spark, path)
    if not files.exists(target):
        files.create(target).close()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the session's checkpoint folder; in a temporary one only in local mode."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """In here a query's shuffle files go when it ends; else they stay until
    the driver happens to collect its garbage.  Spark before 4.1 keeps them."""
    own = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, own)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read again."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
