"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of at most so many bytes, by Spark's own estimate, may be broadcast.
SMALL = 64 << 20


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, as a URI; a fresh temporary one where it is unset in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(named)
    # A path without a scheme belongs to the default file system, which Python on an executor can't know.
    where = context._jvm.org.apache.hadoop.fs.Path(named)
    uri = where.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; removed when the application ends."""
    path = f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs here go when it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder: its lineage is cut, and a lost executor loses nothing of it."""
    path = fresh(df.sparkSession, kind)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def small(table: DataFrame, most: int = SMALL) -> DataFrame:
    """table, to be broadcast if its size is known to be at most `most` bytes: that of files, or of rows in the plan."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(table) if size <= most else table
