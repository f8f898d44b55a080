"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``.

    Only where the setting is absent and the session is local (tests, a laptop)
    is a temporary folder taken instead; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, label: str = "scratch") -> Iterator[str]:
    """The operators called inside put their intermediate tables into one folder,
    which is deleted at the end. Results are lazy: write them before that."""
    path = f"{shared_dir(spark)}/tideline/{label}-{uuid.uuid4().hex}"
    token = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        delete_path(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder for an intermediate table: in that of ``scratch``, or else one
    that is deleted when the driver ends."""
    inside = _SCRATCH.get()
    if inside:
        return f"{inside}/{label}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tideline/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    return path


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, survives lost executors, and fixes what is not deterministic."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
