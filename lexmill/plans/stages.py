"""Intermediate tables that several later steps read."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, a folder that all executors share.

    Only in local mode, as in tests, a folder of our own is made where that is unset; elsewhere it must be set.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir", None)
        if not found and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="lexmill-"))
    return (sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Writes herein give up their shuffle files as soon as each has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors, reads by column.

    Shuffle files of the write are given up as soon as it has ended.
    """
    path = scratch(df.sparkSession, "stage")
    with freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stage`` wrote, where nothing will be computed from it any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
