"""Shared storage for cutting lineage.

A table written to the folder every executor shares survives the loss of an
executor; a local checkpoint does not. The folder comes from the session.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a single-process ``local`` session without that setting falls back to
    a temporary folder; anything else without the setting is an error.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"quillrank-{os.getpid()}")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; removed when the process ends."""
    path = f"{shared_dir(spark)}/quillrank/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, label: str) -> DataFrame:
    """``stored``; in a session without a shared folder, held by the executors instead."""
    try:
        shared_dir(df.sparkSession)
    except ValueError:
        return df.persist()
    return stored(df, label)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                forget(spark, path)
        except Exception:  # the session may be gone; its storage then outlives it
            return
