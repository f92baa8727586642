"""New folders and tables for a job's own use: in the cluster's shared folder, or a temporary one on a local master."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gavelyard-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written once as compressed Parquet and read back, and its path; a fraction of what a checkpoint's rows take."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table written by `keep`; what still reads it must have been written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove((spark, path))


def clear() -> None:
    """Delete all tables that are left."""
    for spark, path in list(_written):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: its cluster clears the folder
            continue


atexit.register(clear)
