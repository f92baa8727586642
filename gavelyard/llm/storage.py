"""Where intermediate tables go: the shared folder that the cluster names, never an executor's own disk."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}  # by application: the temporary folder of a local session without the setting


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only on a local master where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gavelyard-")
    return _own[context.applicationId]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: a cut lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a further long column that tells rows apart and follows their order, and that column's name.

    Where doc_ids are unique and not null it is the doc_id. Otherwise rows are dealt by ranges of doc_id, sorted by
    (doc_id, text) with null ids last, numbered, and kept, so a retried task can't number them anew.
    """
    name = free_name(docs, "row_number")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(dealt.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def clear() -> None:
    """Delete every table written by `keep`; results that still read them must be written first."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended: its cluster clears the folder
            continue


atexit.register(clear)
