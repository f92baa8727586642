"""Labelled rows for fitting: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves 1 on division by 3: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = 20_000) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents outside the held-out third.

    The sample is those with the smallest digests of doc_id, so it does not depend on partitions. Rows without
    a label or doc_id are left out; a doc_id labelled twice takes its larger label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # few rows out of many files: dealt anew, so that all cores learn
    return found.repartition(docs.sparkSession.sparkContext.defaultParallelism)
