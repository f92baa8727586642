"""Packing of token sequences by the sum-of-squares rule.

The state of a shard is the number of open bins for each residual gap. A piece goes into the gap after which the
sum of the squared counts is smallest, which keeps gaps varied and so fillable; ties take the smallest gap, and a
bin is opened only for a piece that fits in none. Pieces are placed longest first. Shards hold a bounded number of pieces, drawn evenly, and are
packed independently; each wastes at most a few bins, so their number follows the input.

Defined cases: a null or empty text is one piece with the end id alone; documents of up to `capacity` ids are
never cut; longer ones are cut into `capacity` pieces, the first possibly shorter; rows that repeat are packed
each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import keep
from .tokens import encoder as shared_encoder


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length - (length - 1) // capacity * capacity
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                rows = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.ids(some.column(1).to_pylist()), strict=True):
                    ids += b"\0\0\0\0"
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order; a bin is opened only for a piece that fits in none."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; a full bin is not open
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gap = capacity
        have = count[s:capacity]
        if have.any():
            # change of the sum if a bin of gap g takes the piece, for g = s .. capacity - 1
            change = 2 * (count[: capacity - s] - have) + 2
            change[0] = 1 - 2 * have[0]
            change[have == 0] = np.iinfo(np.int64).max
            gap = s + int(change.argmin())
        if gap == capacity:
            home, bins = bins, bins + 1
        else:
            home = members[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = home, capacity - gap
        if gap > s:
            count[gap - s] += 1
            members[gap - s].append(home)
    return where, offset


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (rows["shard"].to_numpy() << 32) + where
        rows["offset"] = offset
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, shard_pieces: int = 100_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    typed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = keep(typed.mapInArrow(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    spread = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return spread.groupBy("shard").applyInPandas(_pack(capacity), schema)
