"""Token ids in files of directly addressable codes: any id is read without decoding the ones before it.

An id is split into chunks of `CHUNK_BITS` bits. Level 0 holds the lowest chunk of every id, level k the next
chunk of those that need one; a bitmap per level says which ids go on, and a rank directory (ones before every
512th bit) turns a place in one level into the place in the next with one popcount. A segment is some whole
documents in ascending doc_id order; its record is

    magic "DAC1", ids, levels, then per level: entries, bitmap, directory, chunks

with all numbers little-endian. Segments are rows of a Parquet table (part, ids of the part before it, doc ids, payload), so
Spark's commit protocol covers lost executors and any file system that Spark reads will do.

Defined cases: null and empty texts have the end id alone; rows that repeat a doc_id are written in order of their
text; a null doc_id comes first; an empty table writes no segment and reads back as no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .tokens import encoder as shared_encoder

CHUNK_BITS = (8, 8, 8, 8)
_STRIDE = 512
_MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    """The record of a segment."""
    rest = ids.astype(np.uint32)
    levels = []
    for k, bits in enumerate(CHUNK_BITS):
        low = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8)
        high = rest >> np.uint32(bits) if bits < 32 else np.zeros_like(rest)
        goes_on = high > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(goes_on, dtype=np.int64)))
        directory = ones[: len(goes_on) : _STRIDE].astype("<u4")
        levels.append(struct.pack("<I", len(low)) + bitmap.tobytes() + directory.tobytes() + low.tobytes())
        rest = high[goes_on]
        if not len(rest) or k + 1 == len(CHUNK_BITS):
            break
    return _MAGIC + struct.pack("<II", len(ids), len(levels)) + b"".join(levels)


class Segment:
    """A record, open for reading."""

    def __init__(self, record: bytes):
        if record[:4] != _MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n, levels = struct.unpack_from("<II", record, 4)
        self.levels, at = [], 12
        for _ in range(levels):
            (n,) = struct.unpack_from("<I", record, at)
            at += 4
            part = []
            for kind, size in ((np.uint8, -(-n // 8)), ("<u4", -(-n // _STRIDE)), (np.uint8, n)):
                part.append(np.frombuffer(record, dtype=kind, count=size, offset=at))
                at += part[-1].nbytes
            self.levels.append(part)

    def get(self, i: int) -> int:
        """Id i, by one look-up a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for (bitmap, directory, chunk), bits in zip(self.levels, CHUNK_BITS, strict=False):
            value |= int(chunk[i]) << shift
            shift += bits
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // _STRIDE
            whole = bitmap[block * _STRIDE // 8 : i >> 3]
            i = int(directory[block]) + int(np.bitwise_count(whole).sum()) + int(np.bitwise_count(np.uint8(bitmap[i >> 3] & ((1 << (i & 7)) - 1))))
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, rest, shift = np.zeros(self.n, dtype=np.uint32), np.arange(self.n), 0
        for (bitmap, _, chunk), bits in zip(self.levels, CHUNK_BITS, strict=False):
            out[rest] |= chunk.astype(np.uint32) << np.uint32(shift)
            shift += bits
            rest = rest[np.unpackbits(bitmap, count=len(rest), bitorder="little").astype(bool)]
        return out


_SEGMENT = "part int, before long, n_ids long, doc_ids array<long>, ends array<long>, payload binary"


def _write(path: str, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, before = shared_encoder(path), TaskContext.get().partitionId(), 0
        docs: list[int] = []
        ends: list[int] = []
        held: list[bytes] = []

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            row = [[part], [before], [len(ids)], [list(docs)], [list(ends)], [encode(ids)]]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["part", "before", "n_ids", "doc_ids", "ends", "payload"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.ids(some.column(1).to_pylist()), strict=True):
                    held.append(ids + b"\0\0\0\0")
                    docs.append(doc_id)
                    ends.append((ends[-1] if ends else 0) + len(ids) // 4 + 1)
                    if ends[-1] >= segment_ids:
                        yield segment()
                        before += ends[-1]
                        docs.clear()
                        ends.clear()
                        held.clear()
        if docs:
            yield segment()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, partitions: int | None = None, segment_ids: int = 1 << 18) -> None:
    """Encode every text, append id 0, and write segments in ascending doc_id order under `path`."""
    typed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = typed.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(_write(tokenizer_path, segment_ids), _SEGMENT).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            doc_ids, ends, base = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
            segment = Segment(batch.column(2)[i].as_py())
            raw = segment.all().astype("<u4").tobytes()
            starts = [0, *ends[:-1]]
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)]
            middle = [segment.get((s + e) // 2) for s, e in zip(starts, ends, strict=True)]
            cols = [doc_ids, [base + s for s in starts], [e - s for s, e in zip(starts, ends, strict=True)], crc, middle]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32", "middle_id"])


def part_starts(segments: DataFrame) -> DataFrame:
    """(part, start): ids before each part; a row per partition of the writing job, whatever the data's size."""
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    totals = segments.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    return totals.select("part", (F.sum("n").over(line) - F.col("n")).alias("start"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, middle_id) from the files under `path`; the id in a document's middle is read alone."""
    segments = spark.read.schema(_SEGMENT).parquet(path)
    placed = segments.join(F.broadcast(part_starts(segments.select("part", "before", "n_ids"))), "part")
    return placed.select("doc_ids", "ends", "payload", (F.col("start") + F.col("before")).alias("base")).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, middle_id long")


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, nth, at, out = [], [], [], []
        for i in range(batch.num_rows):
            segment = Segment(batch.column(1)[i].as_py())
            for x in batch.column(0)[i].as_py():
                doc.append(x["doc_id"])
                nth.append(x["nth"])
                at.append(segment.get(x["at"]))
        yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(nth, pa.int64()), pa.array(at, pa.int64())], ["doc_id", "nth", "id"])


def ids_at(spark: SparkSession, path: str, wanted: DataFrame, most: int = 4096) -> DataFrame:
    """(doc_id, nth, id) for the rows (doc_id, nth) of `wanted`: single ids from the files under `path`, nth from 0.

    Only the narrow columns of all segments are read to find the places; then the segments that are asked for are read,
    and in them each id alone. Places outside a document, unknown documents and null doc_ids give no row; of documents
    that repeat a doc_id each one answers. At most `most` places of a segment go in one row.
    """
    segments = spark.read.schema(_SEGMENT).parquet(path)
    each = segments.select("part", "before", F.posexplode("doc_ids").alias("k", "doc_id"), "ends")
    first = F.when(F.col("k") > 0, F.element_at("ends", F.col("k"))).otherwise(F.lit(0))
    each = each.select("part", "before", "doc_id", first.alias("first"), F.element_at("ends", F.col("k") + 1).alias("last"))
    asked = wanted.select(F.col("doc_id").cast("long"), F.col("nth").cast("long")).where("nth >= 0").distinct().join(each, "doc_id").where("first + nth < last")
    dealt = asked.withColumn("deal", F.floor((F.row_number().over(Window.partitionBy("part", "before").orderBy("doc_id", "nth")) - 1) / most))
    packed = dealt.groupBy("part", "before", "deal").agg(F.collect_list(F.struct("doc_id", "nth", (F.col("first") + F.col("nth")).alias("at"))).alias("places"))
    held = packed.join(segments.select("part", "before", "payload"), ["part", "before"])
    return held.select("places", "payload").mapInArrow(_look_up, "doc_id long, nth long, id long")
