"""Substring dedup by hashing lines, the sentences in them, and runs of neighbouring units.

Units are normalised (ASCII lower case, runs of white space as one space) and digested to 128 bits. A line counts
from `min_words` words or LINE_CHARS characters, a sentence inside a line from `min_words` words or SENTENCE_CHARS
characters (so text without spaces counts too). What is shorter counts within runs: from each unit on, and up to each
unit, the fewest neighbouring lines or sentences with RUN_CHARS characters together. So each short unit goes that lies
in a repeated stretch of whole units of that length; runs that add nothing to this are left out. A part of
a sentence is no unit: the sentences at which a passage meets other words in one line stay. Digests are grouped
globally: per digest only the earliest occurrence by (doc_id, offset) is kept. Groups are counted with partial sums
before the shuffle and only digests seen twice meet their occurrences again, so a line that a third of all documents
share is a join with one row on its side, which adaptive execution splits. Removed spans keep their original code
point offsets.

Defined cases: a null text stays null and an empty one empty; a line or sentence repeated inside one document
counts like one repeated across documents; rows that repeat a doc_id are told apart in the order of their texts, so
which one stays does not depend on partitions; a null doc_id ranks last; columns of any name stay as they are, but an
input column named `removed` gives way to the result's; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import free_name, keep, numbered

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])\s*(?=[^\s。！？」』”’）])")
LINE_CHARS, SENTENCE_CHARS, RUN_CHARS = 16, 40, 100
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digest(normal: str) -> bytes:
    return hashlib.blake2b(normal.encode("utf-8", "replace"), digest_size=16).digest()


def units(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the lines of `text`, of the sentences of lines that have several, and of runs."""
    at, pieces, lines = 0, [], set()
    for line in text.split("\n"):
        words = line.split()
        if words:
            normal = " ".join(words).translate(_UPPER)
            counts = len(words) >= min_words or len(normal) >= LINE_CHARS
            if counts:
                lines.add((at, at + len(line)))
                yield at, at + len(line), _digest(normal)
            start, ends = 0, [m.span() for m in _SENTENCE.finditer(line)]
            if not ends:
                pieces.append((at, at + len(line), normal, counts))
            else:
                for gap_start, gap_end in [*ends, (len(line), len(line))]:
                    words = line[start:gap_start].split()
                    normal = " ".join(words).translate(_UPPER)
                    counts = len(words) >= min_words or len(normal) >= SENTENCE_CHARS
                    if counts:
                        yield at + start, at + gap_start, _digest(normal)
                    pieces.append((at + start, at + gap_start, normal, counts))
                    start = gap_end
        at += len(line) + 1
    yield from _runs(pieces, lines)


def _runs(pieces: list[tuple[int, int, str, bool]], lines: set[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """The shortest runs of RUN_CHARS characters from each short piece on, and up to each piece with short ones after its first.

    Of a repeated stretch each short piece is in one: the run from it on, or where that is longer than the stretch, the run
    up to the stretch's end. Runs that are one of `lines` are left out.
    """
    if all(p[3] for p in pieces):
        return
    upto, short = [0], [0]
    for _, _, normal, counts in pieces:
        upto.append(upto[-1] + len(normal))
        short.append(short[-1] + (not counts))
    found, i, n = set(), 0, 0
    for j in range(1, len(upto)):
        while n < len(upto) - 1 and upto[n] - upto[j - 1] < RUN_CHARS:
            n += 1
        if not pieces[j - 1][3] and upto[n] - upto[j - 1] >= RUN_CHARS:
            found.add((j - 1, n))
        while upto[j] - upto[i + 1] >= RUN_CHARS:
            i += 1
        if upto[j] - upto[i] >= RUN_CHARS and short[j] > short[i + 1]:
            found.add((i, j))
    for i, j in sorted(found):
        start, end = pieces[i][0], pieces[j - 1][1]
        if (start, end) not in lines:
            yield start, end, _digest(" ".join(p[2] for p in pieces[i:j]))


def _emit(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                row, span, again, digest = [], [], [], []
                for r, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen: set[bytes] = set()
                    for s, e, d in sorted(units(text or "", min_words)):
                        row.append(r)
                        span.append(s << 32 | e)
                        again.append(d in seen)
                        digest.append(d)
                        seen.add(d)
                d = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(row, pa.int64()), pa.array(span, pa.int64()), pa.array(again, pa.bool_()), pa.array(d[:, 0]), pa.array(d[:, 1])], ["row", "span", "again", "d1", "d2"])

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, ascending and apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the spans; a line that they empty goes with its line end."""
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s])
        at = e
        if (s == 0 or text[s - 1] == "\n") and text[e : e + 1] == "\n":
            at = e + 1
    kept.append(text[at:])
    return "".join(kept)


def _cut(text_at: int, spans_at: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist()
            done = [merge([(x >> 32, x & 0xFFFFFFFF) for x in s]) if s else [] for s in spans]
            text = [remove(t, s) if s else t for t, s in zip(texts, done, strict=True)]
            cols = [batch.column(i) for i in range(width)]
            cols[text_at] = pa.array(text, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            removed = pa.array([[{"start": s, "end": e} for s, e in x] for x in done], kind)
            yield pa.record_batch([*cols, removed], [*[batch.schema.names[i] for i in range(width)], "removed"])

    return run


def drop_repeated_units(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """Every row of `docs`, `text` without repeated units, and `removed`: array of (start, end) in the old text."""
    docs = docs.drop("removed")
    names = docs.columns
    rows, name = numbered(docs)
    # span: start in the upper half, end in the lower one. again: a row's own repeats, which go in any case, so only the
    # first occurrences of each row are grouped, by the row alone; narrow rows keep the two shuffles small.
    found = keep(rows.select(name, "text").mapInArrow(_emit(min_words), "row long, span long, again boolean, d1 long, d2 long"), "units")
    firsts = found.where("not again")
    groups = firsts.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1").select("d1", "d2", "first")
    later = firsts.join(groups, ["d1", "d2"]).where("row != first").select("row", "span")
    gone = later.unionByName(found.where("again").select("row", "span"))
    gaps = free_name(rows, "spans")
    spans = gone.groupBy(F.col("row").alias(name)).agg(F.collect_set("span").alias(gaps))
    joined = rows.join(spans, name, "left").select(*[F.col(f"`{c}`") for c in names], gaps)
    out = schema_with(docs, "removed array<struct<start:int,end:int>>")
    return joined.mapInArrow(_cut(names.index("text"), len(names), len(names)), out)


def schema_with(docs: DataFrame, more: str):
    """The schema of `docs` with further columns."""
    from pyspark.sql.types import StructType

    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])
