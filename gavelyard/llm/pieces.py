"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a stretch of text once; at each place its output links name every piece that ends there,
and each is relaxed against the best way to the place where it starts:

- unigram models: the largest sum of scores wins (Viterbi);
- BPE models: the sum of scores does not give that model's pieces, so a piece is taken if it may stand behind
  the last piece of the encoding that ends where it starts, that is if merging the two pieces' characters gives
  back just these two (a step of score 0, all others of minus infinity). Exactly one piece passes, and the result is the
  model's own encoding. A character of no piece takes part in no merge, so texts are divided at such characters first.

Where no piece ever has a visible character in front of a space mark, stretches begin at space marks (and end at
line ends, if no piece has one) and are remembered, so repeated words cost one look-up. A worker process keeps its
model and this memory, which is bounded, for later tasks.

Defined cases: null and empty texts have no ids; rows that repeat give the same ids; a null doc_id stays null; very long
texts, with or without spaces, take time in proportion to their length (n log n where pieces must be merged by
definition); columns besides doc_id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
# Piece types and model types as the public model format numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, object]]:
    """(field, value) of a protocol buffers message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


class Stretches(dict):
    """Packed ids by stretch, computed on first use."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, stretch: str) -> bytes:
        packed = self[stretch] = self.model._pack(stretch)
        return packed


class Model:
    """A model file of the public SentencePiece format, with identity normalisation."""

    def __init__(self, data: bytes, kind: int | None = None, most_cached: int = 1_000_000):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        types: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in message(data):
            if field == 1:
                piece = dict(message(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                types.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(message(value))
            elif field == 3:
                normalizer = dict(message(value))
        if normalizer.get(2) or USER_DEFINED in types:
            raise ValueError("only models with identity normalisation and without user defined pieces are supported")
        self.kind = kind or trainer.get(3, UNIGRAM)
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.unknown = types.index(UNKNOWN)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(types) if t == BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i, t in enumerate(types) if t == CONTROL}
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, types, strict=True)) if t == NORMAL}
        #: Characters of some piece: a merge of characters can hold no others.
        self.letters = frozenset(c for p in self.ids for c in p)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.alone = bool(self.bytes) and not any("\n" in p for p in self.ids)
        stop = "\n" if self.alone else ""
        self.stretches = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+|\n").findall
        self.most_cached = most_cached
        self.cache = Stretches(self)
        self.neighbours: dict[int, bool] = {}
        self.wholes: dict[int, bool] = {}
        spelled = [b"" if i in self.hidden else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelled = [bytes([self.of_byte[i]]) if i in self.of_byte else " ⁇ ".encode() if i == self.unknown else b for i, b in enumerate(spelled)]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: of all neighbours whose union is a piece the best scored, leftmost first, is merged.

        Candidates wait in a heap; one whose neighbours have changed since is passed over.
        """
        n = len(text)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # of the part that starts at k
        heap: list[tuple[float, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                i = self.ids.get(text[k : end[after[k]]])
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], k, end[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, stop = heapq.heappop(heap)
            if before[k] == -2 or after[k] >= n or end[after[k]] != stop:
                continue
            gone = after[k]
            end[k], after[k] = stop, after[gone]
            before[gone] = -2
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        out, k = [], 0
        while k < n:
            out.append(text[k : end[k]])
            k = after[k]
        return out

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the characters of pieces a and b gives back just these two."""
        key = a << 32 | b
        known = self.neighbours.get(key)
        if known is None:
            if len(self.neighbours) > 2_000_000:
                self.neighbours.clear()
            pair = [self.pieces[a], self.pieces[b]]
            known = self.neighbours[key] = self.merged(pair[0] + pair[1]) == pair
        return known

    def _whole(self, i: int) -> bool:
        """Whether merging the characters of piece i gives the piece."""
        known = self.wholes.get(i)
        if known is None:
            known = self.wholes[i] = self.merged(self.pieces[i]) == [self.pieces[i]]
        return known

    def _split_bpe(self, stretch: str) -> list[int] | None:
        """Ids of a stretch of known characters; None where a character or a chain of pieces is missing."""
        n = len(stretch)
        last: list[int] = [-1] * (n + 1)
        size: list[int] = [0] * (n + 1)
        neighbours = self.neighbours
        for end, (length, i) in self.automaton.iter(stretch):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                known = neighbours.get(before << 32 | i)
                if not (self._may_follow(before, i) if known is None else known):
                    continue
            elif length > 1 and not self._whole(i):
                continue
            last[end], size[end] = i, length
        out = []
        while n:
            if last[n] < 0:
                return None
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def split(self, stretch: str) -> list[tuple[str, int | None]]:
        """(text, id) of the pieces of a stretch; a character of no piece has id None."""
        if self.kind == BPE:
            out = []
            for known, run in groupby(stretch, self.letters.__contains__):
                if not known:
                    out += [(c, None) for c in run]
                    continue
                part = "".join(run)
                ids = self._split_bpe(part)
                # where merging never makes a piece of the chain, it is done by definition
                out += [(p, self.ids.get(p)) for p in self.merged(part)] if ids is None else [(self.pieces[i], i) for i in ids]
            return out
        n = len(stretch)
        best: list[float | None] = [0.0] + [None] * n
        back: list[tuple[int, int | None]] = [(0, None)] * (n + 1)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(stretch):
            found[end + 1].append(piece)
        for end in range(1, n + 1):
            for length, i in found[end]:
                score = best[end - length] + self.scores[i]
                if best[end] is None or score > best[end]:
                    best[end], back[end] = score, (length, i)
            lone = best[end - 1] + self.unknown_score
            if all(length > 1 for length, _ in found[end]) and (best[end] is None or lone > best[end]):
                best[end], back[end] = lone, (1, None)
        out, at = [], n
        while at:
            length, i = back[at]
            out.append((stretch[at - length : at], i))
            at -= length
        return out[::-1]

    def _pack(self, stretch: str) -> bytes:
        ids: list[int] = []
        lost = False  # neighbouring unknown characters are one unknown piece
        for text, i in self.split(stretch):
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in text.encode()]
            elif not lost:
                ids.append(self.unknown)
            lost = i is None and not self.bytes
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (null: empty) as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = text.replace(" ", SPACE)
        if self.prefix and text:
            text = SPACE + text
        if not self.apart:
            return self._pack(text)
        if len(self.cache) > self.most_cached:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.stretches(text)))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; byte pieces are joined as UTF-8, control pieces have no text."""
        text = b"".join(map(self.spelled.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_models: dict[str, Model] = {}


def shared_model(path: str) -> Model:
    """This process's model of a file."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def _round(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = model.encode(text)
                plain = (text or "").replace(SPACE, " ")
                rows.append((doc_id, len(packed) // 4, zlib.crc32(packed), model.decode(packed) == plain))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "n_pieces", "ids_crc32", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and `ids` (array of ints) of every text; null and empty texts have no ids, repeated rows the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = shared_model(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                packed = [np.frombuffer(model.encode(t), dtype="<i4") for t in some.column(1).to_pylist()]
                yield pa.record_batch([some.column(0), pa.array(packed, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of `ids`; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = shared_model(model_path)
        for batch in batches:
            texts = [model.decode(np.array(ids or [], dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and whether decoding gives the text back, for every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_round(model_path), "doc_id long, n_pieces long, ids_crc32 long, decoded boolean")
