"""Vectorised work on whole texts: words and their digests, for a block of documents at once.

A block is a few MB of UTF-8, so memory stays bounded whatever the Arrow batch holds; one document is
never divided, so a very long text makes one larger block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Longer byte ranges are digested one by one with BLAKE2b.
_LONG = 96
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of the byte ranges [start, end) of `data`; equal bytes give equal digests anywhere.

    A range is read in steps of 8 bytes, all ranges at once, and each step passes through `mix`, which is not linear:
    unlike for a polynomial, no family of texts has one digest. Long ranges take a cryptographic digest.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(0x9E3779B97F4A7C15))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, dtype=np.uint8))), 8)
    at = np.flatnonzero((size > 0) & (size <= _LONG))
    where, left, value = start[at], size[at], out[at]
    while len(at):
        chunk = np.ascontiguousarray(eight[where]).view("<u8").ravel() & _LOW_BYTES[np.minimum(left, 8)]
        value = mix((value ^ chunk) * _U(0xC2B2AE3D27D4EB4F) + _U(1))
        more = left > 8
        if not more.all():
            out[at[~more]] = value[~more]
            at, where, left, value = at[more], where[more], left[more], value[more]
        where, left = where + 8, left - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Block:
    """Some documents of a batch: `data` holds their bytes, document i is data[offset[i]:offset[i + 1]]."""

    def __init__(self, first: int, data: np.ndarray, offset: np.ndarray, lower: bool):
        self.first, self.offset, self.n = first, offset, len(offset) - 1
        self.data = _LOWER[data] if lower else data

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word `[^\\x20\\x09-\\x0D]+`."""
        n = len(self.data)
        inside = ~_SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offset] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:n]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return start, end, np.searchsorted(self.offset, start, side="right") - 1


def blocks(texts: pa.Array, lower: bool = False, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow column in blocks; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offset = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + most, side="right")) - 1)
        yield Block(i, raw[offset[i] : offset[j]], offset[i : j + 1] - offset[i], lower)
        i = j


def ragged(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the runs of an ascending document column."""
    return np.searchsorted(doc, np.arange(n + 1))


def shingle_sets(block: Block, width: int) -> list[np.ndarray]:
    """Per document the ascending distinct digests of its `width`-word shingles; a shorter one has one of all its words."""
    start, end, doc = block.words()
    word = span_digests(block.data, start, end)
    at = ragged(doc, block.n)
    k = max(0, len(word) - width + 1)
    joined = np.zeros(k, dtype=np.uint64)
    for w in range(width):
        joined = mix(joined * _U(0xC2B2AE3D27D4EB4F) + word[w : w + k] + _U(w + 1))
    out = []
    for i in range(block.n):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            s = np.sort(joined[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif b > a:
            x = np.zeros(1, dtype=np.uint64)
            for w in range(a, b):
                x = mix(x * _U(0xA0761D6478BD642F) + word[w : w + 1] + _U(b - a + 64))
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
