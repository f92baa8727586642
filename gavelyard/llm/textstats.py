"""Counts over whole texts, for a block of documents at once."""

from __future__ import annotations

import numpy as np

from .bytesets import Block, mix, ragged, span_digests

_U = np.uint64


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL = _table("#*$%&|<>")
_BAR, _BANG, _STOP, _DIGIT = _table("|"), _table("!"), _table(".?;:,"), _table("0123456789")
_UPPER, _LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _per_doc(mask: np.ndarray, offset: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offset[1:]] - total[offset[:-1]]


def _repeats(key: np.ndarray) -> np.ndarray:
    """For every key whether it occurs more than once."""
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def counts(block: Block, window: int = 5) -> dict[str, np.ndarray]:
    """Per document: words, code points in words, symbols, lines with a word, such lines that repeat an earlier one,
    words in `window`-word windows found twice or more, and neighbouring equal words."""
    data, n = block.data, block.n
    start, end, doc = block.words()
    word = span_digests(data, start, end)
    at = ragged(doc, n)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    in_words = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(points[end] - points[start], out=in_words[1:])
    # lines: from a document's start or after "\n", to the next "\n" or the document's end
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((block.offset[:-1], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))[: len(line_start)]
    line_end = line_end - (data[line_end - 1] == 10)
    line_doc = np.searchsorted(block.offset, line_start, side="right") - 1
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    key = mix(span_digests(data, line_start, line_end) + line_doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(line_doc, minlength=n)
    distinct = np.bincount(line_doc[first], minlength=n)
    # windows
    k = max(0, len(word) - window + 1)
    joined = doc[:k].astype(np.uint64) * _U(0xD1B54A32D192ED03)
    for w in range(window):
        joined = mix(joined * _U(0xC2B2AE3D27D4EB4F) + word[w : w + k] + _U(w + 1))
    inside = np.flatnonzero(doc[:k] == doc[window - 1 : window - 1 + k]) if k else np.zeros(0, dtype=np.int64)
    again = inside[_repeats(joined[inside])] if len(inside) else inside
    cover = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    covered = np.cumsum(cover[:-1]) > 0
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    return {
        "n_words": np.diff(at),
        "word_chars": in_words[at[1:]] - in_words[at[:-1]],
        "n_symbols": _per_doc(_SYMBOL[data], block.offset),
        "n_lines": lines,
        "n_dup_lines": lines - distinct,
        "n_repeat_words": np.bincount(doc[covered], minlength=n) if len(word) else np.zeros(n, dtype=np.int64),
        "n_same_words": np.bincount(doc[same], minlength=n) if len(word) else np.zeros(n, dtype=np.int64),
    }


FEATURES = ("log_words", "word_length", "symbols", "bars", "bangs", "stops", "digits", "upper", "dup_lines", "repeats", "same", "line_words")


def features(block: Block) -> np.ndarray:
    """One row of FEATURES per document, each in a bounded range; zeros for a text without words."""
    c, data, offset = counts(block), block.data, block.offset
    words = np.maximum(c["n_words"], 1)
    letters = np.maximum(_per_doc(_LETTER[data], offset), 1)
    rate = lambda table: np.minimum(_per_doc(table[data], offset) / words, 3.0)
    x = np.column_stack([
        np.log1p(c["n_words"]), np.minimum(c["word_chars"] / words, 30.0), rate(_SYMBOL), rate(_BAR), rate(_BANG), rate(_STOP), rate(_DIGIT),
        _per_doc(_UPPER[data], offset) / letters, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words, c["n_same_words"] / words,
        np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)),
    ]).astype(float)
    x[c["n_words"] == 0] = 0.0
    return x
