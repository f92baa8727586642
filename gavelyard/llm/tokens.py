"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

Such a tokenizer divides a text before it merges. It always divides in front of a lone space between two visible
characters, so stretches between these places are remembered as packed bytes and a repeated word costs one
look-up. A new stretch is divided on by the tokenizer's own pattern, and only parts that are new as well (not
"word," where "word" and "," are known) go through the library's BPE model, in its byte alphabet and without the
offsets that whole encodings carry. Results equal encoding the whole text.
A worker process keeps its memory for later tasks; it is bounded and starts anew when full.
"""

from __future__ import annotations

import codecs
import os
import re

_GAP = re.compile(r"(?<=\S) (?=\S)")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]  # all there are, the space itself included
#: Fixed value: the public pattern that byte-level BPE of this family divides texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def lone_spaces(text: str) -> bool:
    """Whether each space stands between two visible characters. Looks for few characters; a pattern would visit all."""
    if text[:1] == " " or text[-1:] == " ":
        return False
    return not any(c in text and (c + " " in text or " " + c in text) for c in _SPACES)


class _Memory(dict):
    """Packed ids by stretch; `new` computes those of an unknown one."""

    new = None

    def __missing__(self, stretch: str) -> bytes:
        packed = self[stretch] = self.new(stretch)
        return packed


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most_cached: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.most_cached = most_cached
        self.divide = regex.compile(PATTERN).findall
        # the byte alphabet: visible Latin-1 characters stand for themselves, the rest for those from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.alphabet = "".join(chr(rest.get(b, b)) for b in range(256))
        self.space = self.alphabet[32]
        self.merge = self.tokenizer.model.tokenize
        self.packed = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)]
        # A stretch is kept without the space in front of it; one without such a space is marked by a NUL.
        self.known = _Memory()
        self.known.new = self._stretch

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.most_cached:
            self.known.clear()
        get, out = self.known.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if "\0" in text:  # the mark of a stretch without a space, so nothing of such a text is remembered
                out.append(b"".join([self._merged(self._shown(p)) for p in self.divide(text)]))
                continue
            found = text.split(" ") if lone_spaces(text) else _GAP.split(text)
            found[0] = "\0" + found[0]
            out.append(b"".join(map(get, found)))
        return out

    def _stretch(self, s: str) -> bytes:
        if s.isalpha():
            return self._merged(self.space + (s if s.isascii() else self._shown(s)))
        if s[-1] in ".,;:!?" and s[:-1].isalpha():
            return self.known[s[:-1]] + self.known["\0" + s[-1]]
        parts = self.divide(s[1:] if s[0] == "\0" else " " + s)
        if len(parts) == 1:
            return self._merged(self._shown(parts[0]))
        return b"".join([self.known[p[1:]] if p[0] == " " and p[1:].strip() else self.known["\0" + p] for p in parts])

    def _shown(self, p: str) -> str:
        return codecs.charmap_decode(p.encode(), "strict", self.alphabet)[0]

    def _merged(self, shown: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(shown)])
