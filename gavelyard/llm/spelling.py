"""Spelling variants: words one edit apart, found by scanning sorted lists, and the commoner form that each leads to.

Two words of at least 2k code points that are one edit apart share their first k or their last k code points. With k
half the shorter one's length, words meet in groups by these, few to a group. A group's words (from behind, where they
share their ends) are scanned once in sorted order against all of the group's words: the edit matrix has a band of three
cells, its rows are kept by prefix length, and the row of a prefix shared with the word before is used again. A word
that is over one edit away from a prefix leaves the scan for the whole range of words that share this prefix, and a
range that nothing can reach any more is skipped. Groups beyond `block` words are scanned in blocks (`groups.dealt`).
Only counts and the best form of every word come out, no pairs.

Defined cases: a null text has no words; a null doc_id is written as nothing before the colon; rows that repeat are counted
each; words that occur too rarely, or are too short, are not there at all, neither as words nor as forms. Roots follow
forms, whose counts at least double, so there are no cycles. Texts without words and empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .groups import HELD, PASSING, dealt
from .storage import keep

#: Latin-1 bytes: letters stay, A-Z in lower case; the rest, and every code point beyond, ends a run.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_FAR = 9


def variants(text: str, doc_id: str, every: int = 97, shortest: int = 5) -> Iterator[tuple[bytes, int]]:
    """A text's runs as Latin-1 bytes and their counts; where `every` divides the crc32 of `<doc_id>:<run>`, a run lacks one code point."""
    base, digest = zlib.crc32(f"{doc_id}:".encode()), zlib.crc32
    for run, n in Counter(text.encode("latin-1", "replace").translate(_RUNS).split()).items():
        if len(run) < shortest:
            continue
        h = digest(run if run.isascii() else run.decode("latin-1").encode(), base)
        if h % every:
            yield run, n
        elif len(run) > shortest:
            at = h % len(run)
            yield run[:at] + run[at + 1 :], n


def _count(every: int, shortest: int, most: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        get = seen.get

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                if text := batch.column(1)[i].as_py():
                    for w, n in variants(text, batch.column(0)[i].as_py() or "", every, shortest):
                        seen[w] = get(w, 0) + n
                    if len(seen) > most:  # counts are partial ones: Spark adds them up
                        yield out()
                        seen.clear()
        yield out()

    return run


def vocabulary(docs: DataFrame, every: int = 97, shortest: int = 5, rarest: int = 3) -> DataFrame:
    """(word, n): the words of all texts."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_count(every, shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _points(words: list[str], width: int) -> np.ndarray:
    """Code points by place and word; 0 after a word's end."""
    packed = "".join(w.ljust(width, "\0") for w in words)
    return np.ascontiguousarray(np.frombuffer(packed.encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width).T)


def scan(listed: list[str], queries: list[str], shared: int, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each sorted word with near queries its index and theirs. All words begin with the same `shared` code points.

    Cells of a row for the prefix of length i are the distances to a query's prefixes of i - 1, i and i + 1. If `same`,
    the queries are the listed words, so a lone query still in the scan is the range's only word.
    """
    size = np.fromiter(map(len, queries), np.int64, len(queries))
    at = _points(queries, max(int(size.max()), max(map(len, listed))) + 2)
    rows = [(np.arange(len(queries)), np.full(len(queries), 1, np.int8), np.zeros(len(queries), np.int8), np.where(size > shared, 1, _FAR).astype(np.int8))]
    before, closed = listed[0][:shared], None
    for k, word in enumerate(listed):
        depth, most = shared, min(len(before), len(word))
        while depth < most and before[depth] == word[depth]:
            depth += 1
        before = word
        if closed is not None and depth >= closed:
            continue
        closed = None
        del rows[depth - shared + 1 :]
        for i in range(depth, len(word)):
            who, a, b, c = rows[-1]
            code = ord(word[i])
            new_a = np.minimum(b + 1, a + (at[i - 1][who] != code)) if i else b + 1
            new_b = np.minimum(np.minimum(c, new_a) + 1, b + (at[i][who] != code))
            new_c = np.minimum(new_b + 1, c + (at[i + 1][who] != code))
            left = size[who]
            new_b[left < i + 1] = _FAR
            new_c[left < i + 2] = _FAR
            live = np.flatnonzero((new_a <= 1) | (new_b <= 1) | (new_c <= 1))
            rows.append((who[live], new_a[live], new_b[live], new_c[live]))
            if not len(live) or (same and len(live) == 1):
                closed = i + 1
                break
        else:
            who, a, b, c = rows[len(word) - shared]
            longer = size[who] - len(word)
            hits = who[((longer == -1) & (a == 1)) | ((longer == 0) & (b == 1)) | ((longer == 1) & (c == 1))]
            if len(hits):
                yield k, hits


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best): partial results of the meetings, whose rows come sorted by key, salt, role and spelling."""

    def meeting(key: str, rows: list[tuple[int, str, int]]) -> list[tuple[str, int, int, str]]:
        from_behind, half = key[0] == "1", len(key) - 1
        cut = next((i for i, r in enumerate(rows) if r[0] == PASSING), len(rows))
        held, passing = rows[:cut], rows[cut:]
        found: dict[str, list] = {}
        for queries, same in ((held, True), (passing, False)):
            if not queries or not held or (same and (held[0][0] == HELD or len(held) < 2)):
                continue
            for i, near in scan([w for _, w, _ in held], [w for _, w, _ in queries], half, same):
                _, word, n = held[i]
                for q in near.tolist():
                    other = queries[q][1]
                    # each pair counts in one group: that of half its shorter word, by the beginning if that is shared
                    if min(len(word), len(other)) // 2 != half or (from_behind and word[-half:] == other[-half:]):
                        continue
                    rank = (-n, word[::-1] if from_behind else word)
                    if (mine := found.get(other)) is None:
                        found[other] = [1, rank]
                    else:
                        mine[0] += 1
                        mine[1] = min(mine[1], rank)
        return [(w[::-1] if from_behind else w, k, -rank[0], rank[1]) for w, (k, rank) in found.items()]

    at, rows = None, []
    for batch in batches:
        out = []
        for key, salt, role, word, n in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if (key, salt) != at:
                if len(rows) > 1:
                    out += meeting(at[0], rows)
                at, rows = (key, salt), []
            rows.append((role, word, n))
        yield _near_rows(out)
    yield _near_rows(meeting(at[0], rows) if len(rows) > 1 else [])


def _near_rows(out: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    words, counts, ns, forms = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.record_batch([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(ns, pa.int64()), pa.array(forms, pa.string())], ["word", "k", "best_n", "best"])


def near_words(words: DataFrame, block: int = 2000) -> DataFrame:
    """(word, n_near, best_n, best): for the words with near ones their number and the commonest (ties: the smallest)."""
    halves = F.array_distinct(F.array(F.floor(F.length("word") / 2), F.floor((F.length("word") - 1) / 2)).cast("array<int>"))
    each = words.where(F.length("word") > 1).withColumn("half", F.explode(halves)).where("half > 0").withColumn("side", F.explode(F.array(F.lit("0"), F.lit("1"))))
    spelled = F.when(F.col("side") == "0", F.col("word")).otherwise(F.reverse("word"))
    entries = each.withColumn("spelled", spelled).select(F.concat("side", F.expr("left(spelled, half)")).alias("key"), "spelled", "n", F.lit(0).alias("role"))
    met = dealt(entries, ["key"], "spelled", block).select("key", "salt", "role", "spelled", "n")
    found = met.mapInArrow(_near, "word string, k long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.m")).alias("best_n"), F.col("f.w").alias("best"))


def group_variants(docs: DataFrame, every: int = 97, shortest: int = 5, rarest: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word, the commoner one it is a variant of, and where forms end."""
    if shortest < 4:
        raise ValueError("words of fewer than four code points have no halves to meet by")
    words = keep(vocabulary(docs, every, shortest, rarest), "words")
    led = F.col("best_n") >= times * F.col("n")
    formed = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n"))
    formed = keep(formed, "forms")
    # each round doubles the steps along forms; a word without one is its own root
    led_on = formed.where("form is not null")
    to = keep(led_on.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(to.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        to = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return formed.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
