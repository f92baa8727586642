"""Near-duplicate documents by SimHash fingerprints and the generalised pigeonhole principle.

Two 64-bit fingerprints that differ in at most t bits, with the bits divided into parts and each part given a threshold
of -1 or more such that sum(threshold + 1) = t + 1, differ within the threshold in one part at least. Bits that go
together are put into one part, so that the others tell texts apart better; parts and thresholds are chosen by the
expected cost: rows for probes (all values within the threshold of a part are looked up), and pairs that meet there. The
number of pairs comes from exact counts of all fingerprints: the XOR autocorrelation of a 16-bit part's histogram says how
many pairs differ by each mask, and wider parts are put together from those as if independent. The estimate decides
the cost alone; any choice finds every link.

Equal fingerprints are one node (grouped with partial counts, so thousands of copies are one row). Fingerprints meet by
(part, value); small groups are compared at once, large ones in blocks (`groups.dealt`). Every comparison is on all 64 bits,
and a meeting puts out only links that join what was still apart there, never its pairs.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked like any other. A text
of fewer words than the shingle width has one shingle, of all its words. Rows that repeat a doc_id are scored each; a null
doc_id is kept and is nobody's smallest (component_id is null where no other row is reached). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected
from .groups import PASSING, dealt
from .storage import keep

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What a row that probes costs, in comparisons of two fingerprints.
PROBE = 1000.0
_HASHES = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of UTF-8 bytes: a bit is 1 if it is set in over half of the shingles' XXH64 digests."""
    words = text.translate(_LOWER).split()  # bytes split at 0x20 and 0x09-0x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, ends = np.concatenate(([0], ends[:-1])), ends - 1
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _HASHES):
        a, b = starts[at : min(n, at + _HASHES)].tolist(), ends[at + width - 1 : min(n, at + _HASHES) + width - 1].tolist()
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _sign(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.fromiter((fingerprint(texts[i].as_py() or b"", width, seed) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "f"])

    return run


def _bits(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _column(batch: pa.RecordBatch, k: int = 0) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64)


def part_value(f: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part, gathered into the low bits of a number."""
    out = np.zeros(len(f), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((f >> _U(b)) & _U(1)) << _U(k)
    return out


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((64, 64)), 0
    for batch in batches:
        bits = _bits(_column(batch)).astype(np.float64)
        total, n = total + bits.T @ bits, n + len(bits)
    if n:
        a, b = np.divmod(np.arange(64 * 64), 64)
        yield pa.record_batch([pa.array(np.append(a, -1), pa.int64()), pa.array(np.append(b, -1), pa.int64()), pa.array(np.append(total.reshape(-1), n).astype(np.int64))], ["a", "b", "n"])


def correlated_order(both: np.ndarray, n: int, group: int = 8) -> list[list[int]]:
    """Groups of bits: each starts with the most correlated free pair and takes the bit that goes best with it."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, -1)
    free, out = set(range(len(p))), []
    while free:
        left = sorted(free)
        a, b = np.unravel_index(np.argmax(related[np.ix_(left, left)]), (len(left), len(left)))
        own = [left[a], left[b]] if a != b else [left[a]]
        free -= set(own)
        while len(own) < group and free:
            best = max(sorted(free), key=lambda x: related[x, own].mean())
            own.append(best)
            free.remove(best)
        out.append(own)
    return out


def _histograms(parts: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(p), dtype=np.int64) for p in parts]
        for batch in batches:
            f = _column(batch)
            for c, p in zip(counts, parts, strict=True):
                c += np.bincount(part_value(f, p).astype(np.int64), minlength=len(c))
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at])], ["part", "value", "n"])

    return run


def pairs_by_distance(histogram: np.ndarray) -> np.ndarray:
    """How many ordered pairs differ in k bits, for all k: the XOR autocorrelation, by a Walsh-Hadamard transform."""
    x, width = histogram.astype(np.float64), len(histogram).bit_length() - 1
    for k in range(width):
        x = x.reshape(-1, 2, 1 << k)
        x = np.stack((x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]), axis=1)
    x = x.reshape(-1) ** 2
    for k in range(width):
        x = x.reshape(-1, 2, 1 << k)
        x = np.stack((x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]), axis=1)
    differ = np.bitwise_count(np.arange(len(histogram)))
    return np.bincount(differ, weights=np.maximum(x.reshape(-1) / len(histogram), 0), minlength=width + 1)


def thresholds(cost: list[list[float]], within: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(threshold + 1) = within + 1; cost[i][t + 1] is that of part i at t. By dynamic programming."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * (within + 1)
    for of in cost:
        after: list[tuple[float, list[int]] | None] = [None] * (within + 2)
        for spent, so_far in enumerate(best):
            if so_far is None:
                continue
            for t, c in enumerate(of):
                if spent + t <= within + 1 and ((old := after[spent + t]) is None or so_far[0] + c < old[0]):
                    after[spent + t] = (so_far[0] + c, [*so_far[1], t - 1])
        best = after
    if best[-1] is None:
        raise ValueError("these parts cannot hold such a distance")
    return best[-1]


def plan(fingerprints: DataFrame, within: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to be searched, from exact counts over all fingerprints.

    The driver gets 64 x 64 counts and four histograms of 2**16 values, whatever the input.
    """
    counted = {(r.a, r.b): r.n for r in fingerprints.select("f").mapInArrow(_both, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    if not counted:
        return [(list(range(64)), within)]
    n = counted.pop((-1, -1))
    eights = correlated_order(np.array([[counted[a, b] for b in range(64)] for a in range(64)], dtype=np.float64), n)
    quarters = [eights[i] + eights[i + 1] for i in range(0, 8, 2)]
    histogram = np.zeros((4, 1 << 16))
    found = fingerprints.select("f").mapInArrow(_histograms(quarters), "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    histogram[found["part"], found["value"]] = found["n"]
    share = lambda h: pairs_by_distance(h) / float(n) ** 2
    sixteen = [share(h) for h in histogram]
    eight = [share(h.reshape(256, 256).sum(axis=axis)) for h in histogram for axis in (0, 1)]  # the first eight bits are the low ones
    q, e = lambda i: (quarters[i], sixteen[i]), lambda i: (eights[i], eight[i])
    schemes = [[[q(0), q(1)], [q(2), q(3)]], [[q(0), e(4)], [q(1), e(5)], [q(3)]], [[q(i)] for i in range(4)], [[e(i)] for i in range(8)]]
    choices = []
    for scheme in schemes:
        parts, cost = [], []
        for units in scheme:
            bits, chance = [b for own, _ in units for b in own], np.ones(1)
            for _, own in units:
                chance = np.convolve(chance, own)
            parts.append(bits)
            probes = np.cumsum([0.5 * math.comb(len(bits), r) if r else 1.0 for r in range(within + 1)])
            cost.append([0.0, *(n * PROBE * probes + 0.5 * float(n) ** 2 * np.cumsum(chance)[: within + 1])])
        price, given = thresholds(cost, within)
        choices.append((price, [(p, t) for p, t in zip(parts, given, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _entries(parts: list[tuple[list[int], int]]):
    """A fingerprint's own value in every part, and the values to look up: of two that differ, the one with the lowest differing bit set asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _column(batch)
            for k, (bits, t) in enumerate(parts):
                value = part_value(f, bits)
                for r in range(t + 1):
                    for mask in combinations(range(len(bits)), r):
                        flip = _U(sum(1 << m for m in mask))
                        own = slice(None) if not r else np.flatnonzero((value >> _U(mask[0])) & _U(1))
                        out = (value[own] ^ flip).view(np.int64)
                        yield pa.record_batch([pa.array(np.full(len(out), k), pa.int32()), pa.array(out), pa.array(np.full(len(out), PASSING if r else 0), pa.int32()), pa.array(f[own].view(np.int64))], ["part", "value", "role", "f"])

    return run


def joining(held: np.ndarray, passing: np.ndarray, whole: bool, within: int) -> list[tuple[int, int]]:
    """Links among `held` (if `whole`) and of `passing` with `held`: enough to join all that links join, a few for each row."""
    found: list[tuple[int, int]] = []
    if not len(held):
        return found
    label = np.arange(len(held))
    near = lambda x: np.flatnonzero(np.bitwise_count(held ^ x) <= within)

    def join(x: np.uint64, at: np.ndarray) -> None:
        """`x` with the first near row of each label there; these labels become one."""
        roots, first = np.unique(label[at], return_index=True)
        found.extend((int(x), int(held[k])) for k in at[first] if held[k] != x)
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]

    if whole and len(held) > 1 and (len(held) > 64 or np.count_nonzero(np.bitwise_count(held[:, None] ^ held[None, :]) <= within) > len(held)):
        for x in held:
            if len(at := near(x)) > 1 and (label[at] != label[at[0]]).any():
                join(x, at)
    for x in passing:
        if len(at := near(x)):
            join(x, at)
    return found


def _meet(within: int):
    def links(key: np.ndarray, role: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
        edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                cut = a + int(np.searchsorted(role[a:b], PASSING))
                out += joining(f[a:cut], f[cut:b], bool(role[a] == 0), within)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            pairs = np.array(links(*(np.concatenate(x) for x in zip(*wait, strict=True))), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 4)], axis=1)
            role, f = batch.column(2).to_numpy(), _column(batch, 3)
            # the last group may go on in the next batch
            last = len(key) - int(np.argmax(np.append((key[::-1] != key[-1]).any(axis=1), True)))
            if wait and (key[0] == wait[-1][0][-1]).all() and last == 0:
                wait.append((key, role, f))
                continue
            wait.append((key[:last], role[:last], f[:last]))
            yield done()
            wait = [(key[last:], role[last:], f[last:])]
        if wait:
            yield done()

    return run


def near_duplicates(docs: DataFrame, width: int = 3, within: int = 3, seed: int = 42, block: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents tied by a chain of fingerprints that differ in `within` bits or fewer."""
    signed = keep(docs.select("doc_id", "text").mapInArrow(_sign(width, seed), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f long"), "fingerprints")
    classes = keep(signed.groupBy("f").agg(F.min("doc_id").alias("first")), "classes")
    entries = classes.select("f").mapInArrow(_entries(plan(classes, within)), "part int, value long, role int, f long")
    met = dealt(entries, ["part", "value"], "f", block).select("part", "value", "role", "f", "salt")
    labels = connected(keep(met.mapInArrow(_meet(within), "a long, b long").distinct(), "links"))
    labels = keep(classes.join(labels.withColumnRenamed("node", "f"), "f", "left").select("f", "first", F.coalesce("component", "f").alias("component")), "labels")
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    named = labels.join(least, "component").select("f", "component_id")
    return signed.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
