"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

An entry c becomes the integer floor(256 * c). Every dimension is shifted by its least value, so its integers are
unsigned and need only as many bits as the dimension's range; each bit of each dimension is packed across the rows of a
block into 64-bit words (a bit plane). The cross product of two dimensions is then a sum of popcounts of the planes'
conjunctions, weighted by powers of two: exact, and the same whatever the rows' order or partitions. Partial sums are
added up by Spark as whole numbers; only the matrix, whose size is the vectors' width squared, reaches the driver. It is
centred as integers (n * sum(x * y) - sum(x) * sum(y); a shift changes nothing) before the one division that makes it
floating point, and goes to a symmetric eigensolver.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are vectors of
another length than the most common one (of equally common lengths the larger); entries beyond the range of a long
take its ends. Rows that repeat each get their result; the fit list holds each distinct vector once; a null vec_id is kept. Directions
without variance (one distinct vector, constant dimensions) have eigenvalue 0: their `whitened` is null, and `explained`
is null where nothing varies at all. A `deviation` that exceeds a long is null. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import keep

#: Rows per block of bit planes, a multiple of 64.
BLOCK = 4096
_PART = 96
_U = np.uint64


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): the vectors as whole numbers, without the rows that hold none."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0))
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


@dataclass
class Ranges:
    """The least and greatest value of every dimension."""

    low: list[int]
    high: list[int]

    @property
    def bits(self) -> list[int]:
        return [(h - s).bit_length() for s, h in zip(self.low, self.high, strict=True)]


def ranges(x: DataFrame) -> Ranges | None:
    """Of the most common length; the driver gets a row per dimension."""
    per_length = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = per_length.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not top:
        return None
    each = x.where(F.size("x") == top[0].d).select(F.posexplode("x").alias("i", "v"))
    ends = each.groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("i").collect()
    return Ranges([r.low for r in ends], [r.high for r in ends])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64, copy=False)


def planes(x: np.ndarray, low: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of shifted rows, one row of 64-bit words per (dimension, bit), by dimension and then by bit."""
    shifted = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), dtype=np.uint64)
    shifted[: len(x)] = x.view(np.uint64) - low.view(np.uint64)  # modulo 2**64, where a difference of longs always fits
    by_bit = [np.packbits(((shifted >> _U(b)) & _U(1)).astype(np.uint8), axis=0, bitorder="little").T for b in range(max(bits, default=0))]
    rows = [by_bit[b][i] for i, n in enumerate(bits) for b in range(n)]
    return np.ascontiguousarray(np.stack(rows)).view(np.uint64) if rows else np.zeros((0, len(shifted) // 64), dtype=np.uint64)


def _scatter(spread: Ranges):
    bits, low = spread.bits, np.array(spread.low, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros((sum(bits), sum(bits)), dtype=np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            n += len(x)
            for at in range(0, len(x), BLOCK):
                p = planes(x[at : at + BLOCK], low, bits)
                for k in range(len(p)):
                    count[k, k:] += np.bitwise_count(p[k] & p[k:]).sum(axis=1, dtype=np.int64)
        if not n:
            return
        found = [(-1, -1, n)]
        wide = [i for i, b in enumerate(bits) if b]
        if wide:
            weight = np.array([1 << b for m in bits for b in range(m)], dtype=object)
            count = np.triu(count) + np.triu(count, 1).T
            first = np.cumsum([0, *(bits[i] for i in wide[:-1])])
            total = np.add.reduceat(np.add.reduceat(count.astype(object) * weight[:, None] * weight[None, :], first, axis=0), first, axis=1)
            sums = np.add.reduceat(np.diag(count).astype(object) * weight, first)
            found += [(-1, i, s) for i, s in zip(wide, sums, strict=True)]
            found += [(i, j, total[a, b]) for a, i in enumerate(wide) for b, j in enumerate(wide) if i <= j]
        whole = lambda v: pa.array([Decimal(int(x)) for x in v], pa.decimal128(38, 0))
        halves = [divmod(int(v), 1 << _PART) for _, _, v in found]
        yield pa.record_batch(
            [pa.array([i for i, _, _ in found], pa.int32()), pa.array([j for _, j, _ in found], pa.int32()), whole([h for h, _ in halves]), whole([s for _, s in halves])], ["i", "j", "high", "low"]
        )

    return run


@dataclass
class Whitening:
    """n, the exact sums per dimension, unit eigenvectors as columns, their eigenvalues (null where 0) and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: list[float | None]
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        scale = np.array([np.nan if e is None else 1 / np.sqrt(e) for e in self.values])
        return (x - mean) @ self.vectors * scale


def fit(distinct: DataFrame, spread: Ranges, components: int = 4) -> Whitening:
    """From a table of distinct vectors `x`; what reaches the driver has the width of the vectors squared."""
    sums = distinct.select("x").mapInArrow(_scatter(spread), "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = {(r.i, r.j): (int(r.high) << _PART) + int(r.low) for r in sums.collect()}
    n, d = found[-1, -1], len(spread.low)
    shifted = [found.get((-1, i), 0) for i in range(d)]
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (n * found.get((i, j), 0) - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    least = d * np.finfo(float).eps * max(values[-1], 0.0)
    top = [float(values[k]) if values[k] > least else None for k in order]
    return Whitening(n, [s + n * m for s, m in zip(shifted, spread.low, strict=True)], vectors[:, order], top, float(np.trace(cov)))


def _identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, measured over the rows themselves."""
    good = [k for k, e in enumerate(model.values) if e is not None]
    if not good:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.project(_matrix(batch.column(0)))
            yield pa.record_batch([pa.array(w[:, k]) for k in good], [f"w{k}" for k in good])

    white = distinct.select("x").mapInArrow(run, ", ".join(f"w{k} double" for k in good))
    row = white.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in good for b in good if a <= b]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a in good for b in good if a <= b)


def _rows(model: Whitening, spread: Ranges, error: float | None):
    furthest = [max(abs(model.n * v - s) for v in ends) for *ends, s in zip(spread.low, spread.high, model.sums, strict=True)]
    fits = sum(f * f for f in furthest) < 2**63
    k = len(model.values)
    explained = [None if not model.trace else (e or 0.0) / model.trace for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, dtype=np.int64 if fits else object)
        for batch in batches:
            x = _matrix(batch.column(1))
            away = (model.n * x if fits else model.n * x.astype(object)) - sums
            squares = (away * away).sum(axis=1)
            deviation = pa.array([None if v >= 2**63 else int(v) for v in squares] if not fits else squares, pa.int64())
            each = np.repeat(np.arange(len(x)), k)
            white = model.project(x).reshape(-1)
            same = lambda values, kind: pa.array(values * len(x), kind)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(each)), same(list(range(1, k + 1)), pa.int32()), same([model.n] * k, pa.int64()), deviation.take(pa.array(each)), pa.array(white, mask=np.isnan(white)),
                 same(explained, pa.float64()), same([error] * k, pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row on the leading components."""
    x = quantised(rows, scale)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spread = ranges(x)
    if spread is None:
        return rows.sparkSession.createDataFrame([], schema)
    x = x.where(F.size("x") == len(spread.low))
    distinct = keep(x.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, spread, components)
    return x.select("vec_id", "x").mapInArrow(_rows(model, spread, _identity_error(distinct, model)), schema)
