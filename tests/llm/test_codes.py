import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gavelyard.llm import codes, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(5, "hello world"), (1, None), (9, ""), (3, "a b c " * 900), (7, "ünï code\n\nlines"), (2, "x"), (2, "x"), (None, "none")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=2000))
def test_any_id_is_read_alone(values):
    segment = codes.Segment(codes.encode(np.array(values, dtype=np.uint32)))
    assert segment.all().tolist() == values
    assert [segment.get(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        segment.get(len(values))


def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return {(d, x): [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in ROWS}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_files_read_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as part", "2 as seq")
    path = str(tmp_path / "ids")
    codes.write_ids(df, PATH, path, partitions=3, segment_ids=50)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in codes.read_ids(spark, path).collect())
    want, start, ids = [], 0, whole()
    for d, x in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        n = len(ids[d, x])
        want.append((d if d is not None else -1, start, n, crc(ids[d, x])))
        start += n
    assert got == sorted(want)
    for r in codes.read_ids(spark, path).collect():
        assert r.middle_id in {ids[d, x][len(ids[d, x]) // 2] for d, x in ROWS if d == r.doc_id}
    # single ids, wherever they lie
    asked = [(d, k) for d in (1, 2, 3, 5, 7, 9, 77, None) for k in (-1, 0, 1, 2, 899, 2700, 5000)]
    seen = codes.ids_at(spark, path, spark.createDataFrame(asked, "doc_id long, nth long"), most=3).collect()
    each = [(d, k, ids[d, x][k]) for d, x in ROWS if d is not None for k in {k for _, k in asked} if 0 <= k < len(ids[d, x])]
    assert sorted((r.doc_id, r.nth, r.id) for r in seen) == sorted(each)
    codes.write_ids(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "none"))
    assert codes.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_packing(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as length")
    ids, capacity = whole(), 64
    rows = packing.pack(df, PATH, capacity=capacity).collect()
    want = sorted((d if d is not None else -1, k, s, n, crc(x[s : s + n])) for (d, _), x in [((d, t), ids[d, t]) for d, t in ROWS] for k, (s, n) in enumerate(packing.cut(len(x), capacity)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= capacity
    assert len(bins) == -(-sum(r.length for r in rows) // capacity)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def brute_bins(lengths, capacity):
    """Fill of each bin: pieces longest first, each into the open bin after which the squared counts sum least."""
    fills = []
    for n in sorted(lengths, reverse=True):
        fitting = {capacity - f for f in fills if capacity - f >= n}
        if not fitting:
            fills.append(n)
            continue

        def total(gap):
            left = [capacity - f for f in fills]
            left.remove(gap)
            counts = Counter(x for x in [*left, gap - n] if x)
            return sum(c * c for c in counts.values())

        best = min(fitting, key=lambda g: (total(g), g))
        fills[fills.index(capacity - best)] += n
    return sorted(fills)


def test_packing_equals_brute_force(spark):
    """A whole table through the operator: the bins are as full as one placed by hand."""
    rng = random.Random(12)
    df = spark.createDataFrame([(k, "a " * rng.choice((3, 9, 20, 40, 55, 61))) for k in range(250)], "doc_id long, text string")
    rows = packing.pack(df, PATH, capacity=64).collect()
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert sorted(fills.values()) == brute_bins([r.length for r in rows], 64)


def test_cut_and_sum_of_squares():
    assert packing.cut(1, 10) == [(0, 1)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]
    lengths = np.sort(np.random.default_rng(2).integers(1, 100, 4000))[::-1]
    where, offset = packing.sum_of_squares(lengths, 100)
    fill = np.bincount(where, weights=lengths)
    assert fill.max() <= 100 and len(fill) <= 1.01 * lengths.sum() / 100 + 1
    for b in range(50):
        order = np.argsort(offset[where == b])
        assert (np.cumsum(lengths[where == b][order])[:-1] == offset[where == b][order][1:]).all()
