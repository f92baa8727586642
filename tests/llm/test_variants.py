"""Whitening, SimHash and spelling variants against brute force."""

import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from gavelyard.llm import simhash, spelling, whitening

WORD = re.compile("[^\x20\x09-\x0D]+")
lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# --- whitening


def whitened_by_hand(vectors):
    """n, sums, and the covariance of distinct vectors, centred before multiplying, in fractions."""
    x = sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors})
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    centred = [[Fraction(v) - Fraction(s, n) for v, s in zip(row, sums, strict=True)] for row in x]
    cov = [[float(sum(r[i] * r[j] for r in centred) / n) for j in range(len(sums))] for i in range(len(sums))]
    return x, n, sums, np.array(cov)


def embeddings(seed=4, n=150, d=6):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1 + k) for k in range(d)] for _ in range(n)]
    return [[v[0] * 0.5 + v[k] for k in range(d)] for v in base]


def test_whitening(spark):
    vectors = embeddings()
    rows = [(i, v, 7) for i, v in enumerate(vectors)] + [(500, vectors[3], 7), (500, vectors[3], 8), (None, vectors[4], 1)]
    odd = [(600, None, 1), (601, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (602, [float("nan")] * 6, 1), (603, [float("inf")] + [0.0] * 5, 1), (604, [], 1), (605, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int").repartition(5)
    got = whitening.whiten(df).collect()
    x, n, sums, cov = whitened_by_hand(vectors)
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert {k[0] for k in by} == {i for i, _, _ in rows} and len(by[500, 1]) == 2
    sign = {}
    for i, v, _ in rows:
        q = [math.floor(256 * float(np.float32(c))) for c in v]
        away = np.array([c - s / n for c, s in zip(q, sums, strict=True)])
        for k, e in enumerate(order, 1):
            r = by[i, k][0]
            assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(q, sums, strict=True))
            assert abs(r.explained - values[e] / cov.trace()) < 1e-12 and r.identity_error < 1e-9
            want = away @ vecs[:, e] / math.sqrt(values[e])
            sign.setdefault(k, 1 if r.whitened * want >= 0 else -1)
            assert abs(sign[k] * r.whitened - want) < 1e-8


def test_whitening_of_flat_and_wide_vectors(spark):
    one = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], one)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], one)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], one)).collect()
    assert len(flat) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(1, 0, None, None, None)}
    wide = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, -0.0])], one)).collect()
    assert len(wide) == 6 and {r.deviation for r in wide if r.vec_id == 1} == {None} and all(r.identity_error < 1e-6 for r in wide)


@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=3, max_size=3), min_size=1, max_size=70), st.booleans())
@settings(max_examples=40, deadline=None)
def test_bit_planes_give_exact_cross_products(rows, small):
    x = np.array([[v % 1000 if small else v for v in r] for r in rows], dtype=np.int64)
    low = [min(c) for c in x.T.tolist()]
    bits = whitening.Ranges(low, [max(c) for c in x.T.tolist()]).bits
    p = whitening.planes(x, np.array(low, dtype=np.int64), bits)
    at = [(i, b) for i, n in enumerate(bits) for b in range(n)]
    found = np.zeros((3, 3), dtype=object)
    for k, (i, a) in enumerate(at):
        for m, (j, b) in enumerate(at):
            found[i, j] += int(np.bitwise_count(p[k] & p[m]).sum()) << (a + b)
    shifted = [[v - s for v, s in zip(r, low, strict=True)] for r in x.tolist()]
    assert (found == np.array([[sum(r[i] * r[j] for r in shifted) for j in range(3)] for i in range(3)], dtype=object)).all()


# --- SimHash


def fingerprint_by_hand(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, within=3):
    """Smallest id reachable, for (id, fingerprint) rows."""
    todo, out = list(range(len(fingerprints))), {}
    while todo:
        group, front = {todo[0]}, [todo[0]]
        while front:
            x = front.pop()
            for y in todo:
                if y not in group and (fingerprints[x][1] ^ fingerprints[y][1]).bit_count() <= within:
                    group.add(y)
                    front.append(y)
        least = min((fingerprints[i][0] for i in group if fingerprints[i][0] is not None), default=None)
        out |= {i: least for i in group}
        todo = [i for i in todo if i not in group]
    return [out[i] for i in range(len(fingerprints))]


def test_simhash(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Äpfel", "ÉTÉ", "x."]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append("\n ".join(base).upper() if rng.random() < 0.3 else "  ".join(base))
    rows = [(1000 - i, t, "en", i) for i, t in enumerate(texts)]
    rows += [(2000, None, "en", 0), (2001, "", "en", 0), (2002, " \t\n", None, 0), (2003, "one two", "en", 0), (2004, "One  TWO", "en", 0), (5, texts[0], "en", 0), (5, texts[9], "en", 0), (None, texts[0], "en", 0), (None, "nobody else says this", "en", 0), (2005, "long words " * 40_000, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, f int")
    want = [(d, fingerprint_by_hand(t)) for d, t, _, _ in rows]
    expected = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(want, components(want), strict=True))
    for block in (4096, 3):  # whole groups, and all divided into blocks and lanes
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df, block=block).collect()) == expected
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [[(list(range(32)), 1), (list(range(32, 64)), 1)], [(list(range(20)), 2), (list(range(20, 64)), 0)], [(list(range(0, 64, 2)), 0), (list(range(1, 64, 2)), 2)], [([*range(k, 64, 4)], 0) for k in range(4)], [(list(range(64)), 3)]])
def test_every_choice_of_parts_finds_every_link(spark, monkeypatch, parts):
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    found = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for s in seeds for _ in range(5)}
    rows = sorted(enumerate(found))
    monkeypatch.setattr(simhash, "plan", lambda f, within: parts)
    monkeypatch.setattr(simhash, "fingerprint", None)  # not used: the table holds fingerprints
    monkeypatch.setattr(simhash, "_sign", lambda width, seed: lambda batches: batches)
    docs = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in rows], "doc_id long, text long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, block=16).collect()}
    assert [got[i] for i, _ in rows] == components(rows)


def test_costs_of_parts():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 256, 500)
    h = np.bincount(values, minlength=256)
    by_hand = np.bincount(np.bitwise_count(values[:, None] ^ values[None, :]).reshape(-1), minlength=9)
    assert np.allclose(simhash.pairs_by_distance(h), by_hand)
    cost = [[0, 5, 9, 30], [0, 1, 2, 40], [0, 100, 200, 300]]
    best = min((sum(c[t] for c, t in zip(cost, ts, strict=True)), ts) for ts in [(a, b, c) for a in range(4) for b in range(4) for c in range(4)] if sum(ts) == 4)
    assert simhash.thresholds([[float(c) for c in x] for x in cost], 3) == (best[0], [t - 1 for t in best[1]])
    both = np.full((8, 8), 250.0)
    np.fill_diagonal(both, 500)
    both[1, 6] = both[6, 1] = 500  # two bits that are always alike
    assert sorted(simhash.correlated_order(both, 1000, 2)[0]) == [1, 6]


# --- spelling


def variants_by_hand(rows):
    """(word, form, root, n, n_near, form_n) by comparing all words with all."""
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: sorted((v for v in words if one_edit(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= 2 * words[w] else None for w in words}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def spelled(rng, n):
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(4, 9))) for _ in range(n)]
    return base + [w[:k] + rng.choice(["", "x", "é", w[k : k + 1] * 2]) + w[k + 1 :] for w in base for k in rng.sample(range(len(w)), 3)]


def test_spelling(spark):
    rng = random.Random(21)
    words = spelled(rng, 60)
    weight = [rng.choice([1, 1, 2, 5, 30]) for _ in words]
    rows = [(i, rng.choice([" ", ", ", "ő", "1"]).join(rng.choices(words, weight, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(i, "Wasser WASSER ".upper() + "naïve " * 3) for i in range(200, 420)]  # some of these lose a code point
    rows += [(500, None), (501, ""), (502, "12 __ 日本"), (None, "wasser"), (None, "wassér wassér wassér"), (7, rows[7][1]), (503, "abcdefgh " * 30_000)]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    want = variants_by_hand(rows)
    assert any(f and f != r for _, f, r, _, _, _ in want)  # chains of forms do occur
    for block in (2000, 2):
        words = spelling.vocabulary(df)
        near = {r.word: r for r in spelling.near_words(words, block).collect()}
        assert {w: (k, near[w].n_near if w in near else 0) for w, _, _, _, k, _ in want} == {w: (k, k) for w, _, _, _, k, _ in want}
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.group_variants(df).collect())
    assert got == want
    assert spelling.group_variants(df.limit(0)).count() == 0 and spelling.group_variants(df.where("doc_id = 502")).count() == 0


@given(st.lists(st.text("abé", min_size=2, max_size=7), min_size=1, max_size=25, unique=True), st.lists(st.text("abé", min_size=2, max_size=7), min_size=1, max_size=25, unique=True))
@settings(max_examples=150, deadline=None)
def test_scan_finds_all_words_one_edit_apart(listed, queries):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    listed = sorted("zz" + w for w in listed)
    for others, same in ((listed, True), (["zz" + w for w in queries], False)):
        got = {(listed[k], others[q]) for k, near in spelling.scan(listed, others, 2, same) for q in near}
        assert got == {(a, b) for a in listed for b in others if distance(a, b) == 1}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_simhash", "op13_spelling"])
def test_results_equal_their_sql(spark, name):
    import duckdb

    from gavelyard.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = queries.queries()[name](spark, data)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
