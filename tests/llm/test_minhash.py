import random
import re

import numpy as np

from gavelyard.llm import minhash
from gavelyard.llm.bytesets import blocks, shingle_sets

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(rows, width, percent):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for f in range(n // 25):
        base = [rng.choice(words) for _ in range(rng.choice((3, 6, 12, 60, 90)))]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 7))):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t).upper() if rng.random() < 0.1 else "\n".join(t) if rng.random() < 0.1 else " ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


def check(spark, rows, width, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=width, **more).collect()}
    assert got == brute(rows, width, 80)


def test_equals_brute_force(spark):
    check(spark, corpus(500, 1), 2)
    check(spark, corpus(300, 2), 5, block=7)
    check(spark, corpus(300, 2), 2, block=3, most_blocks=1)  # larger families meet by their rare shingles


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a b c"), (9, "é ü"), (10, "É ü"), (11, "x " * 5000), (12, "x " * 7000)]
    check(spark, rows, 2)


def test_words_of_one_polynomial_differ(spark):
    """Two words that a polynomial modulo 2^64 can't tell apart, whatever its base, and long words that differ at one place."""
    from .test_texts import thue_morse

    a, b = thue_morse()
    check(spark, [(1, a), (2, b), (3, a), (4, f"{a} {a}"), (5, f"{a} {b}"), (6, "z" * 3000), (7, "z" * 2999 + "y"), (8, "z" * 96), (9, "z" * 97)], 2)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)], SCHEMA).selectExpr("*", "text as `Text2`", "1 as bucket", "2 as component")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=2).collect())
    assert got == [(-1, 3, None, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slots_follow_jaccard():
    import pyarrow as pa

    words = [f"t{k}" for k in range(240)]
    a, b = " ".join(words[:200]), " ".join(words[40:])
    block = next(blocks(pa.array([a, b, "x", ""])))
    sets = shingle_sets(block, 1)
    sig = minhash.signatures(sets, 512)
    exact = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.06
    assert len(set((sig[2] >> np.uint64(56)).tolist())) > 100  # one element fills each slot in a round of its own
    assert (sig[3] == np.iinfo(np.uint64).max).all()
