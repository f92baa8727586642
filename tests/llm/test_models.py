"""Learned operators: the grammar's machines against path enumeration, held-out accuracy, an ablation, the ranker by hand."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gavelyard.llm import ranker, toxicity
from gavelyard.llm.transducers import Machine, compose, machine

DATA = "/root/testdata"
needs_data = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables")


# -- transducers -------------------------------------------------------------------------------------------------
def paths(m: Machine, symbols, state=None, depth=0):
    """(what is written, events) of every accepted path, one arc at a time."""
    state = m.start if depth == 0 else state
    if depth == len(symbols):
        if state in m.finals:
            yield (), ()
        return
    for out, events, onward in m.arcs.get((state, symbols[depth]), ()):
        for rest, more in paths(m, symbols, onward, depth + 1):
            yield (out, *rest), (*events, *more)


def cascade(parts, symbols):
    """Events of every way through the machines, one after the other, without composing them."""
    if not parts:
        yield ()
        return
    for written, events in paths(parts[0], symbols):
        for more in cascade(parts[1:], written):
            yield (*events, *more)


PARTS = (toxicity.negation(), toxicity.reported_speech(), toxicity.target(), toxicity.threat(), toxicity.insult())


def test_composition_equals_the_cascade():
    rng, weights, whole = random.Random(3), toxicity.stated_weights(), toxicity.grammar_machine()
    assert set(weights) >= {e for arcs in whole.arcs.values() for _, events, _ in arcs for e in events}
    for n in [*([k] * 60 for k in range(1, 8))]:
        for k in n:
            symbols = [rng.choice("ooonrqqthis") for _ in range(k)]
            values = [sum(weights[e] for e in events) for events in cascade(PARTS, symbols)]
            best = whole.best(symbols, weights)
            assert best is not None and math.isclose(best[0], max(values)), symbols
            assert math.isclose(best[0], sum(weights[e] for e in best[1]))


def test_composition_of_any_machines():
    rng = random.Random(9)
    for _ in range(40):
        def any_machine(alphabet, written, tag):
            table = {(s, x): [(rng.choice(written), (tag,) * rng.randint(0, 1), rng.randrange(3)) for _ in range(rng.randint(0, 2))] for s in range(3) for x in alphabet}
            return machine(0, alphabet, lambda s, x: table[s, x], lambda s: s != 1)

        a, b = any_machine("xy", "pq", "A"), any_machine("pq", "uv", "B")
        for symbols in itertools.product("xy", repeat=4):
            one_by_one = Counter((out, tuple(sorted((*e, *f)))) for middle, e in paths(a, symbols) for out, f in paths(b, middle))
            assert Counter((out, tuple(sorted(e))) for out, e in paths(compose(a, b), symbols)) == one_by_one


def paid(text):
    g = toxicity.Grammar({"zork ": "insult", "achli": "slur"})
    found = [g.clause(x)[:2] for x, _ in g.clauses(text) if x]
    return [round(a, 3) for a, _ in found], [b for _, b in found]


def test_clauses():
    assert paid("a plain text.") == ([], []) and paid("") == ([], [])
    assert paid("such an idiot. fine")[0] == [2.0]
    assert paid("you are an idiot")[0] == [2.5] and paid("idiot, you!")[0] == [2.5]
    assert paid("an idiot and a moron")[0] == [4.5] and paid("an idiot. a moron")[0] == [2.0, 2.0]
    assert paid("not an idiot")[0] == [0.5] and paid("not that it was in any way an idiot")[0] == [2.0]
    assert paid('he said "idiot"')[0] == [1.0] and paid('"you idiot", he wrote')[0] == [1.25]
    assert paid('a 5" pipe, you idiot')[0] == [2.5] and paid('a 5" pipe. you idiot')[0] == [2.5]  # a lone mark quotes nothing
    assert paid("I will kill you")[0] == [2.0] and paid("I will kill time")[0] == [0.0] and paid("never kill you")[0] == [0.5]
    assert paid("you said they would hurt you")[0] == [1.0]
    assert paid("ZORK$$$ zorks") == ([2.0], [0]) and paid("achlichber")[1] == [2.0]


# -- held out ----------------------------------------------------------------------------------------------------
def accuracy(rows, labels, name):
    right = {}
    for r in rows:
        if r.held_out and r.doc_id in labels:
            right.setdefault(labels[r.doc_id][name], []).append(r.predicted)
    return np.mean(right[1]), 1 - np.mean(right[0])


@needs_data
def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r for r in labels.collect()}
    toxic = toxicity.score_toxicity(docs, labels).collect()
    quality = ranker.score_quality(docs, labels).collect()
    assert len(toxic) == len(quality) == docs.count()
    for r in toxic + quality:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    recall, clean = accuracy(toxic, known, "toxic")
    assert recall >= 0.6 and clean >= 0.98
    recall, junk = accuracy(quality, known, "quality")
    assert recall >= 0.97 and junk >= 0.9


PLANTED = [  # (toxic, text)
    (1, "You are an idiot. Go away."), (0, "He is not an idiot. Go away."), (0, 'The judge wrote: "idiot" is an insult.'), (1, "I will hurt you badly."),
    (0, "We never hurt you."), (0, "Nobody said you were a fool."), (1, "You fool, you."), (0, "They beat the egg whites."), (1, "We beat you up."), (0, 'Critics called it "pathetic" and "stupid".'),
]


@needs_data
def test_the_grammar_beats_a_bag_of_its_words(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    g = toxicity.Grammar(model.stems, model.weights)
    words = set(" ".join(toxicity.SEED[k] for k in ("insult", "threat")).split())
    scored = [(y, g.features(t)[0], sum(w in words for w in re.findall("[a-z]+", t.lower())) / len(t.split())) for y, t in PLANTED]
    ordered = lambda k: np.mean([(a[k] > b[k]) + 0.5 * (a[k] == b[k]) for a in scored for b in scored if a[0] > b[0]])
    assert ordered(1) >= 0.95 > ordered(2) + 0.1
    # on held-out rows, where hardly an insult is denied or reported, it finds no less
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(known[r.doc_id], r.text) for r in docs.collect() if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    got = model.score(np.array([g.features(t) for _, t in rows])) >= 0.7
    bag = np.array([any(g.symbols[w] in "ih" for w in re.findall(r"[^\W\d_]+", t.lower())) for _, t in rows])
    y = np.array([v for v, _ in rows])
    assert (got == y).sum() >= (bag == y).sum()


def test_weights_are_drawn_to_what_is_stated():
    stated = toxicity.stated_weights()
    none = toxicity.learn_weights(np.zeros((50, len(stated))), np.array([0.0, 1.0] * 25))
    assert all(math.isclose(none[e], w, abs_tol=1e-6) for e, w in stated.items())
    x = np.zeros((400, len(stated)))
    at = list(stated).index("insult")
    x[:200, at] = 3
    learned = toxicity.learn_weights(x, np.array([1.0] * 200 + [0.0] * 200))
    useless = toxicity.learn_weights(x, np.array([1.0, 0.0] * 200))
    assert learned["insult"] > useless["insult"] and learned["threat-"] == pytest.approx(stated["threat-"], abs=1e-6)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "you idiot"), (3, "word " * 50_000)], "doc_id long, text string").selectExpr("*", "1 as score", "2 as y")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()} == {1: 0, None: 0, 2: 1, 3: 0}
        assert ranker.score_quality(docs, labels).count() == 5
        assert toxicity.drop_toxic(docs, labels).count() == 4
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0 and ranker.score_quality(docs.limit(0), none).count() == 0


# -- the ranker by hand ------------------------------------------------------------------------------------------
def by_hand(text):
    """The features of a text, one at a time."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return [0.0] * 12
    n, letters = len(words), max(1, len(re.findall("[A-Za-z]", text)))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    fives = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    again = {i + k for i in range(n - 4) if fives[tuple(words[i : i + 5])] > 1 for k in range(5)}
    rate = lambda chars: min(sum(c in chars for c in text) / n, 3.0)
    return [
        math.log1p(n), min(sum(map(len, words)) / n, 30.0), rate("#*$%&|<>"), rate("|"), rate("!"), rate(".?;:,"), rate("0123456789"), len(re.findall("[A-Z]", text)) / letters,
        (len(lines) - len(set(lines))) / len(lines), len(again) / n, sum(a == b for a, b in itertools.pairwise(words)) / n, math.log1p(n / len(lines)),
    ]


def test_ranker_by_hand(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["alpha", "Beta,", "gamma.", "dé\n", "12"]) for _ in range(rng.randint(1, 60)))
    rows = [(i, plain() if i % 3 else plain().replace(" ", rng.choice([" | ", "$ ", "!!! "])), int(i % 3 > 0)) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = ranker.fit(docs, labels)
    got = {r.doc_id: r.score for r in ranker.score_quality(docs, labels).collect()}
    for d, text, _ in rows:
        x = by_hand(text)
        wide = [*x, *map(math.sqrt, map(abs, x)), *(v * v for v in x)]
        raw = sum(max(-6.0, min(6.0, (v - c) / s)) * w for v, c, s, w in zip(wide, model.centre, model.spread, model.weight, strict=True))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, model.scale * (raw - model.cut))))), abs=1e-6), d
    # the weights are where the mean logistic loss over all preferences, with its ridge, is lowest: moving any of them costs
    x = np.array([by_hand(t) for d, t, _ in rows if zlib.crc32(str(d).encode()) % 3 != 1])
    y = np.array([q for d, _, q in rows if zlib.crc32(str(d).encode()) % 3 != 1])
    z = np.clip((np.hstack((x, np.sqrt(np.abs(x)), x * x)) - model.centre) / model.spread, -6, 6)
    pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    loss = lambda w: np.mean(np.log1p(np.exp(-pairs @ w))) + 0.5e-3 * w @ w
    base = loss(model.weight)
    moved = [loss(model.weight + s * step) for s in (-0.5, 0.5) for step in np.eye(len(model.weight))]
    assert np.mean(np.array(moved) > base) > 0.9 and base < loss(np.zeros(len(model.weight)))
    # the cut is a quantile that agrees with the labels as well as any
    s = z @ model.weight
    agree = lambda c: ((s >= c) == (y == 1)).sum()
    assert agree(model.cut) == max(agree(c) for c in [*s, s.max() + 1])
