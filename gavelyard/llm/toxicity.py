"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to symbols by a lexicon: fixed seed words, and stems learned from labelled documents (whole words
and word starts whose rate in toxic documents is surely many times that in others, whatever the language). Five
transducers (`transducers`) are composed into one, each reading what the one before it writes:

- negation: what an insult or threat within three words after a negation means is marked as denied;
- reported speech: after a reporting verb, and between quotation marks that a reporting verb announces or follows in
  the clause, it is marked as reported; a quotation mark without such a verb changes nothing;
- target: what has an address ("you", "du", "tu", ...) within six words before or four after it is marked as aimed;
- threat: a threat verb pays only where it is aimed;
- insult: insults and slurs pay by their marks, and a further insult that is meant pays once more.

A clause's score is the value of its best path. The weights of the paying arcs are learned: a logistic model on the
events of labelled documents, whose prior means are the stated weights, so what labels say nothing about keeps them.
Scores of clauses, not of isolated words, become the document's features (their sum, the highest one, and rates over
all words and over the densest stretch, so that length does not dilute them), and a second logistic model calibrates
them to 0..1.

Defined cases: null and empty texts have no clause and get the model's score for zero features; without any
labelled row the fixed weights and default model are used; repeated rows are scored alike; very long texts are read
whole; other columns than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import held_out, training_rows
from .storage import keep
from .transducers import Arc, Machine, compose, machine

# Fixed seed words, by class.
SEED = {
    "insult": "idiot idiots moron morons loser losers trash scum clown clowns pathetic stupid worthless disgusting dumb fool imbecile idiotisch dumm dummkopf abschaum versager idiote imbécile débile ordure stupide estúpido imbécil basura inútil",
    "threat": "kill hurt destroy smash beat crush burn punish töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    "target": "you your yours yourself u du dich dein deine ihr euch tu te toi vous ton ta tú ti usted ustedes vosotros",
    "negation": "not no never none nor don't doesn't isn't aren't wasn't nicht kein keine nie pas jamais nunca ningún",
    "report": "said says say wrote writes called claimed reported according quoted sagte schrieb laut dit écrit selon dijo escribió según",
}
STEM_LENGTHS = (5, 6, 7, 8)
FEATURES = ("clauses", "rate", "slur_rate", "many_slurs", "worst_clause", "densest")
DEFAULT_MODEL = (-3.0, 4.0, 0.5, 1.0, 0.0, 0.0, 0.0)
#: Words of a stretch whose rate is looked at by itself.
STRETCH = 40

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n]|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_SYMBOL = {"other": "o", "insult": "i", "slur": "s", "threat": "h", "target": "t", "negation": "n", "report": "r", "quote": "q", "end": "."}
_PAYING = ("h", "i", "s")
_PAYS = re.compile("[his]")
DENIED_WORDS, AIMED_AFTER, AIMED_BEFORE = 3, 6, 4
#: Longer runs of words of no class change nothing: no reach is longer.
_OTHERS = re.compile(f"o{{{AIMED_AFTER + 2},}}")


# -- the five transducers ----------------------------------------------------------------------------------------
def negation() -> Machine:
    """States: words that the last negation still reaches."""

    def step(left: int, x: str) -> list[Arc]:
        if x == "n":
            return [("o", (), DENIED_WORDS)]
        return [(f"{x}-" if x in _PAYING and left else x, (), left if x == "q" else max(left - 1, 0))]

    return machine(0, "onrqthis", step, lambda left: True)


def reported_speech() -> Machine:
    """States: plain; told (a verb came); inside (a quotation announced by it); guessed and owed (a quotation, open or
    closed, whose verb has yet to come); bare and claimed (one, open or closed, for which none may come)."""
    marked = {"told", "inside", "guessed"}
    by_quote = {"plain": ("guessed", "bare"), "told": ("inside",), "inside": ("told",), "guessed": ("owed",), "owed": ("owed",), "bare": ("claimed",), "claimed": ("claimed",)}
    by_verb = {"plain": "told", "told": "told", "inside": "inside", "guessed": "guessed", "owed": "told", "bare": "bare"}

    def step(state: str, x: str) -> list[Arc]:
        if x == "q":
            return [("q", (), onward) for onward in by_quote[state]]
        if x == "r":
            return [("o", (), by_verb[state])] if state in by_verb else []
        return [(f"{x}r" if x[0] in _PAYING and state in marked else x, (), state)]

    return machine("plain", [*"orqt", *_with_marks("", "-")], step, lambda state: state not in ("guessed", "owed"))


def target() -> Machine:
    """States: (words that the last address still reaches, words within which one must come; 0 is none)."""

    def step(state: tuple[int, int], x: str) -> list[Arc]:
        reach, due = state
        if x == "q":
            return [("o", (), state)]
        if x == "t":
            return [("o", (), (AIMED_AFTER, 0))]
        if due == 1:
            return []  # the address that was guessed did not come
        onward = (max(reach - 1, 0), due - 1 if due else 0)
        if x[0] not in _PAYING:
            return [("o", (), onward)]
        if reach:
            return [(f"{x}@", (), onward)]
        return [(x, (), onward), (f"{x}@", (), (0, onward[1] or AIMED_BEFORE + 1))]

    return machine((0, 0), [*"oqt", *_with_marks("", "-", "r", "-r")], step, lambda state: not state[1])


def threat() -> Machine:
    def step(_: int, x: str) -> list[Arc]:
        if x[0] != "h":
            return [(x, (), 0)]
        return [("o", (f"threat{x[1:-1]}",) if x.endswith("@") else (), 0)]

    return machine(0, ["o", *_with_marks(*_MARKS)], step, lambda _: True)


def insult() -> Machine:
    """States: whether the clause had an insult that is neither denied nor reported."""

    def step(had: int, x: str) -> list[Arc]:
        if x[0] == "i":
            meant = not {"-", "r"} & set(x)
            return [("o", (f"insult{x[1:]}", *(("again",) if had and meant else ())), int(had or meant))]
        return [("o", (f"slur{x[1:]}",) if x[0] == "s" else (), had)]

    return machine(0, ["o", *(x for x in _with_marks(*_MARKS) if x[0] != "h")], step, lambda _: True)


_MARKS = tuple(denied + told + aimed for aimed in ("", "@") for told in ("", "r") for denied in ("", "-"))


def _with_marks(*marks: str) -> list[str]:
    return [x + m for x in _PAYING for m in marks]


@cache
def grammar_machine() -> Machine:
    whole = negation()
    for part in (reported_speech(), target(), threat(), insult()):
        whole = compose(whole, part)
    return whole


def stated_weights() -> dict[str, float]:
    """What events pay before anything is learned; a denied one a quarter, a reported one half, an aimed one a quarter more."""
    scaled = lambda m: (0.25 if "-" in m else 1.0) * (0.5 if "r" in m else 1.0) * (1.25 if "@" in m else 1.0)
    out = {f"{kind}{m}": 2.0 * scaled(m) for kind in ("insult", "slur") for m in _MARKS}
    return out | {f"threat{m}": 2.0 * scaled(m) for m in _MARKS if "@" not in m} | {"again": 0.5}


# -- clauses and features ----------------------------------------------------------------------------------------
class _Symbols(dict):
    """Symbol of a lower-case token, worked out on first use: "o" for a word of no class, nothing for a comma or colon."""

    def __init__(self, stems: dict[str, str], most: int = 400_000):
        self.most = most
        self.fixed = {w: _SYMBOL[kind] for kind, words in SEED.items() for w in words.split()}
        self.fixed |= dict.fromkeys(".!?;\n", ".") | dict.fromkeys("\"“”„«»", "q") | {",": "", ":": ""}
        self.stems = {stem: _SYMBOL[kind] for stem, kind in stems.items()}

    def __missing__(self, token: str) -> str:
        if len(self) >= self.most:
            self.clear()
        found = self.fixed.get(token)
        if found is None:
            # the whole word first (marked by a final space), then its longest known start
            tries = (token + " ", *(token[:n] for n in reversed(STEM_LENGTHS) if len(token) >= n))
            found = next((self.stems[k] for k in tries if k in self.stems), "o")
        self[token] = found
        return found


class Grammar:
    """The composed transducer over a lexicon; `stems` maps a word start (or a word and a space) to insult or slur."""

    def __init__(self, stems: dict[str, str], weights: dict[str, float] | None = None):
        self.symbols, self.weights, self.machine = _Symbols(stems), weights or stated_weights(), grammar_machine()
        self.known: dict[str, tuple[float, float, tuple[str, ...]]] = {}

    def clause(self, symbols: str) -> tuple[float, float, tuple[str, ...]]:
        """What the best path pays for insults and threats, what for slurs, and its events."""
        if symbols not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            _, events = self.machine.best(symbols, self.weights) or (0.0, ())
            slurs = sum(self.weights[e] for e in events if e.startswith("slur"))
            self.known[symbols] = sum(self.weights[e] for e in events) - slurs, slurs, events
        return self.known[symbols]

    def clauses(self, text: str | None) -> Iterator[tuple[str | None, int]]:
        """(symbols, words) of each clause; None for a clause in which nothing can pay. Long runs of other words are cut short."""
        said = "".join(map(self.symbols.__getitem__, _TOKEN.findall((text or "").lower())))
        for clause in said.split("."):
            if clause:
                yield _OTHERS.sub("o" * (AIMED_AFTER + 1), clause) if _PAYS.search(clause) else None, len(clause)

    def events(self, text: str | None) -> dict[str, int]:
        out: dict[str, int] = {}
        for symbols, _ in self.clauses(text):
            for e in self.clause(symbols)[2] if symbols else ():
                out[e] = out.get(e, 0) + 1
        return out

    def features(self, text: str | None) -> tuple[float, ...]:
        """One value per name in FEATURES."""
        sure = maybe = worst = densest = 0.0
        n = stretch = 0
        paid = 0.0
        for symbols, words in self.clauses(text):
            n, stretch = n + words, stretch + words
            if symbols:
                a, b, _ = self.clause(symbols)
                sure, maybe, worst, paid = sure + a, maybe + b, max(worst, a), paid + a + b
            if stretch >= STRETCH:
                densest, stretch, paid = max(densest, paid / stretch), 0, 0.0
        densest = max(densest, paid / max(stretch, STRETCH))
        if not n:
            return (0.0,) * len(FEATURES)
        rate = min(100.0 * maybe / max(n, STRETCH), 12.0)
        return float(np.log1p(sure)), min(100.0 * sure / max(n, STRETCH), 20.0), rate, float(rate > 2.0), min(worst, 20.0), min(100.0 * densest, 40.0)


# -- learning ----------------------------------------------------------------------------------------------------
def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, documents, toxic documents, uses, toxic uses) counted within a batch; the empty stem counts all words."""
    for batch in batches:
        counts: dict[str, list[float]] = {}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: dict[str, int] = {}
            words = Counter(_WORD.findall((text or "").lower()))
            for w, n in words.items():
                for key in (w + " ", *(w[:k] for k in STEM_LENGTHS if len(w) >= k)):
                    own[key] = own.get(key, 0) + n
            own[""] = words.total()
            for key, n in own.items():
                at = counts.setdefault(key, [0, 0, 0, 0])
                at[0] += 1
                at[2] += n
                if y > 0:
                    at[1] += 1
                    at[3] += n
        keys = list(counts)
        cols = [pa.array([counts[k][j] for k in keys], pa.int64()) for j in range(4)]
        yield pa.record_batch([pa.array(keys, pa.string()), *cols], ["stem", "docs", "toxic_docs", "uses", "toxic_uses"])


def learn_stems(train: DataFrame, least_ratio: float = 3.0, certainty: float = 2.5) -> dict[str, str]:
    """All stems whose rate in toxic documents is `least_ratio` times that in others, `certainty` deviations sure.

    Each has four toxic training documents or more, whose number is bounded, so the lexicon is bounded too.
    """
    counted = train.select("text", "y").mapInArrow(_stem_rows, "stem string, docs long, toxic_docs long, uses long, toxic_uses long")
    counted = keep(counted.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("docs", "toxic_docs", "uses", "toxic_uses")]), "stems")
    total = counted.where("stem = ''").select("docs", "toxic_docs", "uses", "toxic_uses").first()
    if total is None or not total["toxic_docs"] or total["docs"] == total["toxic_docs"]:
        return {}
    toxic, clean = max(1, total["toxic_uses"]), max(1, total["uses"] - total["toxic_uses"])
    clean_docs = F.col("docs") - F.col("toxic_docs")
    ratio = F.log(((F.col("toxic_uses") + 0.5) / toxic) / ((F.col("uses") - F.col("toxic_uses") + 0.5) / clean))
    sure = ratio - certainty * F.sqrt(1 / F.col("toxic_docs") + 1 / (clean_docs + 0.5))
    rows = counted.where("stem != '' and toxic_docs >= 4").withColumn("clean_docs", clean_docs).where(sure >= float(np.log(least_ratio))).collect()
    return {r["stem"]: "insult" if 50 * r["clean_docs"] < r["toxic_docs"] else "slur" for r in sorted(rows)}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, prior: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """Weights (bias first) of a logistic regression drawn towards `prior` (zeros) by `ridge`, by damped Newton steps."""
    a = np.column_stack((np.ones(len(x)), x))
    prior = np.zeros(a.shape[1]) if prior is None else prior
    pull = np.full(a.shape[1], ridge)
    pull[0] = 1e-3
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * pull @ (w - prior) ** 2
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (p - y) + pull * (w - prior))
        t = 1.0
        while t > 1e-4 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return w


def learn_weights(counts: np.ndarray, y: np.ndarray, ridge: float = 30.0) -> dict[str, float]:
    """Weights of events from their counts per document (columns in the order of `stated_weights`); none is negative."""
    stated = stated_weights()
    w = fit_logistic(np.log1p(counts), y, ridge, np.array([-3.0, *stated.values()]))
    return {e: float(max(v, 0.0)) for e, v in zip(stated, w[1:], strict=True)}


def _lists(rows: list) -> pa.Array:
    return pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))


def _event_rows(stems: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, names = Grammar(stems), list(stated_weights())
        for batch in batches:
            found = [grammar.events(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), _lists([[e.get(k, 0) for k in names] for e in found])], ["y", "x"])

    return run


def _feature_rows(stems: dict[str, str], weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems, weights)
        for batch in batches:
            yield pa.record_batch([batch.column(1), _lists([grammar.features(t) for t in batch.column(0).to_pylist()])], ["y", "x"])

    return run


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of bounded training rows, in an order that partitions don't change."""
    got = rows.toPandas()
    if not len(got):
        return np.zeros((0, 1)), np.zeros(0)
    x, y = np.array(got["x"].tolist(), dtype=float), (got["y"].to_numpy(dtype=float) > 0).astype(float)
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


class Model:
    """Lexicon, weights of events, and calibration."""

    def __init__(self, stems: dict[str, str], weights: dict[str, float], calibration: list[float]):
        self.stems, self.weights, self.calibration = stems, weights, calibration

    def score(self, features: np.ndarray) -> np.ndarray:
        w = np.array(self.calibration)
        return 1 / (1 + np.exp(-np.clip(w[0] + features @ w[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Model:
    """The model of at most `most_rows` labelled documents, which are written once; only counts and features reach the driver."""
    train = keep(training_rows(docs, labels, "toxic", most_rows), "labelled")
    stems = learn_stems(train)
    counts, y = _table(train.select("text", "y").mapInArrow(_event_rows(stems), "y double, x array<double>"))
    if len(y) < 20 or len(set(y)) < 2:
        return Model(stems, stated_weights(), list(DEFAULT_MODEL))
    weights = learn_weights(counts, y)
    x, y = _table(train.select("text", "y").mapInArrow(_feature_rows(stems, weights), "y double, x array<double>"))
    return Model(stems, weights, [float(v) for v in fit_logistic(x, y, ridge=5.0)])


# -- scoring -----------------------------------------------------------------------------------------------------
def scorer(model: Model):
    """Reads (id, text) batches and yields doc_id, score, clause_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems, model.weights)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(model.score(x)), pa.array(x[:, 0])], ["doc_id", "score", "clause_score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, clause_score) for every row of `docs`."""
    model = fit(docs, labels, most_rows)
    scored = docs.select("doc_id", "text").mapInArrow(scorer(model), "doc_id long, score double, clause_score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clause_score")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_rows: int = 20_000) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores under `threshold`; each text is scored in place, without a join."""
    return keep_scored(docs, scorer(fit(docs, labels, most_rows)), lambda s: s < threshold)


def keep_scored(docs: DataFrame, scorer, wanted) -> DataFrame:
    """Rows of `docs` whose score `wanted` accepts; a scorer reads (id, text) batches and yields the score second.

    Null and empty texts are scored like others, rows that repeat are judged alike, columns of any name stay as they
    are, and an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            pair = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
            scores = [pa.array(x.column(1)).to_numpy(zero_copy_only=False) for x in scorer(iter([pair]))]
            mask = wanted(np.concatenate(scores) if scores else np.zeros(0))
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)
