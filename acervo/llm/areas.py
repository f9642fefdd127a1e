"""Problem 9: subject areas of documents, by classifier chains.

Term features: weights of words for each area, learned from labelled documents as bags of paragraphs (a label says that
some paragraph treats the area, so paragraphs are assigned to areas and the weights learned again, a few times).  Structure
features: of each paragraph the share of sentences that speak for an area; of a document the largest share, the number of
paragraphs won, and its share of all sentences.  Source feature: how much more often a source has the area.  The chain is
a logistic regression for each area, the frequent ones first, that also sees the areas decided before it; each is
calibrated on documents it was not trained on, and a beam search decodes the most probable combination.

The model is fitted on the driver from at most ``LABELLED`` labelled documents (those whose id's hash is least), so the
bound is fixed; words that fewer than ``LEAST`` of them hold are left out.  Every document is classified, in Arrow batches
without a shuffle; whole texts are read.

Defined cases: null, empty and blank texts have no area; labels are matched without case, accents and spacing, others and
null ones are left out; labels given twice count once; null sources have no source feature; without any usable label
nothing is reported; repeated document ids give one row an area; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED, LEAST, ROUNDS, BEAM = 8_000, 3, 5, 6
STRUCTURE = 4
#: Occurrences that a word is taken to have besides, spread as the areas of its language are.
SHRINK = 4

# Frequent small words that tell the languages apart (Portuguese, Spanish, English).
COMMON = (
    frozenset("o os do da dos das em no na um uma ao à com não pelo pela".split()),
    frozenset("el los la las del y en con una al por sin".split()),
    frozenset("the of and to in for with on by at from is".split()),
)

_TOKEN = re.compile(r"[^\W\d_]{2,}|[.;!?](?=\s|$)|[\r\n\f]+")
SENTENCE, PARAGRAPH = -1, -2


def label_form(label: str) -> str:
    """A label without case, accents, spacing and punctuation."""
    return "".join(c for c in unicodedata.normalize("NFKD", label.casefold()) if c.isalnum())


def language(text: str) -> int:
    """The position in ``COMMON`` of the language whose small words the text has most of."""
    words = text.lower().split()
    return max(range(len(COMMON)), key=lambda g: sum(w in COMMON[g] for w in words))


class Areas:
    """Word weights, the chain and its calibration."""

    def __init__(self, names: list[str]):
        self.names = names
        self.number: dict[str, int] = {}
        self.weights = np.zeros((1, len(names)), np.float32)
        self.order = list(range(len(names)))
        self.sources: dict[str, np.ndarray] = {}
        self.chain: list[tuple[np.ndarray, np.ndarray, np.ndarray, float, float]] = []

    def codes(self, text: str) -> list[int]:
        """Word numbers (the last is every unknown word) and the ends of sentences and paragraphs."""
        number, other = self.number, len(self.number)
        return [SENTENCE if c in ".;!?" else PARAGRAPH if c in "\r\n\f" else number.get(t, other) for t in _TOKEN.findall(text.lower()) if (c := t[0])]

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all sentences by area, and the paragraph and text of each."""
        own = [np.array([*self.codes(t), PARAGRAPH], np.int32) for t in texts]
        flat = np.concatenate(own)
        ends = flat < 0
        sentence = np.cumsum(ends) - ends
        paragraph = np.cumsum(flat == PARAGRAPH) - (flat == PARAGRAPH)
        text = np.repeat(np.arange(len(own)), [len(x) for x in own])
        word = ~ends
        scores = np.zeros((int(sentence[-1]) + 1, len(self.names)), np.float32)
        ids, of = flat[word], sentence[word]
        used = np.zeros(len(scores), bool)
        if len(ids):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            scores[of[starts]] = np.add.reduceat(self.weights[ids], starts, axis=0)
            used[of[starts]] = True
        at = np.flatnonzero(ends)
        return scores[used], paragraph[at][used], text[at][used]

    def features(self, texts: list[str]) -> np.ndarray:
        """Of every text and area: largest share of a paragraph, paragraphs won, share of all sentences, best score."""
        n, k = len(texts), len(self.names)
        out = np.zeros((n, k, STRUCTURE), np.float32)
        scores, paragraph, text = self.sentences(texts)
        if not len(scores):
            return out
        votes = np.zeros_like(scores)
        best = scores.argmax(axis=1)
        votes[np.arange(len(best)), best] = scores.max(axis=1) > 1.0
        starts = np.flatnonzero(np.concatenate([[True], paragraph[1:] != paragraph[:-1]]))
        size = np.diff(np.append(starts, len(paragraph)))
        won = np.add.reduceat(votes, starts, axis=0)
        total = np.add.reduceat(scores, starts, axis=0) / size[:, None]
        share = won / size[:, None]
        owner = text[starts]
        true = (size > 1)[:, None]
        np.maximum.at(out[:, :, 0], owner, share * true)
        np.add.at(out[:, :, 1], owner, (share >= 0.5) & true)
        np.add.at(out[:, :, 2], owner, won)
        np.maximum.at(out[:, :, 3], owner, np.clip(total, 0, 20) * true)
        out[:, :, 1] = np.minimum(out[:, :, 1], 4)
        out[:, :, 2] /= np.maximum(1, np.bincount(text, minlength=n))[:, None]
        out[:, :, 3] /= 10
        return out

    def source(self, names: list[str | None]) -> np.ndarray:
        """Log odds of each area in each source; none for sources without labels."""
        none = np.zeros(len(self.names), np.float32)
        return np.array([self.sources.get(s, none) for s in names], np.float32).reshape(len(names), -1)

    def inputs(self, area: int, own: np.ndarray, source: np.ndarray, before: np.ndarray) -> np.ndarray:
        """What the regression of ``area`` sees: its features, the strongest other area, its source, areas decided before."""
        rest = np.delete(own[:, :, 0], area, axis=1).max(axis=1) if own.shape[1] > 1 else np.zeros(len(own))
        return np.concatenate([own[:, area], rest[:, None], source[:, [area]], before], axis=1)

    def fit(self, texts: list[str], sources: list[str | None], truth: np.ndarray) -> None:
        held: Counter = Counter()
        for t in texts:
            held.update(set(_TOKEN.findall(t.lower())))
        self.number = {w: i for i, w in enumerate(sorted(w for w, c in held.items() if c >= LEAST and w[0].isalpha()))}
        size, k = len(self.number), len(self.names)
        parts: list[tuple[int, np.ndarray]] = []
        for i, t in enumerate(texts):
            codes = np.array([*self.codes(t), PARAGRAPH], np.int32)
            for p in np.split(codes, np.flatnonzero(codes == PARAGRAPH) + 1):
                words = p[(p >= 0) & (p < size)]
                if (p == SENTENCE).sum() > 1 and len(words) > 5:
                    parts.append((i, words))
        share = truth / np.maximum(1, truth.sum(axis=1, keepdims=True))
        belongs = np.array([share[i] for i, _ in parts]).reshape(-1, k)
        spoken = np.array([language(t) for t in texts])[[i for i, _ in parts]] if parts else np.zeros(0, int)
        by_language = np.zeros((size + 1, len(COMMON)))
        for (_, words), g in zip(parts, spoken, strict=True):
            np.add.at(by_language, (words, g), 1)
        word_language = by_language.argmax(axis=1)
        for step in range(ROUNDS):
            counts = np.zeros((size + 1, k))
            for (_, words), b in zip(parts, belongs, strict=True):
                np.add.at(counts, words, b)
            # how often each area is in the texts of a language: a word speaks for an area only beyond that
            usual = np.array([(belongs[spoken == g].sum(axis=0) + 0.5) / ((spoken == g).sum() + 0.5 * k) for g in range(len(COMMON))])[word_language]
            odds = (counts + SHRINK * usual) / (counts.sum(axis=1, keepdims=True) + SHRINK) / usual
            self.weights = np.maximum(np.log(odds), -1.5).astype(np.float32)
            self.weights[size] = 0
            scores = np.array([self.weights[w].mean(axis=0) * min(len(w), 60) for _, w in parts]).reshape(-1, k)
            allowed = np.array([truth[i] for i, _ in parts]).reshape(-1, k) > 0
            if step + 2 < ROUNDS:
                scores = np.where(allowed, scores, scores - 8 * (2 + step))
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            belongs = e / e.sum(axis=1, keepdims=True)
        by: dict[str, list[int]] = defaultdict(list)
        for i, s in enumerate(sources):
            if s is not None:
                by[s].append(i)
        base = truth.mean(axis=0)
        for s, own in by.items():
            p = (truth[own].sum(axis=0) + 20 * base) / (len(own) + 20)
            self.sources[s] = np.log((p + 1e-3) / (base + 1e-3)).astype(np.float32)
        self.order = sorted(range(k), key=lambda a: -truth[:, a].sum())
        own, source = self.features(texts), self.source(sources)
        train = np.arange(len(texts)) % 3 > 0
        for at, area in enumerate(self.order):
            before = truth[:, self.order[:at]]
            x, y = self.inputs(area, own, source, before), truth[:, area]
            mean, spread = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
            z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], axis=1)
            w = regression(z[train], y[train], 1.0)
            margin = z @ w
            test = ~train if (~train).sum() > 20 else train
            a, b = regression(np.stack([margin[test], np.ones(test.sum())], axis=1), y[test], 0.5, np.array([1.0, 0.0]))
            self.chain.append((mean, spread, w, max(0.2, float(a)), float(b)))

    def decode(self, texts: list[str], sources: list[str | None]) -> np.ndarray:
        """The most probable combination of areas of every text, by beam search along the chain."""
        n, k = len(texts), len(self.names)
        own, source = self.features(texts), self.source(sources)
        picked, logs = np.zeros((n, 1, k), np.float32), np.zeros((n, 1))
        for at, area in enumerate(self.order):
            width = picked.shape[1]
            before = picked[:, :, self.order[:at]].reshape(n * width, -1)
            x = self.inputs(area, np.repeat(own, width, axis=0), np.repeat(source, width, axis=0), before)
            mean, spread, w, a, b = self.chain[at]
            margin = a * (((x - mean) / spread) @ w[:-1] + w[-1]) + b
            margin = margin.reshape(n, width)
            yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
            both = np.concatenate([logs + no, logs + yes], axis=1)
            with_ = picked.copy()
            with_[:, :, area] = 1
            states = np.concatenate([picked, with_], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
            logs = np.take_along_axis(both, top, axis=1)
            picked = np.take_along_axis(states, top[:, :, None], axis=1)
        out = picked[:, 0] > 0
        out[own[:, :, 3].max(axis=1) <= 0] = False
        return out


def regression(x: np.ndarray, y: np.ndarray, ridge: float, towards: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge towards ``towards`` (zero)."""
    x = x.astype(np.float64)
    goal = np.zeros(x.shape[1]) if towards is None else towards
    w = goal.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * (w - goal))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(corpus: DataFrame, labels: DataFrame, areas: DataFrame) -> Areas:
    """The model, from at most ``LABELLED`` labelled documents with text."""
    names = sorted({r.area for r in areas.select("area").where("area IS NOT NULL").distinct().toLocalIterator()})
    forms = {label_form(a): i for i, a in enumerate(names)}
    docs = labels.where("area IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("area").alias("areas"))
    docs = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = corpus.select("doc_id", "text", "source").join(F.broadcast(docs), "doc_id").where(F.length(F.trim("text")) > 0).orderBy("doc_id").collect()
    truth = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for a in r.areas:
            if (j := forms.get(label_form(a))) is not None:
                truth[i, j] = 1
    keep = np.flatnonzero(truth.sum(axis=1) > 0)
    model = Areas(names)
    if len(keep) > 3:
        model.fit([rows[i].text for i in keep], [rows[i].source for i in keep], truth[keep])
    return model


def classify(spark: SparkSession, corpus: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``doc_id``, ``area`` of every area of every document."""
    shared = spark.sparkContext.broadcast(fit(corpus, labels, areas))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in batches:
            for at in range(0, rows.num_rows, 1_000):
                part = rows.slice(at, 1_000)
                if not model.chain:
                    continue
                i, j = np.nonzero(model.decode(part.column(1).to_pylist(), part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array([model.names[a] for a in j], pa.string())], names=["doc_id", "area"])

    kind = corpus.schema["doc_id"].dataType.simpleString()
    rows = corpus.select("doc_id", "text", "source").where(F.length(F.trim("text")) > 0)
    return rows.mapInArrow(run, f"doc_id {kind}, area string")
