"""Toxicity by multiple-instance learning.

Only documents are labelled, but sentences are toxic.  A sentence's probability is logistic in
its hashed words and word beginnings; a document is toxic if any sentence is: a noisy-or,
``1 - prod(1 - p)``.  Both are trained together from document labels by gradient descent on
the noisy-or's likelihood.  A document's score is the noisy-or on whole texts, mapped to
labels by a monotone logistic curve; the sentences with the highest probabilities are where
it is toxic.

The model is fitted on a bounded, class-balanced sample of labelled documents, the ones whose
ids have the smallest hashes.  It is a vector of ``1 << bits`` numbers, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from concordat.llm.common import holding, pieces

_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_CACHE: dict[str, np.ndarray] = {}
_CACHED = 200_000
_PREFIXES = (4, 6)


def sentences(text: str) -> list[str]:
    """The sentences: parts between sentence ends or line ends."""
    return [s for s in _SENTENCE.split(text) if s]


def _features(word: str, bits: int) -> np.ndarray:
    """Places of a lower-case word and its beginnings in a hashed vector."""
    forms = [word, *(f"{word[:n]}*" for n in _PREFIXES if len(word) > n)]
    return np.array([zlib.crc32(f.encode("utf-8", "replace")) & ((1 << bits) - 1) for f in forms], np.int32)


def _word_features(word: str, bits: int) -> np.ndarray:
    found = _CACHE.get(word)
    if found is None:
        if len(_CACHE) >= _CACHED:
            _CACHE.clear()
        found = _CACHE[word] = _features(word, bits)
    return found


@dataclass
class Model:
    """Weights of words, the sentence bias, and the curve from noisy-or to score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def release(self) -> None:
        """Forget the weights of words met so far; they are made again when needed."""
        self.__dict__.pop("_known", None)

    def sentence_scores(self, text: str) -> list[tuple[str, float]]:
        """(sentence, probability) for each sentence of a text."""
        return [(s, float(p)) for s, p in zip(sentences(text), -np.expm1(-self._softplus(self._raw(text))))]

    @staticmethod
    def _softplus(z: np.ndarray) -> np.ndarray:
        return np.logaddexp(0.0, z)

    def _raw(self, text: str) -> np.ndarray:
        known = self.__dict__.setdefault("_known", {})
        out = []
        for s in sentences(text):
            z = self.bias
            for w in set(_WORD.findall(s.lower())):
                v = known.get(w)
                if v is None:
                    if len(known) >= _CACHED:
                        known.clear()
                    v = known[w] = float(self.weights[_features(w, self.bits)].sum())
                z += v
            out.append(z)
        return np.array(out)

    def score(self, text: str) -> float:
        """0 to 1, rising with the noisy-or of the sentences; a text without words has the least."""
        evidence = float(self._softplus(self._raw(text)).sum())  # -log of prod(1 - p)
        noisy_or = np.log(max(np.expm1(min(evidence, 30.0)), 1e-12))  # its log-odds
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * noisy_or + self.shift, -30, 30))))


def fit(
    texts: list[str], labels: list[int], bits: int = 18, rounds: int = 200, rate: float = 0.4,
    l1: float = 1e-3, least_documents: int = 5,
) -> Model:
    """Train sentence weights from document labels through the noisy-or.

    Features of fewer than ``least_documents`` documents take no part; the others are kept at
    zero unless they explain more than ``l1`` of the likelihood.
    """
    y = np.array(labels, np.float64)
    cols, sent_of, doc_of = [], [], []
    n_sent = 0
    for d, text in enumerate(texts):
        for s in sentences(text) or [""]:
            words = set(_WORD.findall(s.lower()))
            if words:
                found = np.concatenate([_word_features(w, bits) for w in words])
                cols.append(found)
                sent_of.append(np.full(len(found), n_sent, np.int32))
            doc_of.append(d)
            n_sent += 1
    col = np.concatenate(cols) if cols else np.empty(0, np.int32)
    sent = np.concatenate(sent_of) if sent_of else np.empty(0, np.int32)
    doc = np.array(doc_of)
    pairs = np.unique(col.astype(np.int64) * max(len(y), 1) + doc[sent]) if len(col) else np.empty(0, np.int64)
    common = np.bincount(pairs // max(len(y), 1), minlength=1 << bits) >= least_documents
    keep = common[col]
    col, sent = col[keep], sent[keep]
    used, place = np.unique(col, return_inverse=True)
    weights, bias = np.zeros(len(used)), -8.0
    seen_w, seen_b = np.zeros(len(used)), 0.0
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / max(len(y), 1)
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        z = np.bincount(sent, weights[place], n_sent) + bias
        p = 1 / (1 + np.exp(-z))
        evidence = np.bincount(doc, np.logaddexp(0, z), len(y))
        none = np.exp(-evidence)
        # d(log likelihood) / d(evidence): none / (1 - none) for toxic documents, -1 for others
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0) * balance
        grad_z = pull[doc] * p
        grad_w = np.bincount(place, grad_z[sent], len(used))
        grad_b = grad_z.sum()
        seen_w += grad_w**2
        seen_b += grad_b**2
        step = rate / (np.sqrt(seen_w) + l1)
        weights += step * grad_w
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * l1, 0)
        bias += 0.2 * rate * grad_b / (np.sqrt(seen_b) + 1e-8)
    _CACHE.clear()
    full = np.zeros(1 << bits)
    full[used] = weights
    return Model(full, bias, 1.0, 0.0, bits)


def training_rows(documents: DataFrame, labels: DataFrame, usable: Column, per_class: int) -> DataFrame:
    """(text, toxic): at most ``per_class`` documents of each label, by the least hash of the id."""
    chosen = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [
        chosen.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)
    ]
    return documents.join(picks[0].union(picks[1]), "doc_id").groupBy("doc_id").agg(
        F.max("text").alias("text"), F.max("toxic").alias("toxic")
    )


def calibrate(model: Model, scored: list[tuple[float, int]], prior: float) -> Model:
    """Fit the curve from noisy-or to label on documents that the weights were not trained on."""
    x = np.array([np.log(s / (1 - s)) for s, _ in scored])
    y = np.array([t for _, t in scored], float)
    if not 0 < y.sum() < len(y):
        return model
    weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a little damping
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-6
        grad = np.array([(g * x).sum() - 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a + np.clip(step[0], -0.5, 0.5), b + np.clip(step[1], -1, 1)
    return Model(model.weights, model.bias, max(float(a), 0.05), float(b), model.bits)


def train(documents: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1500, bits: int = 18) -> Model:
    """Fit on at most ``per_class`` documents of each label; every third of them sets the curve.

    ``usable`` is a condition on the rows of ``labels`` that may be learned from.  Without
    labels of both kinds every score is 0.5 or less.
    """
    rows = training_rows(documents, labels, usable, per_class).orderBy(F.xxhash64("doc_id")).collect()
    texts, toxic = [r["text"] or "" for r in rows], [int(r["toxic"]) for r in rows]
    held = [i % 3 == 0 for i in range(len(rows))]
    model = fit([t for t, h in zip(texts, held) if not h], [t for t, h in zip(toxic, held) if not h], bits)
    counts = {r["toxic"]: r["n"] for r in labels.where(usable).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    return calibrate(model, [(min(max(model.score(t), 1e-12), 1 - 1e-12), y) for t, y, h in zip(texts, toxic, held) if h], prior)


def with_score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with the column ``score``; null texts count as empty.

    A column of that name is replaced, all others stay.  Repeated rows get equal scores.
    """
    columns = [c for c in documents.columns if c != "score"]
    kept = documents.select(*[F.col(f"`{c}`") for c in columns])
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        holding("toxicity", m.release)
        for b in pieces(batches):
            scores = pa.array([m.score(t or "") for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "score"])

    return kept.mapInArrow(work, StructType([*kept.schema.fields, StructField("score", DoubleType())]))


def offending(text: str, model: Model, least: float = 0.5) -> list[tuple[str, float]]:
    """The sentences that make a text toxic, worst first."""
    return sorted(((s, p) for s, p in model.sentence_scores(text) if p >= least), key=lambda x: -x[1])
