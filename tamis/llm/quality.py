"""Quality classifier from positive and unlabelled documents.

Trusted positives are labelled good documents; everything else that training sees is unlabelled web text. The share of
good documents among the unlabelled (class prior) is estimated from the scores of a positive-against-unlabelled
classifier: above any threshold the unlabelled hold at least ``prior`` times the share that the positives hold, so the
smallest ratio of the two shares, with a confidence margin, bounds the prior (best-bin estimate). The model then
minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic loss over piecewise-linear functions of surface statistics of the text. Scores are its probabilities.

Only the training sample is bounded (``Quality.most`` rows of each kind); scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.tables import fold, sampled
from tamis.llm.textbytes import NOT_SPACE, Words, by_bytes, raw

#: Byte classes that are counted per document.
CLASSES = ["lower", "upper", "digit", "beyond", "space", "line", ".", ",", "!", "?", "|", "#$%&*", "@/\\_=+<>", "()[]{}", "'\"`-", "other"]


def _class_of_byte() -> np.ndarray:
    of = np.full(256, len(CLASSES) - 1, dtype=np.int64)
    of[ord("a"):ord("z") + 1], of[ord("A"):ord("Z") + 1], of[ord("0"):ord("9") + 1], of[0x80:] = 0, 1, 2, 3
    of[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], of[0x0A] = 4, 5
    for i, chars in enumerate(CLASSES[6:-1], 6):
        for c in chars:
            of[ord(c)] = i
    return of


CLASS_OF_BYTE = _class_of_byte()


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of surface statistics per text, over the whole text; null counts as empty."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    k = len(CLASSES)
    row = np.repeat(np.arange(n, dtype=np.int64) * k, size)
    shares = np.bincount(row + CLASS_OF_BYTE[data], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
    words = Words(texts, NOT_SPACE, lower=False)
    count = words.counts
    of_word = np.repeat(np.arange(n), count)
    per = 1 / np.maximum(count, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, weights=values, minlength=n) * per

    length = (words.ends - words.starts).astype(np.float64)
    same = np.zeros(len(words))
    if len(words):
        same[1:] = (words.codes[1:] == words.codes[:-1]) & (of_word[1:] == of_word[:-1])
    seen = np.unique(of_word * np.int64(max(len(words.vocabulary), 1)) + words.codes) // max(len(words.vocabulary), 1)
    distinct = np.bincount(seen, minlength=n)
    last = CLASS_OF_BYTE[words.data[words.ends - 1]] if len(words) else np.zeros(0, dtype=np.int64)
    average = mean(length)
    return np.column_stack([
        shares, np.log1p(size), np.log1p(count), average, np.sqrt(np.maximum(mean(length**2) - average**2, 0)),
        mean((length <= 3).astype(float)), mean((length >= 12).astype(float)), mean(same), distinct * per,
        mean((last > 3).astype(float)), mean((last >= 10).astype(float)), mean((last == 1).astype(float)),
    ]).astype(np.float64)


@dataclass
class Quality:
    """A trained classifier. ``knots`` are the bends of the piecewise-linear terms of each statistic."""

    most: int = 12_000
    bends: int = 8
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    prior: float = 0.5
    middle: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    knots: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.scale, -8, 8)
        hinges = [np.maximum(z - k, 0) for k in self.knots]
        return np.hstack([np.ones((len(z), 1)), z, *hinges])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._terms(x) @ self.weights)

    def fit(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> "Quality":
        """Train on two tables of statistics; the prior is estimated unless given. Without positives or without
        unlabelled rows nothing can be learned: every score is then the prior (0.5 unless given)."""
        width = positives.shape[1] if positives.size else unlabelled.shape[1] if unlabelled.size else statistics(pa.array([""])).shape[1]
        if not len(positives) or not len(unlabelled):
            self.prior = 0.5 if prior is None else prior
            self.middle, self.scale, self.knots = np.zeros(width), np.ones(width), np.zeros((0, width))
            self.weights = np.zeros(1 + width)
            self.weights[0] = np.log(self.prior / (1 - self.prior))
            return self
        both = np.vstack([positives, unlabelled])
        self.middle, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        z = np.clip((both - self.middle) / self.scale, -8, 8)
        self.knots = np.quantile(z, np.linspace(0.05, 0.95, self.bends), axis=0)
        p, u = self._terms(positives), self._terms(unlabelled)
        if prior is None:
            half_p, half_u = len(p) // 2, len(u) // 2
            w = self._descend(p[:half_p], u[:half_u], None) if half_p and half_u else np.zeros(p.shape[1])
            prior = best_bin_prior(p[half_p:] @ w, u[half_u:] @ w)
        self.prior = float(np.clip(prior, 0.02, 0.98))
        self.weights = self._descend(p, u, self.prior)
        return self

    def _descend(self, p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
        """Adam on the non-negative risk; with no prior, on the plain positive-against-unlabelled logistic risk."""
        w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
        for t in range(1, self.steps + 1):
            sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
            good = p.T @ (sp - 1) / len(p)  # gradient of R+(positives)
            bad = p.T @ sp / len(p)  # of R-(positives)
            rest = u.T @ su / len(u)  # of R-(unlabelled)
            if prior is None:
                gradient = good + rest
            else:
                negative = np.mean(_softplus(u @ w)) - prior * np.mean(_softplus(p @ w))
                # below zero the estimate has overfitted: step back along it instead
                gradient = prior * good + rest - prior * bad if negative >= 0 else prior * bad - rest
            gradient = gradient + self.decay * w
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w = w - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w


def best_bin_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray, confidence: float = 0.1) -> float:
    """The smallest ratio, over thresholds, of the unlabelled's share above it to the positives' share above it, plus a
    margin that grows as the positives above the threshold get few."""
    if not len(positive_scores) or not len(unlabelled_scores):
        return 0.5
    cuts = np.unique(positive_scores)
    above_p = 1 - np.searchsorted(np.sort(positive_scores), cuts) / len(positive_scores)
    above_u = 1 - np.searchsorted(np.sort(unlabelled_scores), cuts) / len(unlabelled_scores)
    margin = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive_scores)) + 1 / np.sqrt(len(unlabelled_scores)))
    best = np.argmin((above_u + margin) / above_p)
    return float(min(above_u[best] / above_p[best], 1.0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _rows(docs: DataFrame) -> np.ndarray:
    """Statistics of a bounded sample of documents, brought to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x))], ["doc_id", "x"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")
    # a row per id, however many rows share it
    out = found.groupBy("doc_id").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    return np.vstack(out["x"].to_list()) if len(out) else np.zeros((0, 0))


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, parts: int = 5, held: int = 0, prior: float | None = None) -> Quality:
    """Fit on at most ``most`` trusted positives (quality 1) and ``most`` unlabelled documents, both outside the held-out
    fold. A document labelled twice is a positive only if every label says so; null labels count as none."""
    allowed = F.coalesce(fold("doc_id", parts) != held, F.lit(False))
    judged = labels.where(allowed & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    positive = sampled(judged.where("quality = 1").select("doc_id"), most)
    unlabelled = docs.where(allowed).select("doc_id").distinct().join(judged.select("doc_id"), "doc_id", "left_anti")
    texts = docs.select("doc_id", "text")
    # both lists are bounded by `most` ids
    good = texts.join(F.broadcast(positive), "doc_id", "left_semi")
    web = texts.join(F.broadcast(sampled(unlabelled, most)), "doc_id", "left_semi")
    return Quality(most=most).fit(_rows(good), _rows(web), prior)


def score(docs: DataFrame, model: Quality) -> DataFrame:
    """``docs`` with ``quality_score``; nulls and empty texts are scored as empty texts; all columns stay (a column of
    that name already there is replaced)."""
    columns = [c for c in docs.columns if c != "quality_score"]
    schema = docs.select(*columns).schema.add("quality_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                s = model.scores(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, "quality_score"])

    return docs.select(*columns).mapInArrow(run, schema)
