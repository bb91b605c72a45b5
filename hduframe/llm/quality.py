"""Quality by Bradley-Terry ranking.

Documents have hidden scores, linear in features of their texts; in a pair, the one labelled good is preferred with the logistic
chance of the difference. The scores are learned from many such pairs, that is by logistic loss on feature differences. The
threshold is a quantile of the scores: the one that parts the labels of the sample best.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, give_back, held_out, strings
from .sampling import PER_CLASS, clean_labels, sample_texts, sampled_ids

THRESHOLD = 0.3
#: Levels into which each feature is cut, at quantiles of the sample, so that its worth need not rise or fall throughout.
LEVELS = 12
PAIRS = 40_000
_LETTER = re.compile(r"[^\W\d_]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
_RUN = re.compile(r"([^\w\s])\1+")
FEATURES = 20


def features(text: str) -> list[float]:
    """Numbers that describe form, not subject: sizes, shares of kinds of characters, and how much words and lines repeat."""
    words, lines, n = text.split(), text.split("\n"), len(text)
    w, counts = len(words), Counter(words)
    letters = len(_LETTER.findall(text))
    upper = sum(map(str.isupper, text)) if letters else 0
    digits = sum(map(str.isdigit, text)) if n else 0
    symbols, runs = len(_SYMBOL.findall(text)), len(_RUN.findall(text))
    commons = counts.most_common(3)
    pairs = set(zip(words, words[1:], strict=False))
    return [
        np.log1p(n),
        np.log1p(w),
        letters / max(n, 1),
        upper / max(letters, 1),
        digits / max(n, 1),
        symbols / max(w, 1),
        runs / max(w, 1),
        text.count("|") / max(w, 1),
        text.count("!") / max(w, 1),
        (text.count(".") + text.count("?")) / max(w, 1),
        text.count(",") / max(w, 1),
        len(counts) / max(w, 1) ** 0.85,
        commons[0][1] / w if w else 0.0,
        sum(c for _, c in commons) / w if w else 0.0,
        len(pairs) / max(w - 1, 1) if w > 1 else 1.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(w - 1, 1),
        len(set(lines)) / len(lines),
        n / len(lines) / 100,
        sum(map(len, words)) / max(w, 1),
        sum(x[0].isupper() for x in words) / max(w, 1),
    ]


class BradleyTerry:
    """Scores linear in levels of features. ``threshold``: the score from which a document is taken for good."""

    def __init__(self) -> None:
        self.edges = np.zeros((FEATURES, 0))
        self.weights = np.zeros(0)
        self.threshold = 0.0
        self.constant: float | None = None

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Each feature's level, as the sum of steps up to it; a step's weight is what passing the level's edge is worth."""
        return (x[:, :, None] >= self.edges[None, :, :]).reshape(len(x), -1).astype(np.float32)

    def fit(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, pairs: int = PAIRS, epochs: int = 30, rate: float = 0.05, decay: float = 1e-3, seed: int = 11) -> None:
        good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        if not len(good) or not len(bad):
            self.constant = 1.0 if len(good) else 0.0
            return
        self.edges = np.quantile(x, np.linspace(0, 1, LEVELS + 1)[1:], axis=0).T
        # the classes' own quantiles, too, so that a rare class is not within one level
        for some in (good, bad):
            self.edges = np.concatenate([self.edges, np.quantile(x[some], [0.02, 0.1, 0.5, 0.9, 0.98], axis=0).T], axis=1)
        levels = self.expand(x)
        chance = np.random.default_rng(seed)
        self.weights = np.zeros(levels.shape[1])
        m, v, step = np.zeros_like(self.weights), np.zeros_like(self.weights), 0
        for _ in range(epochs):
            first, second = chance.choice(good, pairs), chance.choice(bad, pairs)
            for at in range(0, pairs, 2000):
                difference = levels[first[at : at + 2000]] - levels[second[at : at + 2000]]
                preferred = 1 / (1 + np.exp(-np.clip(difference @ self.weights, -30, 30)))
                gradient = difference.T @ (preferred - 1) / len(difference) + decay * self.weights
                step += 1
                m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
                self.weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        scores = levels @ self.weights
        # The quantile of scores whose two sides hold the fewest labels of the wrong kind, both kinds alike; halfway to the next.
        order = np.argsort(scores)
        share = np.where(labels[order] == 1, weights[order] / weights[labels == 1].sum(), -weights[order] / weights[labels == 0].sum())
        wrong = 1 + np.concatenate([[0.0], np.cumsum(share)])
        at = int(np.argmin(wrong))
        low, high = scores[order[max(at - 1, 0)]], scores[order[min(at, len(order) - 1)]]
        self.threshold = float((low + high) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold has the score 0.3."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        margin = self.expand(x) @ self.weights - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> BradleyTerry:
    """Fits on at most ``per_class`` documents of each label that aren't held out (crc32 of the id, mod 5, is 0). Where one label
    is missing, everything gets the score 1, or 0 if there is no good document either. Null ids and labels don't count; of an id's
    contradicting labels the higher does, of its texts the least."""
    sample = sample_texts(docs, sampled_ids(clean_labels(labels, "quality").where(~held_out(5)), per_class))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([features(t) for t in strings(batch.column(0))], pa.list_(pa.float64()))], names=["doc_id", "label", "weight", "x"])

    given = sample.select("text", "doc_id", "label", "weight").mapInArrow(run, "doc_id bigint, label int, weight double, x array<double>").toArrow().sort_by("doc_id").combine_chunks()
    model = BradleyTerry()
    x = np.concatenate([np.zeros(0), *(np.asarray(c.flatten()) for c in given["x"].chunks)]).reshape(-1, FEATURES)
    model.fit(x, np.asarray(given["label"]).astype(np.int64), np.asarray(given["weight"]))
    del given, x
    give_back()
    return model


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null texts count as empty, which have features like any other; null ids stay null and count as not held out; repeated rows
    give repeated results; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            scores = model.score(np.array([features(t) for t in strings(batch.column(2))]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(5).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """The rows of ``docs`` that the model takes for good, with all columns, whatever their names. Null texts count as empty;
    repeated rows stay or go together; of an empty table nothing stays."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            scores = model.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES))
            yield batch.filter(pa.array(scores >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
