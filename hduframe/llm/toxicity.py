"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the beginnings of its longer words, hashed. The machine's inputs, by presence, are those that tell
the classes apart best, and the most frequent ones, which may do so only in company. Each has a weight, and a vector whose
products with other terms' vectors weigh pairs of terms, as when an insult meets the mention of a group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, durable, give_back, held_out, strings
from .sampling import PER_CLASS, clean_labels, sample_texts, sampled_ids

BUCKETS = 1 << 20
#: Inputs of the machine that tell the classes apart, at most; the sampled documents that a term must be in, and the least gap
#: between its shares in the two classes, in chance deviations: of a million terms without meaning, none is likely to show so much.
SELECTED, LEAST_DOCUMENTS, LEAST_GAP = 2048, 3, 5.0
#: Inputs that are the terms in most documents of the rarer class, and the documents that such a term must be in.
FREQUENT, OFTEN = 2048, 20
PREFIXES = (4, 5, 6, 7)
FACTORS = 8
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[int]:
    """Buckets of a lower-cased word: its own and those of its beginnings."""
    out = [zlib.crc32(word.encode()) % BUCKETS]
    out += [zlib.crc32(f"{word[:n]}*".encode()) % BUCKETS for n in PREFIXES if len(word) >= n]
    return out


class FactorizationMachine:
    """Logistic factorization machine on sets of inputs 0 .. n - 1."""

    def __init__(self, inputs: int, factors: int = FACTORS) -> None:
        self.bias, self.weights, self.vectors = 0.0, np.zeros(inputs, np.float32), np.zeros((inputs, factors), np.float32)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> None:
        """Minimises weighted logistic loss with decay by Adam."""
        chance = np.random.default_rng(seed)
        n = len(self.weights)
        self.vectors = chance.normal(0, 0.02, self.vectors.shape).astype(np.float32)
        mean = float(np.average(labels, weights=weights))
        self.bias = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        weights = weights / weights.mean()
        state = [np.zeros(s, np.float32) for s in (1, 1, n, n, self.vectors.shape, self.vectors.shape)]
        step = 0
        for _ in range(epochs):
            order = chance.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x = np.zeros((len(some), n), np.float32)
                for k, i in enumerate(some):
                    x[k, rows[i]] = 1
                sums = x @ self.vectors
                error = (1 / (1 + np.exp(-np.clip(self._margin(x, sums), -30, 30))) - labels[some]) * weights[some] / len(some)
                grads = [np.array([error.sum()]), x.T @ error + decay * self.weights, x.T @ (error[:, None] * sums) - self.vectors * (x.T @ error)[:, None] + decay * self.vectors]
                step += 1
                moves = []
                for k, g in enumerate(grads):
                    state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
                    state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * g * g
                    moves.append(rate * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8))
                self.bias -= float(moves[0][0])
                self.weights -= moves[1].astype(np.float32)
                self.vectors -= 0.3 * moves[2].astype(np.float32)

    def _margin(self, x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.weights + 0.5 * ((sums**2).sum(axis=1) - x @ (self.vectors**2).sum(axis=1))

    def score(self, present: np.ndarray) -> float:
        """Chance of label 1 for one set of inputs."""
        v = self.vectors[present].astype(np.float64)
        pairs = 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[present].astype(np.float64).sum() + pairs, -30, 30))))


class ToxicityModel:
    """``selected``: sorted buckets; the machine's inputs in this order."""

    def __init__(self, selected: np.ndarray, machine: FactorizationMachine | None, prior: float = 0.0) -> None:
        self.selected, self.machine, self.prior = selected, machine, prior
        self._number = {int(b): k for k, b in enumerate(selected)}
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def inputs(self, text: str) -> np.ndarray:
        found: set[int] = set()
        known, number = self._known, self._number
        for word in set(_WORD.findall(text.lower())):
            of_word = known.get(word)
            if of_word is None:
                of_word = tuple(number[t] for t in terms(word) if t in number)
                if len(known) < 200_000:
                    known[word] = of_word
            found.update(of_word)
        return np.array(sorted(found), np.int64)

    def score(self, text: str) -> float:
        return self.prior if self.machine is None else self.machine.score(self.inputs(text))


def _term_counts(sample: DataFrame) -> DataFrame:
    """Rows (bucket, n0, n1): weightless numbers of sampled documents of each label with the term."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch in bounded(rows):
            for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = {t for word in set(_WORD.findall(text.lower())) for t in terms(word)}
                counts[label][list(found)] += 1
        some = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some].astype(np.int64)), pa.array(counts[1][some].astype(np.int64))], names=["bucket", "n0", "n1"])

    return sample.select("text", "label").mapInArrow(run, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, selected: int = SELECTED, frequent: int = FREQUENT) -> ToxicityModel:
    """Fits on at most ``per_class`` documents of each label that aren't held out (crc32 of the id, mod 4, is 2). Without both
    labels, the model gives everything the share of label 1 that it saw, 0 if it saw none. Null ids and labels don't count; of an
    id's contradicting labels the higher does, of its texts the least."""
    rows = clean_labels(labels, "toxic").where(~held_out(4, 2))
    sample = durable(sample_texts(docs, sampled_ids(rows, per_class)), "sample")
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return ToxicityModel(np.zeros(0, np.int64), None, float(1 in totals))
    n0, n1 = totals[0], totals[1]
    # Terms by the gap between the classes' shares, in units of its chance deviation.
    share0, share1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    both = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    gap = F.abs(share1 - share0) / F.sqrt(both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    counted = durable(_term_counts(sample).where(F.col("n0") + F.col("n1") >= LEAST_DOCUMENTS), "terms")
    top = counted.select("bucket", gap.alias("gap")).where(F.col("gap") >= LEAST_GAP).orderBy(F.desc("gap"), "bucket").limit(selected).collect()
    rarer = F.col("n1" if n1 <= n0 else "n0")
    often = counted.where(rarer >= OFTEN).orderBy(F.desc(rarer), "bucket").limit(frequent).select("bucket").collect()
    chosen = np.array(sorted({r.bucket for r in (*top, *often)}), np.int64)
    empty = ToxicityModel(chosen, None)

    def reduce(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            found = [empty.inputs(t) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "weight", "inputs"])

    given = sample.select("text", "doc_id", "label", "weight").mapInArrow(reduce, "doc_id bigint, label int, weight double, inputs array<int>").toArrow().sort_by("doc_id").combine_chunks()
    machine = FactorizationMachine(len(chosen))
    if len(chosen):
        lists = given["inputs"].chunk(0)
        rows = np.split(np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))[:-1])
        machine.fit(rows, np.asarray(given["label"]).astype(np.float64), np.asarray(given["weight"]))
        del rows, lists
    del given
    discard(sample, counted)
    give_back()
    return ToxicityModel(chosen, machine)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null and empty texts get the score of a text without known terms; null ids stay null and count as not held out; repeated
    rows give repeated results; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            scores = np.array([model.score(t) for t in strings(batch.column(2))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(4, 2).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all columns, whatever their names. Null and empty texts are
    judged by the score of a text without known terms; repeated rows stay or go together; of an empty table nothing stays."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([model.score(t) < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
