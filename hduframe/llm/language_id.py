"""Language identification in two steps: the family, then the language within it.

Families are told apart by one linear support vector machine each; within a family, one machine for each pair of its languages
decides, and the language with most wins, then the largest sum of margins, is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, give_back, held_out
from .sampling import sample_texts, sampled_ids

#: Languages by family; any other language is a family of its own. Fixed values.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "baltic": "lt lv".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr uz".split(),
    "indo-aryan": "bn gu hi mr ne pa ur".split(),
    "semitic": "am ar he mt".split(),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
INPUTS = 2048
#: Documents of each language that a model is fitted on at most, and of all languages together.
PER_LANGUAGE, MOST = 2500, 40_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"only {lang}")


def grams(text: str) -> np.ndarray:
    """Unit vector of hashed shares of runs of 2, 3 and 4 bytes of the lower-cased text, damped by a square root."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    out = np.zeros(INPUTS, np.float32)
    code = data.copy()
    for n in (2, 3, 4):
        code = (code[:-1] << np.uint32(8)) | data[n - 1 :] if len(code) > 1 else code[:0]
        mixed = ((code ^ np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(21)
        out += np.bincount(mixed.astype(np.int64), minlength=INPUTS)
    out = np.sqrt(out)
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


class LinearSVM:
    """Hinge loss with decay, by averaged stochastic steps over small batches. Inputs are fitted as 255ths."""

    def fit(self, x: np.ndarray, signs: np.ndarray, epochs: int = 12, batch: int = 64, decay: float = 1e-4, seed: int = 5) -> LinearSVM:
        chance = np.random.default_rng(seed)
        self.weights, self.bias = np.zeros(x.shape[1], np.float32), 0.0
        total, total_bias, steps = np.zeros(x.shape[1], np.float64), 0.0, 0
        balance = np.where(signs > 0, 0.5 / max((signs > 0).mean(), 1e-9), 0.5 / max((signs < 0).mean(), 1e-9)).astype(np.float32)
        for epoch in range(epochs):
            order = chance.permutation(len(x))
            rate = 2.0 / (1 + epoch)
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                inputs = x[some].astype(np.float32) / 255
                wrong = (signs[some] * (inputs @ self.weights + self.bias) < 1) * signs[some] * balance[some] / len(some)
                self.weights += rate * (wrong.astype(np.float32) @ inputs - decay * self.weights)
                self.bias += rate * 0.1 * float(wrong.sum())
                if epoch >= epochs // 2:
                    total += self.weights
                    total_bias += self.bias
                    steps += 1
        self.weights, self.bias = (total / max(steps, 1)).astype(np.float32), total_bias / max(steps, 1)
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


class Hierarchy:
    """``predict``: languages and scores (0 to 1) for rows of inputs."""

    def __init__(self) -> None:
        self.families: list[str] = []
        self.languages: dict[str, list[str]] = {}
        self.family_machines: list[LinearSVM] = []
        self.pair_machines: dict[tuple[str, str], LinearSVM] = {}

    def fit(self, x: np.ndarray, langs: list[str]) -> Hierarchy:
        names = np.array([family_of(a) for a in langs], dtype=object)
        given = np.array(langs, dtype=object)
        self.families = sorted(set(names))
        self.languages = {f: sorted(set(given[names == f])) for f in self.families}
        if len(self.families) > 1:
            self.family_machines = [LinearSVM().fit(x, np.where(names == f, 1.0, -1.0)) for f in self.families]
        for f in self.families:
            for a, b in combinations(self.languages[f], 2):
                some = (given == a) | (given == b)
                self.pair_machines[a, b] = LinearSVM().fit(x[some], np.where(given[some] == a, 1.0, -1.0))
        return self

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        scores = np.ones(len(x))
        family = np.zeros(len(x), np.int64)
        if self.family_machines:
            margins = np.stack([m.margins(x) for m in self.family_machines], axis=1)
            family = margins.argmax(axis=1)
            scores = 1 / (1 + np.exp(-4 * np.clip(margins.max(axis=1), -7, 7)))
        found = np.empty(len(x), dtype=object)
        for k, f in enumerate(self.families):
            some, langs = np.flatnonzero(family == k), self.languages[f]
            wins, sums = np.zeros((len(some), len(langs))), np.zeros((len(some), len(langs)))
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                margin = self.pair_machines[a, b].margins(x[some])
                wins[:, i] += margin >= 0
                wins[:, j] += margin < 0
                sums[:, i] += margin
                sums[:, j] -= margin
            best = (wins + 0.5 * np.tanh(sums)).argmax(axis=1)
            found[some] = np.array(langs, dtype=object)[best]
            if len(langs) > 1:
                scores[some] *= 1 / (1 + np.exp(-4 * np.clip(sums[np.arange(len(some)), best] / (len(langs) - 1), -7, 7)))
        return found.tolist(), scores


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> Hierarchy:
    """Fits on at most ``per_language`` documents of each language, fewer where there are so many languages that they would be
    more than ``most``, of those that aren't held out (crc32 of the id, mod 5, is 0) and have a letter and a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5)).select("doc_id", F.col("lang").alias("label"))
    languages = rows.select("label").distinct().count()
    ids = sampled_ids(rows, max(1, min(per_language, most // max(languages, 1)))).select("doc_id", "label")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches_):
            some = [(i, lab, grams(t)) for i, lab, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if t and _LETTER.search(t)]
            shares = [np.round(255 * v).astype(np.uint8).tobytes() for _, _, v in some]  # a byte each: the sample is sent to the driver
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in some], pa.int64()), pa.array([s[1] for s in some], pa.string()), pa.array(shares, pa.binary())], names=["doc_id", "label", "x"])

    sample = sample_texts(docs, ids).select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "text")
    given = sample.mapInArrow(run, "doc_id bigint, label string, x binary").toArrow().to_pandas().sort_values(["doc_id", "label"], kind="stable")
    if given.empty:
        return Hierarchy()
    x = np.frombuffer(b"".join(given["x"]), np.uint8).reshape(-1, INPUTS)
    model = Hierarchy().fit(x, given["label"].tolist())
    del given, x
    give_back()
    return model


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    A text that is null or has no letter is ``und`` with score 1; so is every text, with score 0, if nothing was learned. Null ids
    stay null and count as not held out; repeated rows give repeated results; an empty table gives an empty result; other
    columns, whatever their names, are ignored. Whole texts are read.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows, rows=512):
            texts = batch.column(2).to_pylist()
            lettered = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
            langs, scores = [UNKNOWN] * len(texts), np.ones(len(texts))
            if lettered:
                found, chances = model.predict(np.stack([grams(texts[k]) for k in lettered]))
                for k, lang, chance in zip(lettered, found, chances, strict=True):
                    langs[k], scores[k] = lang, chance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(5).alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
