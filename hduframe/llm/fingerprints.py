"""Document fingerprints by one-permutation MinHash.

Every shingle's hash is split once into a bin and a value; a bin keeps its least value. Empty bins are filled by optimal
densification: each draws bins from its own sequence of a two-universal hash until it meets one that was filled from the text.
Only the low bits of each bin are stored, packed; chance agreement of these bits is taken off when two fingerprints are compared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shingles, splitmix, utf8

BINS = 512
BITS = 4
#: Bins that an empty one looks at, one after the other, that are drawn beforehand; more are drawn when they are needed.
DRAWS = 4096
#: About as many bytes of text go to a run of rows, more where there would be more than RUNS runs: their bounds are in the plan.
RUN_BYTES, RUNS = 16 << 20, 20_000


class MinHash:
    """Packed fingerprints of sets of 64-bit hashes. ``bins`` is a power of two; ``bits`` is 1, 2, 4 or 8.

    The fingerprint of an empty set is empty. Likeness of two empty fingerprints is 1, of an empty and another 0.
    """

    def __init__(self, bins: int = BINS, bits: int = BITS) -> None:
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two and bits one of 1, 2, 4, 8")
        self.bins, self.bits = bins, bits
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        # The n-th bin that the empty bin k looks at: multiply, add and shift, with random numbers of its own for each k.
        chance = np.random.default_rng(20_240_229)
        self.factor = chance.integers(0, 1 << 63, bins, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.addend = chance.integers(0, 1 << 63, bins, dtype=np.uint64)
        self.draws = self._draw(1, DRAWS, slice(None))

    def _draw(self, first: int, count: int, bins) -> np.ndarray:
        """Draws of some bins; as factors are odd, every bin comes up sooner or later."""
        return ((np.arange(first, first + count, dtype=np.uint64)[:, None] * self.factor[bins] + self.addend[bins]) >> self.shift).astype(np.int16)

    def of(self, hashes: np.ndarray) -> bytes:
        """``hashes``: sorted and distinct."""
        if not len(hashes):
            return b""
        bins = (hashes >> self.shift).astype(np.int64)
        first = np.empty(len(bins), bool)  # hashes are sorted, so a bin's first one has its least value
        first[0] = True
        np.not_equal(bins[1:], bins[:-1], out=first[1:])
        own = bins[first]
        values = np.zeros(self.bins, np.uint64)
        filled = np.zeros(self.bins, bool)
        values[own] = hashes[first]
        filled[own] = True
        empty = np.flatnonzero(~filled)
        if len(own) == 1:
            values[:] = values[own[0]]
            empty = empty[:0]
        step, n = max(8, min(DRAWS, 4 * self.bins // len(own))), 0
        while len(empty):
            looked = self.draws[n : n + step, empty] if n + step <= DRAWS else self._draw(n + 1, step, empty)
            n += step
            hit = filled[looked]
            at = hit.argmax(axis=0)
            column = np.arange(len(empty))
            good = hit[at, column]
            values[empty[good]] = values[looked[at, column][good]]
            empty = empty[~good]
        # A few shingles fill all bins, and their own low bits may agree by chance; so bits come from a mix of value and bin.
        low = (splitmix(values ^ self.addend) >> np.uint64(64 - self.bits)).astype(np.uint8)
        if self.bits == 4:
            return (low[::2] << np.uint8(4) | low[1::2]).tobytes()
        return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - self.bits :].reshape(-1)).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimate of the Jaccard similarity, 0 to 1."""
        if not a or not b:
            return float(not a and not b)
        different = np.bitwise_xor(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8))
        if self.bits == 4:
            agree = 1 - (np.count_nonzero(different & 0xF0) + np.count_nonzero(different & 0x0F)) / self.bins
        elif self.bits < 8:
            agree = 1 - np.count_nonzero(np.unpackbits(different).reshape(-1, self.bits).any(axis=1)) / self.bins
        else:
            agree = 1 - np.count_nonzero(different) / self.bins
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def fingerprints(df: DataFrame, bins: int = BINS, bits: int = BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: id and fingerprint (binary) of its set of five-word shingles. Null and empty texts have an empty
    one; a null id stays null; repeated rows give repeated results; an empty table gives an empty result; other columns, whatever
    their names, are ignored."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bins, bits)
        for batch in bounded(rows):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hasher.of(s) for s in shingles(utf8(batch.column(1)))], pa.binary())], names=[id_column, "fingerprint"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, fingerprint binary")


def with_next(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """Rows (run, own, doc_id, text), dealt out and sorted such that each row's successor by doc_id follows it.

    Ids are split into runs at quantiles. The first row of each run also goes, with own false, to the end of the run before,
    and the very first row of all to the end of the last run, so that no run needs another one. Null ids come first; rows of
    equal ids are ordered by text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if runs is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
        runs = min(max(2, -(-(size or 0) // RUN_BYTES)), RUNS)
    least = F.lit(-(1 << 63)).cast("bigint")
    at = F.coalesce(F.col("doc_id"), least)
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [k / runs for k in range(1, runs)], 0.2 / runs)))
    placed = docs.withColumn("run", _bisect(at, [int(c) for c in cuts]))
    firsts = sorted((r.run, r.least) for r in placed.groupBy("run").agg(F.min(at).alias("least")).collect())
    if not firsts:
        return placed.select("run", F.lit(True).alias("own"), F.lit(0).alias("late"), "doc_id", "text")
    # For each run its first id, and the run with rows before it; for the first of all, the last one.
    first_ids, before = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, (number, first_id) in enumerate(firsts):
        first_ids[number], before[number] = first_id, firsts[k - 1][0]
    own = F.struct(F.col("run").alias("run"), F.lit(True).alias("own"))
    ahead = F.struct(F.get(F.array(*map(F.lit, before)), F.col("run")).alias("run"), F.lit(False).alias("own"))
    is_first = F.get(F.array(*[F.lit(x).cast("bigint") for x in first_ids]), F.col("run")) == at
    copies = F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))
    spread = placed.select(F.explode(copies).alias("to"), "doc_id", "text").select("to.run", "to.own", "doc_id", "text")
    spread = spread.withColumn("late", (~F.col("own")).cast("int"))
    # a key for each run that Spark's hash deals to a partition of its own
    keys = spark.range(16 * runs * max(1, runs.bit_length())).select("id", F.pmod(F.hash("id"), F.lit(runs)).alias("to")).groupBy("to").agg(F.min("id").alias("key")).collect()
    key = [-1 - k for k in range(runs)]
    for r in keys:
        key[r.to] = r.key
    to = F.get(F.array(*[F.lit(k).cast("bigint") for k in key]), F.col("run"))
    return spread.repartition(runs, to).sortWithinPartitions("run", "late", F.col("doc_id").asc_nulls_first(), "text")


def _bisect(value, cuts: list[int]):
    """How many of the sorted cuts are at most the value: first among every step-th cut, then among those up to the next."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    among = lambda cs: F.array(*[F.lit(c).cast("bigint") for c in cs])
    coarse = F.size(F.filter(among(cuts[step - 1 :: step]), lambda c: c <= value)) * step
    return coarse + F.size(F.filter(F.slice(among(cuts), coarse + 1, step), lambda c: c <= value))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of its fingerprint to those of the edited text and
    of the next document, by ascending doc_id; after the last comes the first.

    A null or empty text has an empty fingerprint; a table of one row is its own successor; null ids come first, rows of equal
    ids are ordered by text; repeated rows give repeated results; an empty table gives an empty result; other columns, whatever
    their names, are ignored.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bins, bits)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def compared(pairs: list[tuple]) -> pa.RecordBatch:
            edits = [edited_text(text, following) for _, text, following in pairs]
            given = [text.encode() for _, text, _ in pairs] + [e.encode() for e in edits] + [following.encode() for _, _, following in pairs[-1:]]
            prints = [hasher.of(s) for s in shingles(given)]
            n = len(pairs)
            rest = []
            for k, (doc_id, text, following) in enumerate(pairs):
                after = prints[k + 1] if k + 1 < n and pairs[k + 1][1] is following else prints[2 * n] if k == n - 1 else hasher.of(next(shingles([following.encode()])))
                own, edited = prints[k], prints[n + k]
                rest.append((doc_id, len(text), hashlib.sha256(given[n + k]).hexdigest(), base64.b64encode(own).decode(), base64.b64encode(edited).decode(), hasher.likeness(own, edited), hasher.likeness(own, after)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rest, strict=True), kinds, strict=True)], names=names)

        waiting, pairs, size, done = None, [], 0, None
        for batch in bounded(rows):
            for at, own, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if waiting is not None and waiting[0] == at:
                    pairs.append((waiting[1], waiting[2], text))
                    size += len(text)
                waiting = (at, doc_id, text) if own else None  # after the first row that isn't its own, the run is over
                if size > 1 << 20 or len(pairs) >= 1024:
                    yield compared(pairs)
                    pairs, size = [], 0
        if pairs:
            yield compared(pairs)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).select("run", "own", "doc_id", "text").mapInArrow(run, schema)
