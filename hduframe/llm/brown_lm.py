"""Scoring by a class-based bigram model with Brown's exchange clustering.

Words are told apart by 64-bit hashes. Items are the most frequent words, the endings of other words, and one item for the rest.
Exchange clustering moves one item at a time to the class where the likelihood of the item bigrams is highest. Each other word
that was seen often enough then gets the class that suits its own counts of classes before and after it; only words hardly or
never seen share their ending's class. A token's chance given the token before is that of its class given the class before, times
that of the word in its class or, for rare words, of the item in its class and of the word within its item.

All counts are taken over all training documents. Only hashes, counts and classes of frequent words, bounded in number, go to
every task ("known" words); those of all others reach the documents by a shuffle join. As the context of what follows it, a word
that isn't known stands for its ending, so that a task knows every context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded, durable, held_out, part_runs, utf8, word_spans

#: Words that are items of their own; endings that are; bytes of an ending; words whose counts go to every task, at most.
WORDS, ENDINGS, ENDING_BYTES, KNOWN = 1000, 600, 4, 200_000
CLASSES, SWEEPS = 64, 6
#: Words that occur as often as this get a class of their own counts.
LEAST = 5
#: Added to counts of words, as in the base; weight of the classes' own shares in their transitions.
ADDED, BACKED_OFF = 0.1, 5.0
#: Tokens, or neighbours, that a task counts before it passes the counts on; parts of the known words' table.
HELD, BUCKETS = 1_000_000, 4096


@dataclass
class Run:
    """Words of some texts, one after the other."""

    rows: np.ndarray  # the batch's row of each text
    hashes: np.ndarray
    endings: np.ndarray  # the last bytes of each word as a number
    sizes: np.ndarray  # words of each text
    goes_on: bool  # the first text began in the run before
    open: bool  # the last text ends in a later run

    def row(self, kinds: np.ndarray, end: int, before: int) -> np.ndarray:
        """Kinds of all words, with ends around texts; ``before`` is the last of the row of the run before. A step goes from one
        of them to the next; the i-th word of the k-th text is second in step i + k."""
        starts = np.cumsum(self.sizes) - self.sizes
        return np.concatenate([[before if self.goes_on else end], np.insert(kinds, starts[1:], end), [] if self.open else [end]]).astype(np.int64)

    def texts(self) -> np.ndarray:
        """The batch's row of each step's text."""
        return np.repeat(self.rows, self.sizes + (1 if not self.open else np.arange(len(self.sizes)) < len(self.sizes) - 1))

    def places(self) -> np.ndarray:
        """The step in which each word is second."""
        return np.arange(len(self.hashes)) + np.repeat(np.arange(len(self.sizes)), self.sizes)


def tokenised(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[Run]:
    """Words are runs of anything but ASCII white space, A-Z lower-cased."""
    for rows, parts, goes_on, open_ in part_runs(texts, most):
        hashes, at, data, starts, stops = word_spans(parts)
        endings = np.zeros(len(hashes), np.int64)
        for k in range(1, ENDING_BYTES + 1):
            endings = endings * 256 + np.where(stops - k >= starts, data[np.maximum(stops - k, 0)], 0) if len(hashes) else endings
        yield Run(np.array(rows), hashes, endings, np.diff(at), goes_on, open_)


class Lookup:
    """Places of 64-bit hashes in a list, by their high bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.keys = hashes[self.order]
        bits = max(1, min(20, 2 + len(hashes).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where a hash isn't there."""
        found = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> self.shift).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        live = np.flatnonzero(at < stop)
        at, stop, wanted = at[live], stop[live], hashes[live]
        while len(live):
            hit = self.keys[at] == wanted
            found[live[hit]] = self.order[at[hit]]
            on = ~hit & (at + 1 < stop)
            live, at, stop, wanted = live[on], at[on] + 1, stop[on], wanted[on]
        return found


def _count_words(docs: DataFrame) -> DataFrame:
    """Rows (h, ending, c) over the training documents; h null stands for the end of a document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def full() -> pa.RecordBatch:
            h, at, n = np.unique(np.concatenate([x for x, _ in held] or [np.zeros(0, np.uint64)]), return_index=True, return_counts=True)
            endings = np.concatenate([x for _, x in held] or [np.zeros(0, np.int64)])[at]
            last = [None] if ends else []
            columns = [pa.concat_arrays([pa.array(x), pa.array(tail, pa.int64())]) for x, tail in ((h.view(np.int64), last), (endings, last), (n.astype(np.int64), [ends][: len(last)]))]
            return pa.RecordBatch.from_arrays(columns, names=["h", "ending", "c"])

        for batch in bounded(rows):
            ends += batch.num_rows
            for r in tokenised(utf8(batch.column(0))):
                held.append((r.hashes, r.endings))
                size += len(r.hashes)
                if size >= HELD:
                    yield full()
                    held, size, ends = [], 0, 0
        if size or ends:
            yield full()

    return docs.where(~held_out(10)).select("text").mapInArrow(run, "h bigint, ending bigint, c bigint").groupBy("h").agg(F.max("ending").alias("ending"), F.sum("c").alias("c"))


class Items:
    """Numbers of items: words first, then endings, the rest, and the end of a document."""

    def __init__(self, hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray, words: int, item_endings: np.ndarray) -> None:
        """The known words by falling count, of which the first ``words`` are items; the endings that are."""
        self.counts, self.words = counts, words
        self.lookup = Lookup(hashes)
        self.ending_order = np.argsort(item_endings, kind="stable")
        self.endings = item_endings[self.ending_order]
        self.rest = words + len(item_endings)
        self.end = self.rest + 1
        self.size = self.end + 1
        self.of_known = np.where(np.arange(len(hashes)) < words, np.arange(len(hashes)), self.of_ending(endings))

    def of_ending(self, endings: np.ndarray) -> np.ndarray:
        if not len(self.endings):
            return np.full(len(endings), self.rest, np.int64)
        at = np.minimum(np.searchsorted(self.endings, endings), len(self.endings) - 1)
        return np.where(self.endings[at] == endings, self.words + self.ending_order[at], self.rest)

    def read(self, hashes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, its place among the known ones (-1: not there) and its item."""
        places = self.lookup(hashes)
        far = np.flatnonzero(places < 0)
        items = self.of_known[places] if len(self.of_known) else np.full(len(places), self.rest, np.int64)
        items[far] = self.of_ending(endings[far])
        return places, items


def _count_steps(docs: DataFrame, items: Items, kind_of: np.ndarray, size: int, own: np.ndarray | None = None) -> np.ndarray:
    """How often, in training documents, a kind follows another, as a matrix: ``kind_of`` has the items' kinds; known words have
    the kinds ``own`` instead, where those aren't negative. Each task passes on a matrix at most."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size * size, np.int32)
        for batch in bounded(rows):
            before = 0
            for r in tokenised(utf8(batch.column(0))):
                places, numbers = items.read(r.hashes, r.endings)
                kinds = kind_of[numbers]
                if own is not None and len(own):
                    kinds = np.where((places >= 0) & (own[places] >= 0), own[places], kinds)
                row = r.row(kinds, kind_of[items.end], before)
                np.add.at(counts, row[:-1] * size + row[1:], 1)
                before = row[-1]
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(counts[codes].astype(np.int64))], names=["code", "n"])

    found = docs.where(~held_out(10)).select("text").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size)  # its size is bounded by that of the items
    matrix[np.asarray(found["code"], np.int64)] = np.asarray(found["n"], np.float64)
    return matrix.reshape(size, size)


def exchange_clusters(counts: np.ndarray, classes: int, sweeps: int, fixed: int) -> np.ndarray:
    """Class of each item, from the matrix of bigram counts. The item ``fixed`` has class 0 alone. Items start dealt out by
    falling count; each sweep moves every item to the class that raises the likelihood most."""
    size = len(counts)
    order = np.argsort(-(counts.sum(axis=0) + counts.sum(axis=1)), kind="stable")
    order = order[order != fixed]
    assigned = np.zeros(size, np.int64)
    if classes > 1:
        assigned[order] = 1 + np.arange(len(order)) % (classes - 1)
    onehot = np.zeros((size, classes))
    onehot[np.arange(size), assigned] = 1
    between = onehot.T @ counts @ onehot
    # per item: how often it follows, and is followed by, each class
    after, before = counts.T @ onehot, counts @ onehot
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-12))
    total_in, total_out = counts.sum(axis=0), counts.sum(axis=1)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = assigned[w], counts[w, w]
            left, right = after[w].copy(), before[w].copy()  # from classes to w, from w to classes
            left[a] -= own
            right[a] -= own
            between[:, a] -= left
            between[a, :] -= right
            between[a, a] -= own
            # wherever w goes, what precedes it counts in its classes' rows, and what follows it in columns
            rows, columns = between.sum(axis=1) + left, between.sum(axis=0) + right
            gain = (xlogx(between + left[:, None]) - xlogx(between)).sum(axis=0) + (xlogx(between + right[None, :]) - xlogx(between)).sum(axis=1)
            inner = np.diagonal(between)
            gain += xlogx(inner + left + right + own) - xlogx(inner + left) - xlogx(inner + right) + xlogx(inner)
            gain -= xlogx(rows + total_out[w]) - xlogx(rows) + xlogx(columns + total_in[w]) - xlogx(columns)
            gain[0] = -np.inf
            b = int(gain.argmax()) if classes > 1 else a
            between[:, b] += left
            between[b, :] += right
            between[b, b] += own
            if b != a:
                moved += 1
                assigned[w] = b
                after[:, a] -= counts[w, :]
                after[:, b] += counts[w, :]
                before[:, a] -= counts[:, w]
                before[:, b] += counts[:, w]
        if moved * 200 < len(order):
            break
    return assigned


@dataclass
class BrownModel:
    """What tasks need to score texts, but for the counts and classes of words that aren't known to them."""

    items: Items
    transition: np.ndarray  # log10 chance of a class after a class
    classes: np.ndarray  # of items
    emission: np.ndarray  # log10 chance of an item in its class, and of a word without its own count in the item
    of_place: np.ndarray  # class of each known word that has its own; -1: that of its item
    within: np.ndarray  # log10 of what a class's chances are shares of
    far: bool  # words that aren't known have classes of their own
    end_count: int
    train_tokens: int
    vocabulary: int


def _count_neighbours(docs: DataFrame, items: Items, classes: np.ndarray, far: bool) -> DataFrame:
    """How often classes stand before and after words that aren't items. For known words, rows (bucket, codes, ns), where code is
    (place * 2 + side) * number of classes + class; for others, if ``far``, rows (h, code, n), where code is class before * number
    of classes + class after."""
    size = int(classes.max()) + 1
    own = int((items.counts >= LEAST).sum())  # counts fall
    names = ["bucket", "codes", "ns", "h", "code", "n"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    row = lambda *columns: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def of_known(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = codes // (2 * size) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        codes, n, bucket = codes[order], n[order], bucket[order]
        found, at = np.unique(bucket, return_index=True)
        cut = lambda x: [part.astype(np.int32).tobytes() for part in np.split(x, at[1:])]
        none = [pa.nulls(len(found), k) for k in kinds[3:]]
        return row(found.astype(np.int32), cut(codes), cut(n), *none)

    def of_far(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, code = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.lexsort((code, h))
        h, code = h[order], code[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])]))
        n = np.diff(np.append(new, len(h)))
        none = [pa.nulls(len(new), k) for k in kinds[:3]]
        return row(*none, h[new].view(np.int64), code[new].astype(np.int32), n.astype(np.int32))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n, others, others_n = [], 0, [], 0
        pending = None  # of a text that goes on, its last word if that has no neighbour behind it yet
        for batch in bounded(rows):
            for r in tokenised(utf8(batch.column(0))):
                places, numbers = items.read(r.hashes, r.endings)
                kinds = classes[numbers]
                if pending is not None and r.goes_on:  # its word comes first once more, to get the class behind it
                    r = Run(r.rows, np.append(pending[0], r.hashes), np.append(pending[1], r.endings), r.sizes + (np.arange(len(r.sizes)) == 0), True, r.open)
                    places, numbers, kinds = np.append(pending[2], places), np.append(pending[3], numbers), np.append(pending[4], kinds)
                row = r.row(kinds, classes[items.end], pending[5] if pending is not None else classes[items.end])
                first, second, at = row[:-1], row[1:], r.places()
                count = len(places)
                if r.open and count:
                    pending = (r.hashes[-1], r.endings[-1], places[-1], numbers[-1], kinds[-1], first[at[-1]])
                    count -= 1
                elif not r.open:
                    pending = None
                places, at = places[:count], at[:count]
                before, after = first[at], second[np.minimum(at + 1, len(second) - 1)] if len(second) else at
                some = np.flatnonzero((places >= items.words) & (places < own))
                if len(some):
                    base = places[some] * 2 * size
                    held += [(base + before[some]).astype(np.int32), (base + size + after[some]).astype(np.int32)]
                    held_n += 2 * len(some)
                if far:
                    some = np.flatnonzero(places < 0)
                    others.append((r.hashes[some], before[some] * size + after[some]))
                    others_n += len(some)
                if held_n > HELD:
                    yield of_known(held)
                    held, held_n = [], 0
                if others_n > HELD // 4:
                    yield of_far(others)
                    others, others_n = [], 0
        if held_n:
            yield of_known(held)
        if others_n:
            yield of_far(others)

    return docs.where(~held_out(10)).select("text").mapInArrow(run, "bucket int, codes binary, ns binary, h bigint, code int, n int")


def _best_classes(neighbours: np.ndarray, transition: np.ndarray, within: np.ndarray) -> np.ndarray:
    """For each word the class that makes what stands around it most likely; a row has its counts of classes before, then after.
    Class 0 is the end's alone."""
    size = len(transition)
    score = neighbours @ np.concatenate([transition, transition.T]) - neighbours[:, :size].sum(axis=1, keepdims=True) * within
    score[:, 0] = -np.inf
    return score.argmax(axis=1)


def _assign(docs: DataFrame, items: Items, classes: np.ndarray, transition: np.ndarray, within: np.ndarray, far: bool) -> tuple[np.ndarray, DataFrame | None]:
    """Classes of known words, -1 where a word is an item or rare, and the table (h, class) of the others; none unless ``far``."""
    size = len(transition)

    def known(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = np.zeros((len(items.counts) // BUCKETS + 1) * 2 * size), None

        def full() -> pa.RecordBatch:
            lines = table.reshape(-1, 2 * size)
            seen = np.flatnonzero(lines.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(seen * BUCKETS + now, pa.int64()), pa.array(_best_classes(lines[seen], transition, within), pa.int32())], names=["place", "class"])

        for batch in rows:  # in the order of buckets
            for bucket, codes, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now is not None and bucket != now:
                    yield full()
                    table[:] = 0
                now = bucket
                codes = np.frombuffer(codes, np.int32)
                table[codes // (2 * size) // BUCKETS * 2 * size + codes % (2 * size)] += np.frombuffer(n, np.int32)
        if now is not None:
            yield full()

    def others(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                lists = batch.column(1)
                each = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
                code, n = (np.asarray(lists.flatten().field(k)) for k in (0, 1))
                table = np.zeros((batch.num_rows, 2 * size))
                np.add.at(table, (each, code // size), n)
                np.add.at(table, (each, size + code % size), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_best_classes(table, transition, within), pa.int32())], names=["h", "class"])

    counted = durable(_count_neighbours(docs, items, classes, far), "neighbours")
    of_place = np.full(len(items.counts), -1, np.int16)
    found = counted.where(F.col("bucket").isNotNull()).select("bucket", "codes", "ns").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(known, "place bigint, class int").toArrow()
    of_place[np.asarray(found["place"])] = np.asarray(found["class"])
    if not far:
        return of_place, None
    # a word's rows are dealt out once; as it has a row for each pair of classes at most, its list is bounded
    by_code = counted.where(F.col("h").isNotNull()).select("h", "code", "n").repartition("h").groupBy("h", "code").agg(F.sum("n").alias("n"))
    by_word = by_code.groupBy("h").agg(F.collect_list(F.struct("code", F.col("n").cast("int").alias("n"))).alias("around"), F.sum("n").alias("c"))
    return of_place, by_word.where(F.col("c") >= LEAST).select("h", "around").mapInArrow(others, "h bigint, class int")


_READ = [
    ("rid", "bigint", pa.int64()),
    ("doc_id", "bigint", pa.int64()),
    ("held_out", "boolean", pa.bool_()),
    ("n_tokens", "bigint", pa.int64()),
    ("known", "bigint", pa.int64()),
    ("base", "double", pa.float64()),
    ("model", "double", pa.float64()),
    ("h", "bigint", pa.int64()),
    ("before", "int", pa.int32()),
    ("item", "int", pa.int32()),
    ("times", "int", pa.int32()),
]


def _read(docs: DataFrame, model: BrownModel) -> DataFrame:
    """For each document a row with the sums over words that tasks know, and rows (rid, h, before, item, times) of the words that
    they don't: the class before the word, the item of its ending, and how often it occurs so."""
    items, classes = model.items, model.classes
    size = len(model.transition)
    names, kinds = [n for n, _, _ in _READ], [k for _, _, k in _READ]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.append(np.log10(items.counts + ADDED), 0.0)  # the last is for words that aren't known
        own_class = np.append(model.of_place.astype(np.int64), -1)
        class_of = np.where(own_class >= 0, own_class, np.append(classes[items.of_known], 0))
        item_of = np.append(items.of_known, 0)
        # of rare words, the count is part of the chance within their ending's item
        chances = np.where(own_class >= 0, logs - model.within[own_class], model.emission[item_of] + np.where(item_of < items.words, 0.0, logs))
        end_log = np.log10(model.end_count + ADDED)
        end_class, end_gain = classes[items.end], model.emission[items.end]
        for batch in bounded(rows):
            n = batch.num_rows
            n_tokens, known = np.ones(n, np.int64), np.full(n, int(model.end_count > 0), np.int64)
            base, gained = np.full(n, end_log), np.full(n, end_gain)
            rids = np.asarray(batch.column(0))
            before, far = 0, []
            for r in tokenised(utf8(batch.column(3))):
                places, numbers = items.read(r.hashes, r.endings)
                is_far = places < 0
                kind = np.where(is_far, classes[numbers], class_of[places])
                row = r.row(kind, end_class, before)
                first, second, at, text = row[:-1], row[1:], r.places(), r.texts()
                before = row[-1]
                steps = model.transition[first, second]
                owner = text[at]
                steps[at[is_far]] = 0.0
                gained += np.bincount(text, steps, n) + np.bincount(owner, np.where(is_far, 0.0, chances[places]), n)
                base += np.bincount(owner, logs[places], n)
                n_tokens += np.bincount(owner, minlength=n)
                known += np.bincount(owner, ~is_far, n).astype(np.int64)
                some = np.flatnonzero(is_far)
                if len(some):
                    # equal words of a text with the same class before them as one row
                    columns = (rids[owner[some]], r.hashes[some], first[at[some]], numbers[some])
                    order = np.lexsort((columns[2], columns[1], columns[0]))
                    columns = [c[order] for c in columns]
                    new = np.flatnonzero(np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])]))
                    far.append([*(c[new] for c in columns), np.diff(np.append(new, len(order)))])
            given = [*(batch.column(k) for k in range(3)), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(gained)]
            yield pa.RecordBatch.from_arrays([*given, *(pa.nulls(n, k) for k in kinds[7:])], names=names)
            for rid, h, prior, item, times in far:
                arrays = [pa.array(rid), *(pa.nulls(len(rid), k) for k in kinds[1:7]), pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (prior, item, times))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    given = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out(10).alias("held_out"), "text")
    return durable(given.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in _READ)), "read")


def _transitions(between: np.ndarray) -> np.ndarray:
    share = (between.sum(axis=0) + 0.5) / (between.sum() + 0.5 * len(between))
    return np.log10((between + BACKED_OFF * share) / (between.sum(axis=1, keepdims=True) + BACKED_OFF))


def _known_from(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words occur as often: found from numbers of words in steps of counts, of which
    there are a few hundred, so that no words are sorted."""
    step = F.when(F.col("c") < 64, F.col("c").cast("double")).otherwise(64 + F.floor(16 * (F.log2("c") - 6)))
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, 1
    for k, r in enumerate(steps):
        total += r.words
        if total > most:
            return steps[k - 1].least if k else r.least + (1 << 62)
        least = r.least
    return least


def train(docs: DataFrame) -> tuple[BrownModel, DataFrame]:
    """The model, and the table (h, c, class) of all training words; class is null where tasks know the word or it has none of
    its own."""
    counted = durable(_count_words(docs), "words")
    ends = counted.where(F.col("h").isNull()).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first().c
    counts = counted.where(F.col("h").isNotNull())
    rare = F.col("c") < LEAST
    rarely = [F.coalesce(F.sum(F.when(rare, F.col("c"))), F.lit(0)).alias("rare_n"), F.count(F.when(rare, 1)).alias("rare_v")]
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), *rarely).first()
    least = _known_from(counts, KNOWN)
    top = counts.where(F.col("c") >= least).toArrow()  # at most KNOWN rows
    order = np.lexsort((np.asarray(top["h"]), -np.asarray(top["c"])))
    hashes, endings, of_known = (np.asarray(top[k])[order] for k in ("h", "ending", "c"))
    words = min(WORDS, len(hashes))
    others = counts.where(~F.col("h").isin(hashes[:words].tolist())) if words else counts
    by_ending = others.groupBy("ending").agg(F.sum("c").alias("n"), *rarely)
    chosen = by_ending.orderBy(F.desc("n"), "ending").limit(ENDINGS).toArrow()
    items = Items(hashes.view(np.uint64), endings, of_known, words, np.asarray(chosen["ending"], np.int64))
    numbers = np.arange(items.size)
    matrix = _count_steps(docs, items, numbers, items.size)
    classes = exchange_clusters(matrix, min(CLASSES, items.size), SWEEPS, items.end)
    size = int(classes.max()) + 1
    between, within = np.zeros((size, size)), np.zeros(size)
    np.add.at(between, (classes[:, None], classes[None, :]), matrix)
    np.add.at(within, classes, matrix.sum(axis=0) + ADDED)
    far = len(hashes) < totals.v and least > LEAST  # else no word that isn't known occurs often enough
    of_place, others_classes = _assign(docs, items, classes, _transitions(between), np.log10(within), far)
    none = F.lit(None).cast("int").alias("class")
    unknown = counts.where(F.col("c") < least)
    counts = durable(unknown.join(others_classes, "h", "left").select("h", "c", "class"), "classed") if far else unknown.select("h", "c", none)
    # Items now stand for the words without a class of their own. A word's chance in its ending's item is
    # (c + ADDED) / (n + ADDED * (v + 1)); one without a count takes the place of all unseen.
    n, v = np.zeros(items.size), np.zeros(items.size)
    n[words : items.rest], v[words : items.rest] = np.asarray(chosen["rare_n"]), np.asarray(chosen["rare_v"])
    first = of_known[:words]
    n[items.rest] = float(totals.rare_n - first[first < LEAST].sum() - n[words : items.rest].sum())
    v[items.rest] = float(totals.rare_v - (first < LEAST).sum() - v[words : items.rest].sum())
    own = n + ADDED
    own[:words], own[items.end] = first + ADDED, float(ends) + ADDED
    within = np.zeros(size)
    np.add.at(within, classes, own)
    classed = of_place >= 0
    np.add.at(within, of_place[classed], of_known[classed] + ADDED)
    if far:
        for r in counts.where(F.col("class").isNotNull()).groupBy("class").agg(F.sum(F.col("c") + F.lit(ADDED)).alias("n")).collect():
            within[r["class"]] += r.n
    within = np.log10(np.maximum(within, ADDED))
    emission = np.log10(own) - within[classes]
    emission -= np.where((numbers >= words) & (numbers <= items.rest), np.log10(n + ADDED * (v + 1)), 0)
    transition = _transitions(_count_steps(docs, items, classes, size, of_place.astype(np.int64)))
    return BrownModel(items, transition, classes, emission, of_place, within, far, int(ends), int(totals.n + ends), int(totals.v + (ends > 0))), counts


def score(docs: DataFrame, model: BrownModel, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``; scores are log10 chances of
    the whole text with its end.

    A null text counts as empty and has the end as its one token; without training documents all words are unseen; null ids stay
    null and count as training documents; repeated rows give repeated results; an empty table gives an empty result; other
    columns, whatever their names, are ignored. Long texts are read whole, in parts.
    """
    spark = docs.sparkSession
    read = _read(docs, model)
    size = len(model.transition)
    # small tables: a row for each pair of classes, and one for each item
    steps = spark.createDataFrame([(k * size + j, float(model.transition[k, j])) for k in range(size) for j in range(size)], "step int, chance double")
    shares = spark.createDataFrame([(k, float(x)) for k, x in enumerate(model.within)], "class int, share double")
    of_item = spark.createDataFrame([(k, int(model.classes[k]), float(x)) for k, x in enumerate(model.emission)], "item int, item_class int, item_chance double")
    words = read.where(F.col("h").isNotNull()).select("rid", "h", "before", "item", "times").join(counts, "h", "left")
    words = words.join(F.broadcast(of_item), "item").join(F.broadcast(shares), "class", "left")
    words = words.withColumn("step", F.col("before") * size + F.coalesce("class", "item_class")).join(F.broadcast(steps), "step")
    c = F.coalesce(F.col("c"), F.lit(0))
    log_count = F.log10(c + F.lit(ADDED))
    chance = F.col("chance") + log_count + F.coalesce(-F.col("share"), F.col("item_chance"))
    sums = words.groupBy("rid").agg(
        F.sum(F.col("times") * log_count).alias("more_base"), F.sum(F.col("times") * chance).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    joined = read.where(F.col("h").isNull()).join(sums, "rid", "left")
    none = np.log10(model.train_tokens + ADDED * (model.vocabulary + 1))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(none))).alias("base_score"),
        (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
