"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token sequences, longer ones cut; pieces are dealt evenly into blocks of bounded size. For each block, several
islands evolve packings: a chromosome is a list of bins; crossover injects whole well-filled bins of one parent into the other,
removes the bins there that hold the same pieces, and puts the displaced pieces where they fit best. After each epoch the elite
of each island migrates to the next island. The least filled bins of neighbouring blocks are packed once more together.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, bounded, durable, of_worker, utf8
from .units import byte_symbols

CAPACITY = 4096
END = 1
BLOCK = 2000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 5
#: Blocks whose least filled bins are packed again together.
REJOINED = 64

#: White space outside ASCII, and control characters that some readers take for white space: such texts are encoded in one go.
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


#: Lower-case ASCII and Latin-1 letters in UTF-8.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+\Z")
_SYMBOLS = {b: symbol for symbol, b in byte_symbols().items()}
_ODD_CONTROLS = b"\x1c\x1d\x1e\x1f"
#: ASCII punctuation but for the apostrophe, which begins pieces of its own.
_TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Ends of chunks that are remembered, and the length up to which they are.
ENDS, END_BYTES = 4096, 16


class SpacelessEncoder:
    """Ids by a ``tokenizers`` file that lower-cases and drops white space, special strings as the library handles them by
    default. What stands between white space is encoded once and remembered; of what isn't remembered, a plain word and the
    punctuation behind it are encoded separately: no piece reaches over."""

    def __init__(self, path: str, remember: int = 56_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = Memo(remember)
        self.ends: dict[bytes, bytes] = {b"": b""}

    def _by_library(self, chunks: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in coded]

    def _end(self, end: bytes) -> bytes:
        found = self.ends.get(end)
        if found is None:
            (found,) = self._by_library([end])
            if len(self.ends) < ENDS and len(end) <= END_BYTES:
                self.ends[end] = found
        return found

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """A word of plain lower-case letters is given to the library's model itself, as its normaliser leaves it alone and its
        splitter finds one piece; all but it and the punctuation behind it to the whole library."""
        tokenize, kept, new = self.tokenizer.model.tokenize, self.chunks.kept.get, {}
        out, rest = [], []
        for c in chunks:
            word = c.rstrip(_TAIL)
            # isalpha is about ASCII here, and chunks are lower-cased; special strings are left whole
            if not (ascii := word.isalpha()) and not _PLAIN.match(word) or b"<|" in c:
                rest.append(len(out))
                out.append(c)
                continue
            ids = kept(word) or new.get(word)
            if ids is None:
                symbols = word.decode() if ascii else word.decode("latin-1").translate(_SYMBOLS)
                ids = new[word] = array("I", [t.id for t in tokenize(symbols)]).tobytes()
            out.append(ids if len(word) == len(c) else ids + self._end(c[len(word) :]))
        for k, ids in zip(rest, self._by_library([out[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _units(self, data: bytes) -> list[bytes]:
        odd = len(data) != len(data.translate(None, _ODD_CONTROLS)) if data.isascii() else _ODD_SPACE.search(data)
        if odd or any(s in data for s in self.special):
            return [data]
        return data.lower().split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return list(map(b"".join, self.chunks.each([self._units(x) for x in texts], self._encode)))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Rows (rid, doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut every ``capacity`` ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(("spaceless", path), lambda: SpacelessEncoder(path))
        last = np.array([end], "<u4").tobytes()
        for batch in bounded(rows):
            out = []
            for rid, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoder.encode(utf8(batch.column(2))), strict=True):
                ids += last
                for k in range(0, len(ids) // 4, capacity):
                    some = ids[4 * k : 4 * (k + capacity)]
                    out.append((rid, doc_id, k // capacity, k, len(some) // 4, zlib.crc32(some)))
            kinds = [pa.int64(), batch.column(1).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, f"rid bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class GroupingGenetic:
    """Packings of ``lengths`` (each at most ``capacity``): lists of bins, a bin being a list of positions in ``lengths``."""

    def __init__(self, lengths: list[int], capacity: int, seed: int) -> None:
        self.lengths, self.capacity, self.random = lengths, capacity, random.Random(seed)
        self.bound = -(-sum(lengths) // capacity)

    def fill(self, one: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, one))

    def fitness(self, packing: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first; then bins as unevenly filled as can be, as these are easier to improve."""
        return -len(packing), sum((self.fill(b) / self.capacity) ** 2 for b in packing)

    def best_fit(self, items: list[int], bins: list[list[int]]) -> list[list[int]]:
        """Put the items, in this order, each into the bin that it leaves the least room in; new bins where none has room."""
        bins = [list(b) for b in bins]
        room = sorted((self.capacity - self.fill(b), k) for k, b in enumerate(bins))
        for item in items:
            need = self.lengths[item]
            at = bisect_left(room, (need, -1))
            if at == len(room):
                bins.append([item])
                insort(room, (self.capacity - need, len(bins) - 1))
            else:
                left, k = room.pop(at)
                bins[k].append(item)
                insort(room, (left - need, k))
        return bins

    def first_packings(self, count: int) -> Iterator[list[list[int]]]:
        """Best fit by falling length, then by lengths that chance has changed."""
        for n in range(count):
            blur = 0.15 * n
            yield self.best_fit(sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i] * (1 + blur * self.random.random()), i)), [])

    def crossover(self, mother: list[list[int]], father: list[list[int]]) -> list[list[int]]:
        """Whole well-filled bins of the father go into the mother; bins of hers with the same items, and a few of her least
        filled ones, are emptied; the displaced items are put where they fit best."""
        fullest = sorted(father, key=self.fill, reverse=True)
        injected = self.random.sample(fullest[: max(1, len(fullest) // 2)], max(1, len(fullest) // 8))
        present = {i for b in injected for i in b}
        kept = [b for b in mother if present.isdisjoint(b)]
        kept.sort(key=self.fill, reverse=True)
        del kept[len(kept) - min(len(kept), self.random.randint(1, 3)) :]
        held = present.union(*kept)
        displaced = sorted((i for i in range(len(self.lengths)) if i not in held), key=lambda i: -self.lengths[i])
        return self.best_fit(displaced, injected + kept)

    def evolve(self, migrants: list[list[list[int]]], population: int, generations: int) -> list[list[int]]:
        """The best packing. Ends early where the fewest possible bins are reached."""
        people = list(migrants)
        for packing in self.first_packings(population):
            if any(len(p) <= self.bound for p in people):
                break
            people.append(packing)
        people.sort(key=self.fitness, reverse=True)
        for _ in range(generations):
            if len(people[0]) <= self.bound or len(people) < 2:
                break
            children = [self.crossover(*self.random.sample(people, 2)) for _ in range(population - 1)]
            people = sorted(people + children, key=self.fitness, reverse=True)[:population]
        return people[0] if people else []


_EVOLVED = "block bigint, island int, rid bigint, piece int, length bigint, bin int, bins int"


def _epoch(rows: DataFrame, capacity: int, population: int, generations: int, epoch: int) -> DataFrame:
    """Evolve each (block, island). Rows with a bin are packings that came from (``origin``) islands."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        block, island = (k.as_py() for k in key)
        rid, piece, length = (np.asarray(group[c]) for c in ("rid", "piece", "length"))
        order = np.lexsort((piece, rid, length))  # a piece is there once for each migrant
        new = np.ones(len(order), bool)
        new[1:] = (rid[order][1:] != rid[order][:-1]) | (piece[order][1:] != piece[order][:-1])
        item = np.empty(len(order), np.int64)
        item[order] = np.cumsum(new) - 1
        own = order[new]
        search = GroupingGenetic(length[own].tolist(), capacity, hash((block, island, epoch)))
        migrants = []
        if "bin" in group.column_names:
            origin, at = np.asarray(group["origin"]), np.asarray(group["bin"])
            for one in np.unique(origin):
                bins: dict[int, list[int]] = {}
                for number, n in sorted(zip(at[origin == one].tolist(), item[origin == one].tolist(), strict=True)):
                    bins.setdefault(number, []).append(n)
                migrants.append([bins[b] for b in sorted(bins)])
        packing = search.evolve(migrants, population, generations)
        place = np.zeros(len(own), np.int32)
        for k, members in enumerate(packing):
            place[members] = k
        same = lambda x, kind: pa.array(np.full(len(own), x), kind)
        columns = [same(block, pa.int64()), same(island, pa.int32()), pa.array(rid[own]), pa.array(piece[own]), pa.array(length[own]), pa.array(place), same(len(packing), pa.int32())]
        return pa.table(columns, names=["block", "island", "rid", "piece", "length", "bin", "bins"])

    return rows.groupBy("block", "island").applyInArrow(run, _EVOLVED)


def _evolved(items: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """Rows (block, rid, piece, length, bin): for each block, the packing of its best island."""
    rows = items.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))
    found = _epoch(rows, capacity, population, generations, 0)
    for epoch in range(1, epochs):
        # the elite of each island stays there and also goes to the next one
        moved = found.select("block", F.explode(F.array(*[F.struct(((F.col("island") + k) % islands).cast("int").alias("to"), F.col("island").alias("origin")) for k in range(min(2, islands))])).alias("m"), "rid", "piece", "length", "bin")
        found = _epoch(moved.select("block", F.col("m.to").alias("island"), F.col("m.origin").alias("origin"), "rid", "piece", "length", "bin"), capacity, population, generations, epoch)
    best = F.min(F.struct("bins", "island")).over(Window.partitionBy("block"))
    return found.withColumn("best", best).where(F.col("island") == F.col("best.island")).select("block", "rid", "piece", "length", "bin")


def pack(
    given: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS
) -> DataFrame:
    """``given``: rows with rid, piece and length (1 to ``capacity``); adds sequence_id and offset. Every sequence is filled from
    offset 0 without gaps and holds at most ``capacity`` tokens."""
    blocks = max(1, -(-given.count() // block))
    items = given.where(F.col("length") < capacity).select(F.pmod(F.xxhash64("rid", "piece"), F.lit(blocks)).alias("block"), "rid", "piece", "length")
    settings = (capacity, islands, epochs, population, generations)
    first = durable(_evolved(items, *settings), "packed")
    # of each block, the least filled bin is packed again with those of other blocks
    filled = first.groupBy("block", "bin").agg(F.sum("length").alias("filled"))
    worst = filled.groupBy("block").agg(F.min(F.struct("filled", "bin")).alias("w")).select("block", F.col("w.bin").alias("worst"))
    marked = first.join(worst, "block")
    again = marked.where(F.col("bin") == F.col("worst")).select((F.col("block") / REJOINED).cast("bigint").alias("block"), "rid", "piece", "length")
    placed = marked.where(F.col("bin") != F.col("worst")).select(F.lit(0).alias("kind"), "block", "bin", "rid", "piece", "length")
    placed = placed.unionByName(_evolved(again, *settings).select(F.lit(1).alias("kind"), "block", "bin", "rid", "piece", "length"))
    order = Window.partitionBy("kind", "block", "bin").orderBy("rid", "piece").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("kind").cast("bigint") * (1 << 61) + F.col("block") * (1 << 20) + F.col("bin")
    placed = placed.select("rid", "piece", number.alias("sequence_id"), F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    # A full piece is a sequence of its own; these have negative numbers.
    full = given.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return given.where(F.col("length") < capacity).join(placed, ["rid", "piece"]).unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of the end id alone; documents of more than ``capacity`` ids are cut into pieces of that
    many, the last may be shorter, and no other document is cut. Repeated rows are packed as documents of their own; a null
    doc_id stays null; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    given = durable(pieces(docs, path, capacity), "pieces")
    return pack(given, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
