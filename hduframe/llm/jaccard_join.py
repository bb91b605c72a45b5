"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Rows of the matrix are classes of documents with equal shingle sets, columns are shingles. All classes order shingles alike,
those known to be frequent last, so that two sets alike enough share one among their first few: only these columns are kept.
A column's classes are first multiplied with one of them alone, in a few rounds; what links join is contracted. The whole product
is then taken only of columns that still hold classes of different components, adding up overlaps over columns: those of few
classes as joined rows, those of many in blocks of columns and of classes, as matrices. Blocks whose sizes can't match, or that
belong to one component, aren't multiplied. Pairs are discarded where their sizes and the overlaps of their first shingles, or
how their shingles spread over buckets, keep them below the threshold; what is left is compared whole. Copies, and near copies
that are joined already, thus never become pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, batches, bounded, discard, durable, numbered, shingles, signature, utf8
from .components import components

#: Two sets link when their similarity is at least 80 / 100.
THRESHOLD = (80, 100)
#: Frequent shingles whose order is known: only the order, not the result, depends on them.
FREQUENT = 65_536
#: Hashes that a task counts at a time, and the count from which it reports a shingle.
COUNTED, REPORTED = 600_000, 4
#: Bits of the filter that finds the documents of candidate pairs again; others that it lets through are dropped by a join.
FILTER_BITS = 1 << 24


#: Buckets over which a set's shingles are counted; a count of SATURATED or more says nothing.
BUCKETS, SATURATED = 256, 255
#: Rounds against one class of each column go on while at least this share of the pairs compared are links.
WORTHWHILE, ROUNDS = 0.05, 3
#: Classes of a column from which its product is taken in blocks, of about BLOCK classes, COLUMNS columns at a time: above this many,
#: rows of pairs weigh more than rows of classes with their columns.
CROWDED, BLOCK, COLUMNS = 16, 512, 1024
#: A frequent shingle's rows are dealt out to as many tasks.
SALTS = 256


def _as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _two_longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _key(digest: bytes, twice: frozenset[int]) -> int:
    """The number of a class: 64 bits of its digest, or the other 64 where several digests share the first."""
    first, second = _two_longs(digest)
    return second if first in twice else first


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """Rows (rid, doc_id, n, s, s2, spread) for documents: s and s2 stand for the set, spread has its counts in buckets. Rows (h, c)
    for shingles frequent in a task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.struct([("f", pa.int64()), ("r", pa.int64())]), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        names = ["rid", "doc_id", "n", "s", "s2", "spread", "h", "c"]
        waiting, size = [], 0

        def counted() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(waiting), return_counts=True)
            often = counts >= REPORTED
            nulls = [pa.nulls(int(often.sum()), k) for k in kinds[:6]]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(_as_long(found[often])), pa.array(counts[often].astype(np.int64))], names=names)

        for batch in bounded(rows):
            out = []
            for hashes in shingles(utf8(batch.column(2)), words):
                spread = np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), SATURATED).astype(np.uint8)
                out.append((len(hashes), *_two_longs(signature(hashes)), spread.tobytes()))
                waiting.append(hashes)
                size += len(hashes)
                if size >= COUNTED:
                    yield counted()
                    waiting, size = [], 0
            rid = pa.StructArray.from_arrays([batch.column(0).field(k) for k in (0, 1)], names=["f", "r"])  # whose parts may be null, as in the other rows
            given = [rid, batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds[2:6], strict=True))]
            yield pa.RecordBatch.from_arrays([*given, *(pa.nulls(len(out), k) for k in kinds[6:])], names=names)
        if waiting:
            yield counted()

    return docs.mapInArrow(run, "rid struct<f: bigint, r: bigint>, doc_id bigint, n bigint, s bigint, s2 bigint, spread binary, h bigint, c bigint")


def _prefixes(docs: DataFrame, words: int, twice: frozenset[int], frequent: np.ndarray, order: np.ndarray, threshold: tuple[int, int]) -> DataFrame:
    """Rows (h, s, n, place, often): of each set, the shingles that come first in the common order; often: those in ``frequent``."""
    num, den = threshold

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in bounded(rows):
            found, keys, sizes, marks = [], [], [], []
            for hashes in shingles(utf8(batch.column(2)), words):
                n = len(hashes)
                if not n:
                    continue
                s = _key(signature(hashes), twice)
                if s in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(s)
                often = np.zeros(n, bool)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                    often = frequent[at] == hashes
                    hashes = np.concatenate([hashes[~often], hashes[often][np.argsort(order[at[often]], kind="stable")]])
                    often = np.sort(often)
                first = n - -(-num * n // den) + 1
                found.append(hashes[:first])
                marks.append(often[:first])
                keys.append(s)
                sizes.append(n)
            if found:
                lengths = np.array(list(map(len, found)))
                columns = [_as_long(np.concatenate(found)), np.repeat(np.array(keys, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths), np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]), np.concatenate(marks)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["h", "s", "n", "place", "often"])

    return docs.mapInArrow(run, "h bigint, s bigint, n int, place int, often boolean")


def _sets(docs: DataFrame, words: int, twice: frozenset[int], wanted: np.ndarray) -> DataFrame:
    """Rows (s, hashes) for the documents whose row's bit is set in ``wanted``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows):
            bits = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), np.int64)
            hit = (wanted[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)
            some = batch.filter(pa.array(hit.astype(bool)))
            found = [(_key(signature(s), twice), s.tobytes()) for s in shingles(utf8(some.column(2)), words)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["s", "hashes"])

    return docs.mapInArrow(run, "s bigint, hashes binary")


def _bit():
    return F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS))


def _compare(pairs: DataFrame, facts: DataFrame, alike) -> DataFrame:
    """The pairs (a, b) of which ``alike`` holds, for the facts (s, fact) about both. A class that is in very many pairs makes
    partitions of these joins large; as facts have one row per class, adaptive execution splits them."""
    both = pairs.join(facts.select(F.col("s").alias("b"), F.col("fact").alias("of_b")), "b").join(facts.select(F.col("s").alias("a"), F.col("fact").alias("of_a")), "a")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(rows, 1 << 22):
            keep = [alike(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def _links(docs: DataFrame, known: DataFrame, pairs: DataFrame, words: int, twice: frozenset[int], threshold: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) of classes, those whose whole sets are alike enough. ``known``: rows (s, rid, spread), one per class."""
    num, den = threshold

    def may_be(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        if SATURATED in (p.max(), q.max()):
            return True
        common, total = int(np.minimum(p, q).sum(dtype=np.int64)), int(p.sum(dtype=np.int64) + q.sum(dtype=np.int64))
        return den * common >= num * (total - common)

    def are(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(p) > len(q):
            p, q = q, p
        at = np.searchsorted(q, p)
        at[at == len(q)] = 0
        common = int(np.count_nonzero(q[at] == p))
        return den * common >= num * (len(p) + len(q) - common)

    left = durable(_compare(pairs, known.select("s", F.col("spread").alias("fact")), may_be), "spread")
    involved = left.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    bits = known.select("s", "rid").join(involved, "s").select(_bit().alias("bit"))
    set_bits = bits.groupBy((F.col("bit") / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int"))).alias("bits"))
    wanted = np.zeros(FILTER_BITS // 64, np.int64)
    for at, word in set_bits.collect():  # at most FILTER_BITS / 64 rows
        wanted[at] = word
    # a document that only its bit let through is in no pair, or has the same set as one that is
    sets = durable(_sets(docs.withColumn("bit", _bit()), words, twice, wanted.view(np.uint64)), "sets")
    found = durable(_compare(left, sets.select("s", F.col("hashes").alias("fact")), are).distinct(), "links")
    discard(sets, left)
    return found


def _need(p, q, threshold: tuple[int, int]):
    """The least overlap of two alike sets of p and q shingles."""
    num, den = threshold
    return F.floor(((p + q) * F.lit(num) + F.lit(num + den - 1)) / F.lit(num + den))


def _crowded(left: DataFrame, known: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows (a, b, overlap, least) of pairs that may be alike, for the incidence (h, s, n, k, root, total, outside, room)
    of crowded columns. total is how many columns a class has altogether, outside how many of them aren't crowded, room how many
    shingles it has from the first of all of them on; least is the overlap that alike sets have in all crowded columns: of two
    sets, the one whose first shingles end earlier in the common order has no other shingle in common with the other's first
    ones, and shares at most the rest of its own beyond. As overlaps of several blocks add up, blocks are left out only for what
    holds of their classes in all columns.

    Columns make a block if they hold the same class of least hash, as those of one passage or family mostly do. In a block of
    columns, classes are cut into blocks of about BLOCK, of one large component or of several small ones, and where there are many
    classes also of similar sizes. Two blocks of classes meet in a task, if their sizes and the places of their shingles allow
    for alike sets; their product adds up overlaps over all columns of the block.
    """
    num, den = threshold
    family = left.groupBy("h").agg(F.min(F.xxhash64("s")).alias("g"))
    cells = left.join(family, "h").groupBy("g", "s").agg(
        F.first("n").alias("n"), F.first("root").alias("root"), F.first("room").alias("room"), F.first("total").alias("total"), F.first("outside").alias("outside"), F.collect_list(F.struct("h", F.col("k").cast("int").alias("k"))).alias("cells")
    )
    cells = durable(cells, "cells")
    facts = cells.select("g", "s", "n", "root", "room", "total")
    of_root = facts.groupBy("g", "root").agg(F.count(F.lit(1)).alias("of_root"))
    of_block = facts.groupBy("g").agg(F.count(F.lit(1)).alias("of_block"))
    level = F.when(F.col("of_block") > BLOCK, F.floor(F.log("n") / F.log(F.lit(den / num)))).otherwise(F.lit(0)).cast("int")
    only = F.when(F.col("of_root") >= BLOCK, F.col("root"))
    placed = facts.join(of_root, ["g", "root"]).join(of_block, "g").select("g", "s", "n", "room", "total", "root", only.alias("only"), level.alias("level"))
    parts = placed.groupBy("g", "only", "level").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("parts"))
    placed = placed.join(parts.withColumnRenamed("g", "g2").withColumnRenamed("only", "only2").withColumnRenamed("level", "level2"), (F.col("g") == F.col("g2")) & F.col("only").eqNullSafe(F.col("only2")) & (F.col("level") == F.col("level2")))
    # classes of one small component go to one block, if they are few
    part = F.pmod(F.xxhash64(F.when(F.col("only").isNull(), F.col("root")).otherwise(F.col("s"))), F.col("parts"))
    placed = durable(placed.select("g", "s", "n", "room", "total", "only", F.xxhash64("only", "level", part).alias("id")), "placed")
    blocks = placed.groupBy("g", "id").agg(F.first("only").alias("only"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"), F.max("total").alias("total"))
    i, j = blocks.alias("i"), blocks.alias("j")
    met = i.join(j, (F.col("i.g") == F.col("j.g")) & (F.col("i.id") <= F.col("j.id")))
    met = met.where("i.only IS NULL OR j.only IS NULL OR i.only <> j.only")
    met = met.where((F.col("i.most").cast("bigint") * den >= F.col("j.least").cast("bigint") * num) & (F.col("j.most").cast("bigint") * den >= F.col("i.least").cast("bigint") * num))
    need = _need(F.col("i.least"), F.col("j.least"), threshold)
    rest = F.ceil(F.greatest("i.most", "j.most").cast("bigint") * num / F.lit(den)) - 1  # what a set can share beyond its first shingles
    met = met.where((F.least("i.room", "j.room") >= need) & (F.least("i.total", "j.total") + rest >= need))
    met = met.select(F.col("i.g").alias("g"), F.col("i.id").alias("x"), F.col("j.id").alias("y"))
    given = cells.join(placed.select("g", "s", "id"), ["g", "s"]).join(known.select("s", "spread"), "s")
    sides = met.select("g", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("id", F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")))
    both = given.join(sides, ["g", "id"]).select("g", "x", "y", "side", "s", "n", "root", "total", "outside", "cells", "spread")

    def multiply(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = np.asarray(group["side"])
        keys, n, total, outside, root = (np.asarray(group[c]).astype(np.int64) for c in ("s", "n", "total", "outside", "root"))
        spread = np.frombuffer(b"".join(group["spread"].to_pylist()), np.uint8).reshape(-1, BUCKETS)
        full = spread.max(axis=1) == SATURATED
        lists = group["cells"].chunk(0)
        row = np.repeat(np.arange(len(keys)), np.asarray(lists.value_lengths()))
        column, k = np.asarray(lists.flatten().field(0)), np.asarray(lists.flatten().field(1)).astype(np.float32)
        p = np.flatnonzero(side == 0)
        q = np.flatnonzero(side == 1) if (side == 1).any() else p
        place_p, place_q = np.full(len(keys), -1), np.full(len(keys), -1)
        place_p[p], place_q[q] = np.arange(len(p)), np.arange(len(q))
        in_p, in_q = place_p[row] >= 0, place_q[row] >= 0
        shared = np.intersect1d(column[in_p], column[in_q])
        number = np.minimum(np.searchsorted(shared, column), max(len(shared) - 1, 0))
        met_too = shared[number] == column if len(shared) else np.zeros(len(column), bool)
        overlap = np.zeros((len(p), len(q)), np.float32)
        for at in range(0, len(shared), COLUMNS):
            now = met_too & (number >= at) & (number < at + COLUMNS)
            x, y = np.zeros((len(p), COLUMNS), np.float32), np.zeros((len(q), COLUMNS), np.float32)
            one, other = now & in_p, now & in_q
            x[place_p[row[one]], number[one] - at] = 1
            y[place_q[row[other]], number[other] - at] = k[other]
            overlap += x @ y.T
        elsewhere = total - np.bincount(row, k, len(keys)).astype(np.int64)
        rest = -(-n * num // den) - 1  # what a set can share beyond its first shingles
        out = []
        for at in range(0, len(p), 64):
            r = p[at : at + 64]
            need = -(-(n[r][:, None] + n[q][None, :]) * num // (num + den))
            most = overlap[at : at + 64] + np.minimum(elsewhere[r][:, None], elsewhere[q][None, :]) + np.maximum(rest[r][:, None], rest[q][None, :])
            good = (overlap[at : at + 64] > 0) & (root[r][:, None] != root[q][None, :]) & (most >= need)
            good &= np.minimum(n[r][:, None], n[q][None, :]) * den >= np.maximum(n[r][:, None], n[q][None, :]) * num
            if p is q:
                good &= keys[r][:, None] < keys[q][None, :]
            rows, columns = np.nonzero(good)
            for k0 in range(0, len(rows), 65536):
                i_, j_ = rows[k0 : k0 + 65536], columns[k0 : k0 + 65536]
                common = np.minimum(spread[r[i_]], spread[q[j_]]).sum(axis=1, dtype=np.int64)
                may = (common >= need[i_, j_]) | full[r[i_]] | full[q[j_]]
                least = need - np.maximum(rest[r][:, None], rest[q][None, :]) - np.minimum(outside[r][:, None], outside[q][None, :])
                out.append(np.stack([r[i_[may]], q[j_[may]], overlap[at + i_[may], j_[may]].astype(np.int64), least[i_[may], j_[may]]], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        one, other = keys[found[:, 0]], keys[found[:, 1]]
        return pa.table({"a": np.minimum(one, other), "b": np.maximum(one, other), "overlap": pa.array(found[:, 2]), "least": pa.array(found[:, 3])})

    return both.groupBy("g", "x", "y").applyInArrow(multiply, "a bigint, b bigint, overlap bigint, least bigint")


def _merged(shared: DataFrame) -> DataFrame:
    """Columns with the same classes as one: rows (h, s, n, place, k), with the place of the first of them and their number.
    Copies of a passage share long runs of shingles, so this takes most columns away. Columns are told apart by 64 bits; two that
    were mixed up would only give more candidates."""
    alike = shared.groupBy("h").agg(F.bit_xor(F.xxhash64("s")).alias("x"), F.count(F.lit(1)).alias("m"))
    renamed = shared.join(alike, "h").select(F.xxhash64("x", "m").alias("h"), "s", "n", "place")
    return durable(renamed.groupBy("h", "s").agg(F.max("n").alias("n"), F.min("place").alias("place"), F.count(F.lit(1)).alias("k")), "merged")


def _mixed(shared: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Of the incidence, the columns that hold classes of different components, with each class's root."""
    left = shared.withColumn("root", F.col("s"))
    if joined is not None:
        left = shared.join(joined.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    mixed = left.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    return left.join(mixed, "h")


def classes(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: rid (which tells rows apart), doc_id, n_shingles, component_id, keep_rid.

    Words are runs of anything but the ASCII white space characters, A-Z lower-cased. component_id is the smallest doc_id that
    links reach; keep_rid is the row that has it, of repeated rows the first. A null, empty or wordless text has no shingles,
    links with nothing and is its own component; null ids are smallest only among nulls; repeated rows and equal texts link;
    other columns are ignored, whatever their names; an empty table gives an empty result. Sets are told apart by 128 bits:
    where 64 don't do, the other 64 name a class; shingles by 64.
    """
    return _classes(numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("rid", "doc_id", "text"), words, threshold)


def _classes(docs: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    num, den = threshold
    survey = durable(_survey(docs, words), "survey")
    found = survey.where(F.col("rid").isNotNull())
    clashes = found.groupBy("s").agg(F.min("s2").alias("low"), F.max("s2").alias("high")).where("low <> high").select("s").collect()
    twice = frozenset(r.s for r in clashes)  # among ten billion sets, a few
    if twice:
        found = found.withColumn("s", F.when(F.col("s").isin(list(twice)), F.col("s2")).otherwise(F.col("s")))
    rows = found.select("rid", "doc_id", "n", "s")
    often = survey.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    frequent = np.array([r.h for r in often], np.int64).view(np.uint64)
    by_hash = np.argsort(frequent)
    rank = np.arange(len(frequent))[::-1][by_hash]  # the most frequent last

    # a frequent shingle is shared anyway, so its rows needn't meet to show it
    column = Window.partitionBy("h", F.when(F.col("often"), F.pmod(F.xxhash64("s"), F.lit(SALTS)))).orderBy("s")
    incidence = _prefixes(docs, words, twice, frequent[by_hash], rank, threshold).select("*", F.first("s").over(column).alias("c"), F.lead("s").over(column).alias("after"))
    incidence = durable(incidence.where("often OR s <> c OR after <> s").select("h", "s", "n", "place"), "incidence")
    shared = _merged(incidence.dropDuplicates(["h", "s"]))
    discard(incidence)
    first = rows.groupBy("s").agg(F.min("rid").alias("rid"))
    known = durable(found.select("rid", "spread").join(first, "rid"), "known")

    sized = lambda p, q: F.least(p, q).cast("bigint") * den >= F.greatest(p, q).cast("bigint") * num
    compared = links = joined = None
    for turn in range(ROUNDS):
        left = durable(_mixed(shared, joined), "left")
        # one class of each column: at first the same one for columns with the same classes, then any
        centre = F.min_by(F.struct("s", "n", "place", "root"), F.xxhash64("s", F.col("h") if turn else F.lit(0), F.lit(turn)))
        with_centre = left.join(left.groupBy("h").agg(centre.alias("c")), "h").where(F.col("root") != F.col("c.root"))
        room = F.least(F.col("n") - F.col("place"), F.col("c.n") - F.col("c.place"))
        pairs = with_centre.where(sized(F.col("n"), F.col("c.n")) & (room >= _need(F.col("n"), F.col("c.n"), threshold))).select(F.least("s", "c.s").alias("a"), F.greatest("s", "c.s").alias("b")).distinct()
        pairs = durable(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        discard(left)
        tried = pairs.count()
        if not tried:
            break
        found = _links(docs, known, pairs, words, twice, threshold)
        compared = pairs if compared is None else compared.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        fresh = found.count()
        if fresh:
            before, joined = joined, durable(components(links), "joined")
            discard(before)
        if fresh < WORTHWHILE * tried:
            break
    mixed = left = durable(_mixed(shared, joined), "left")
    sizes = left.groupBy("h").agg(F.count(F.lit(1)).alias("all"))
    left = left.join(sizes, "h")
    totals = left.groupBy("s").agg(F.sum("k").alias("total"), F.sum(F.when(F.col("all") <= CROWDED, F.col("k")).otherwise(0)).alias("outside"), F.max(F.col("n") - F.col("place")).alias("room"))
    left = durable(left.join(totals, "s"), "left")
    discard(shared, mixed)
    sparse = left.where(F.col("all") <= CROWDED).withColumn("elsewhere", F.col("total") - F.col("outside"))
    p, q = sparse.alias("p"), sparse.alias("q")
    needed = _need(F.col("p.n"), F.col("q.n"), threshold)
    room = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
    product = (
        p.join(q, (F.col("p.h") == F.col("q.h")) & (F.col("p.root") != F.col("q.root")) & (F.col("p.s") < F.col("q.s")) & sized(F.col("p.n"), F.col("q.n")) & (room >= needed))
        .groupBy(F.col("p.s").alias("a"), F.col("q.s").alias("b"))
        .agg(F.sum(F.least("p.k", "q.k")).alias("overlap"), F.min(room).alias("room"), F.max(needed).alias("need"), F.max(F.least("p.elsewhere", "q.elsewhere")).alias("elsewhere"))
        # up to the last of these columns' first places, what two classes share is counted here or lies in crowded columns; from
        # there on, they share at most what is left
        .where("overlap - 1 + room + elsewhere >= need")
        .select("a", "b")
    )
    crowded = _crowded(left.where(F.col("all") > CROWDED), known, threshold).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("least").alias("least"))
    pairs = product.unionByName(crowded.where("overlap >= least").select("a", "b")).distinct()
    pairs = durable(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
    discard(left)
    if pairs.limit(1).count():
        found = _links(docs, known, pairs, words, twice, threshold)
        joined = durable(components(found if links is None else links.unionByName(found)), "joined")
    if joined is None:
        joined = spark_empty(docs)

    placed = rows.join(joined.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    placed = durable(placed, "placed")
    discard(survey, known)
    full = placed.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    best = durable(full.select("root", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("keep_rid"), F.lit(True).alias("grouped")), "best")
    out = placed.where("n > 0").join(best, "root", "left").unionByName(placed.where("n = 0"), allowMissingColumns=True)
    alone = F.col("grouped").isNull()
    return out.select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("rid")).otherwise(F.col("keep_rid")).alias("keep_rid")
    )


def spark_empty(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "node bigint, root bigint")


def dedup(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` of which ``classes`` says that they stay: one of each component, with all columns."""
    own = "__near_rid"
    docs = numbered(docs, own)
    gone = _classes(docs.select(F.col(own).alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), words, threshold).where("rid <> keep_rid").select(F.col("rid").alias(own))
    return docs.join(gone, own, "left_anti").drop(own)
