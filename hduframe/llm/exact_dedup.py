"""Exact deduplication with a split between frequent and other digests.

Each task summarises its digests with Misra-Gries counters. Merged, they bound the digests that can be frequent; exact counts
and winners of these few are then taken in a second pass with partial aggregation, broadcast, and joined map-side, so that a
group of copies of any size never meets in one task. All other digests, each a small share of the rows, take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, numbered

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Counters of a summary: digests of more than 2 / (counters + 1) of all rows are sure to be found, and at most ``counters`` are.
#: There are as many as leave ROWS rows or fewer to any other digest, within these bounds; a digest is broadcast in some 100 bytes.
LEAST_COUNTERS, MOST_COUNTERS, ROWS = 1024, 65_536, 500_000


def normalised(text):
    """A text column without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class MisraGries:
    """Counts of at most ``counters`` keys; each is too low by at most the number of rows over ``counters`` + 1."""

    def __init__(self, counters: int) -> None:
        self.counters, self.counts, self.rows = counters, {}, 0

    def add(self, counts: dict) -> None:
        """Adds counts of keys; of more than ``counters`` keys then, all lose the count of the first that is too many."""
        self.rows += sum(counts.values())
        own = self.counts
        for key, count in counts.items():
            own[key] = own.get(key, 0) + count
        if len(own) > self.counters:
            less = sorted(own.values(), reverse=True)[self.counters]
            self.counts = {k: v - less for k, v in own.items() if v > less}


def frequent(digests: DataFrame, column: str, counters: int) -> DataFrame:
    """At most ``counters`` values of the column, among them all that more than 2 / (``counters`` + 1) of the rows have."""

    def summarise(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(counters)
        for batch in rows:
            counted = pc.value_counts(batch.column(0))
            summary.add(dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True)))
        if summary.rows:
            yield pa.RecordBatch.from_arrays([pa.array([*summary.counts, None], pa.string()), pa.array([*summary.counts.values(), summary.rows], pa.int64())], names=["digest", "n"])

    merged = digests.select(column).mapInArrow(summarise, "digest string, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    # The row of null has the number of all rows; the sums of the others are at most that together, so fewer than counters + 1
    # of them can exceed its share of 1 / (counters + 1).
    top = merged.orderBy(F.desc("n"), F.col("digest").asc_nulls_first()).limit(counters + 1).collect()
    rows = max((r.n for r in top if r.digest is None), default=0)
    found = [(r.digest,) for r in top if r.digest is not None and r.n * (counters + 1) > rows and r.n > 1]
    return digests.sparkSession.createDataFrame(found, f"{column} string")


def _digests(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select("rid", "doc_id", F.coalesce(F.length(text), F.lit(0)).alias("n"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"))


def duplicates(docs: DataFrame, counters: int | None = None) -> DataFrame:
    """One row per row of ``docs``: rid (which tells rows apart), doc_id, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are equal without white space, the one with the most code points stays, then the smallest doc_id, null
    last; of rows that are repeated whole, the first. Null and empty texts are one group. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    return _duplicates(numbered(docs.select("doc_id", "text")), counters)


def _duplicates(docs: DataFrame, counters: int | None) -> DataFrame:
    rows = durable(_digests(docs), "digests")
    if counters is None:
        counters = min(max(2 * rows.count() // ROWS, LEAST_COUNTERS), MOST_COUNTERS)
    hot = frequent(rows, "text_sha256", counters)
    order = F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("rid").alias("d"))
    winners = (
        rows.join(F.broadcast(hot), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
        .select("text_sha256", "group_size", F.col("best.c").alias("keep_id"), F.col("best.d").alias("keep_rid"))
    )
    frequent_rows = rows.join(F.broadcast(winners), "text_sha256").withColumn("kept", F.col("rid") == F.col("keep_rid"))
    group = Window.partitionBy("text_sha256")
    best = group.orderBy(F.desc("n"), F.col("doc_id").asc_nulls_last(), "rid")
    others = rows.join(F.broadcast(hot), "text_sha256", "left_anti").select(
        "*", F.first("doc_id").over(best).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"), (F.row_number().over(best) == 1).alias("kept")
    )
    columns = ["rid", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return frequent_rows.select(columns).unionByName(others.select(columns))


def dedup(docs: DataFrame, counters: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, as ``duplicates`` decides."""
    own = "__exact_rid"
    docs = numbered(docs, own)
    gone = _duplicates(docs.select(F.col(own).alias("rid"), "doc_id", "text"), counters).where(~F.col("kept")).select(F.col("rid").alias(own))
    return docs.join(gone, own, "left_anti").drop(own)
