"""Bounded samples of labelled documents for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each class that a model is fitted on at most.
PER_CLASS = 8000


#: Parts into which the places of rows that may be sampled are counted.
PARTS = 4096


def sampled_ids(labelled: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``labelled``: doc_id and label, of few labels; a repeated id counts once, with its least label. For each label, about ``per_class`` rows and never more,
    those with the least hash of the id; with weight, the rows that one of them stands for. How far the hashes go is found from
    counts of rows by hash, so no label's rows are brought together."""
    totals = F.broadcast(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("total")))  # a row for each label
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)).cast("double") * F.col("total")
    most = float(1.3 * per_class + 100) * (1 << 40)
    low = labelled.join(totals, "label").withColumn("place", place).where(F.col("place") <= most).withColumn("part", F.floor(F.col("place") * PARTS / most))
    once = F.min(F.struct("label", "part", "total")).alias("x")  # a small share of all ids
    low = low.groupBy("doc_id").agg(once).select("doc_id", "x.label", "x.part", "x.total")
    counted = low.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))  # at most PARTS + 1 rows for each label
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("label").orderBy("part"))).where(F.col("upto") <= per_class)
    last = F.broadcast(upto.groupBy("label").agg(F.max("part").alias("last"), F.max("upto").alias("taken")))
    some = low.join(last, "label").where(F.col("part") <= F.col("last"))
    return some.withColumn("weight", F.col("total") / F.col("taken")).drop("part", "last", "taken", "total")


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label (0 or 1), one row per id; of contradicting labels the higher counts; null ids and labels don't."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sampled ids with a text each: of a repeated id, the least one. The sample is bounded, so it is broadcast; repeats are
    reduced in the tasks that read them."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))
