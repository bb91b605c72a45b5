"""Documents to packed training sequences, in stages of which each works on all that the one before kept.

``STAGES`` lists names and functions (spark, docs, sf_dir) -> DataFrame; ``run`` writes each result as Parquet in the shared folder
and reads it again. All stages but the last return the columns of their input. Null and empty texts, repeated rows, empty tables
and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hduframe.llm import exact_dedup, jaccard_join, packing, quality, toxicity
from hduframe.llm.common import durable, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine, trained on these documents, takes for toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the Bradley-Terry ranking, trained on these documents, puts below its threshold."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the five-word Jaccard join at 0.8: the one with the smallest doc_id."""
    return jaccard_join.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", reject_toxic), ("quality", reject_poor), ("exact dedup", drop_copies), ("jaccard join", drop_near_copies), ("packing", pack)]

#: Learned scores and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs, name.replace(" ", "_"))
    return docs
