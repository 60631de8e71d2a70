"""From raw documents to packed training sequences: five stages, each on what the one before it kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame.  All but the last return the columns of ``documents``; the last
returns the pieces of the packed sequences, as op1's query does.  Between stages rows are written as Parquet to the folder
that the cluster shares, so a lost executor never costs more than the stage it was in.

Null texts count as empty.  Rows without doc_id go in the first stage.  A row that is there twice is judged twice by the
quality rules, and the second stage keeps one of it; of equal or near-equal texts the smallest doc_id stays.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedrank.llm import exact, minhash, packing, quality, queries, shared, suffixes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep."""
    return quality.keep(docs, queries.table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest identifier."""
    return exact.deduplicate(docs, keep="first")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (80 % of five-word shingles), the document with the smallest identifier."""
    return minhash.deduplicate(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that occur earlier."""
    return suffixes.deduplicate(docs, width=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    pieces = packing.pack(docs, queries.vocabulary(), limit=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: SQL can't express near-duplicates by hashed registers, suffix sorting or tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), name, {})
    return STAGES[-1][1](spark, docs, sf_dir)
