"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

1. ``toxicity``: documents that the classifier chain rejects go.
2. ``near_duplicates``: of each group of near-duplicates (shingles of five words, similarity 0.8) one row stays, that
   of the smallest id. Rows are told apart by their contents: rows that share an id and differ in text are documents
   of their own, rows without an id take part too.
3. ``secrets``: found secrets are replaced by a mark; texts without any stay as they are. ``n_chars`` follows.
4. ``packing``: what is left is tokenized and packed into sequences of 1024 tokens; one row per piece.

Nulls, empty texts, repeated rows, very long texts and empty tables are handled as the operators state. Of rows that
are equal in every column one stays after stage 2. Further columns travel along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import bounded_batches, store, table, unused
from loamgraph.llm.minhash import deduplicate
from loamgraph.llm.packing import pack_documents
from loamgraph.llm.secrets import redact_secrets
from loamgraph.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def without_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    before, now = unused(docs, "_before"), F.char_length("text")
    clean = redact_secrets(docs.withColumn(before, now))
    changed = F.when(now != F.col(before), now.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", without_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL expresses none of the models; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
