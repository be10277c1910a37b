"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

1. quality classifier: documents that it rejects go.
2. n-gram Jaccard join: one document of each group of near copies stays, the one with the smallest doc_id.
3. benchmark decontamination: documents that hold a benchmark item go.
4. secret scans: secrets in the texts are replaced by a sign; all documents stay.
5. mixing sources to target weights: documents are sampled by calibrated probabilities; the last stage adds
   the cell, weight and probability of each.

Nulls, empty texts, ties, repeated rows, empty tables and clashing columns are treated as the operators state; the near
duplicates of stage 2 share runs of five words at a Jaccard similarity of 0.8. Columns of documents named like those the
last stage adds, or like the working columns of mixing, give way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerodeck.llm import decontaminate, jaccard, mixing, quality, secrets
from aerodeck.llm.common import stored, table


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def by_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    added = {"mix_topic": F.col("_topic"), "mix_tokens": F.col("_tokens").cast("long"), "mix_weight": F.col("_weight"), "mix_probability": F.col("_probability")}
    kept = [c for c in docs.columns if c.lower() not in (*mixing.ADDED, *added)]
    return mixing.mix(docs).select(*(f"`{c}`" for c in kept), *(c.alias(name) for name, c in added.items()))


STAGES = [("quality classifier", by_quality), ("n-gram Jaccard join", by_similarity), ("benchmark decontamination", by_benchmark), ("secret scans", by_secrets), ("mixing to target weights", by_mixture)]

# Training and hashing of n-grams cannot be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
