"""The corpus pipeline: documents to a mixed training corpus, in stages.

Each stage takes (spark, docs, sf_dir) and returns all that the next one reads; ``run`` writes each
stage below the shared checkpoint folder and reads it back. Every stage but the last returns
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm.common import small_batches, store, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on the labels, scores 0.5 or more."""
    from cohortlab.llm.toxicity import drop_toxic
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that of the least id."""
    from cohortlab.llm.probminhash import drop_near_duplicates
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which a benchmark item leaks."""
    from cohortlab.llm.decontam import drop_leaks
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; no document is dropped."""
    from cohortlab.llm.secret_scan import redact_secrets
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their targets: a row per copy taken, with its shard and place in it."""
    from cohortlab.llm.mixing import mix
    return mix(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("mixing", mixing)]

#: A trained classifier and a latent space decide, which SQL can't express; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
