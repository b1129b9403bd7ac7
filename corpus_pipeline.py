"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir). Quality rules, near-dedup and decontamination drop documents, the secret
scan masks what it finds, and the mix, last, adds how often each document that it takes is repeated.

Defined results: a null text has no words and goes with the quality rules; of rows with one text, repeated ones and those with
null ids too, one stays; a null source is a source of its own; an empty `documents`, or one of which nothing is kept,
gives an empty result with the same columns, and an empty `benchmark` drops nothing; extra columns are kept, but for the
mix's own names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.llm import decontamination, mixing, near_dedup, quality_rules, secrets
from cladeflow.llm.common import checkpoint_folder, own, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy."""
    return quality_rules.filter_documents(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_duplicates(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontamination.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their target, repetitions and words taken; these replace columns of the same names."""
    mixed = mixing.mix_documents(docs).where(F.col("repetitions") > 0)
    added = ("size", "source_size", "target", "repetitions", "taken")
    return mixed.select(*[own(c).alias(c) for c in docs.columns if c.lower() not in added], *added)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", keep_unseen),
    ("secret_scans", mask_secrets),
    ("mix_sources", mix),
]

#: BagMinHash groups and window entropies are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the stages' tables are in a folder of this run in the shared checkpoint folder."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
