"""Corpus pipeline: reject toxic documents, keep one of each near-duplicate
group, drop documents that hold benchmark passages, redact secrets, encode.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of documents.

Defined cases: null or empty texts are neither toxic nor contaminated and hold
no secrets; texts whose fingerprints link (all empty ones do) keep the smallest
id, null ids last, and of repeated rows one; extra columns pass through the first
four stages; empty tables give empty results.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockfair.llm import bpe, decontam, secret_scan, simhash, toxicity  # noqa: E402
from stockfair.llm.common import prepared, stored, table  # noqa: E402


@prepared
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, chain)


@prepared
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


@prepared
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@prepared
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


@prepared
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", reject_toxic), ("simhash_dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("bpe", encode)]

#: The chain, the fingerprints and the merges are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: (doc_id, ids, n_tokens)."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
