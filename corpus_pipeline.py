"""A corpus pipeline of five stages over documents; each writes Parquet that the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from corvane.llm.queries import multi_50k
from corvane.sources.workspace import give_back, remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that the quality rules reject."""
    return quality_rules.drop_bad_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of equal texts: that with the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near copies: that with the smallest doc_id."""
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix reads them, in training order: documents of heavy sources twice, of light ones in part."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256, ids."""
    give_back(spark)  # the stages before fill the executors' heaps, this one works in Python
    return bpe.encode_decode(docs, multi_50k(), with_ids=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte-level BPE", encode)]

#: SQL can't express the merges of BPE or, at this size, similarity components. tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/corvane/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{i}/rows")
        docs = spark.read.parquet(f"{path}/{i}/rows")
        if i:  # the stage before has been read for the last time
            remove(spark, f"{path}/{i - 1}/rows")
    return docs
