"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Every stage takes the documents its predecessor kept. All but the last return
the columns of ``documents``; the last returns the tokens of what is left.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm import bpe, decontaminate, exact_dedup, frames, language_id, near_dedup

#: Rows of whole texts that go to a Python worker at once; each batch is in memory on both sides.
BATCH_ROWS = 2000


def _in_small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null, or without a letter) go."""
    _in_small_batches(spark)
    out = language_id.held_out(F.col("doc_id"), 3, 1)
    trees = language_id.learn(docs, ~out & F.col("doc_id").isNotNull())
    return language_id.keep_predicted(docs, trees)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the least doc_id stays."""
    _in_small_batches(spark)
    return near_dedup.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_hit_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digest of the bytes they decode to."""
    _in_small_batches(spark)
    return bpe.tokenise(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]

#: Learned languages, MinHash groups and BPE have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared checkpoint folder and read again."""
    frames.use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
