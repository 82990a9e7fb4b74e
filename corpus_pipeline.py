"""A corpus cleaned and packed by the operators of hearthlog.llm; counted as part of that subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet below the shared folder
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hearthlog.llm import exact_dedup, ngram_join, packing, pii, quality_rules
from hearthlog.llm.common import ensure_checkpoint_dir, small_batches


#: Segments that a worker keeps while it packs. Executors that ran the stages before have less memory to spare than
#: packing alone has; fewer segments cost time only.
SEGMENT_BYTES = 24_000_000


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    small_batches(spark)
    return quality_rules.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    small_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.75 the smallest doc_id stays."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are generalised, and terms that give them away removed; no row goes."""
    small_batches(spark)
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), most_bytes=SEGMENT_BYTES)


STAGES = [
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("pii", sanitise),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
    return docs


#: Packing runs a tokenizer, which SQL doesn't have; the tests hold run() against a brute-force version.
ORACLE_SQL = None
