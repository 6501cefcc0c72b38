"""From raw documents to token ids in five stages, each over all that the one before kept.

1. quality       a co-trained classifier drops the documents that it rejects
2. exact_dedup   of equal texts (A-Z lower-cased) the largest doc_id stays
3. near_dedup    of each class of near copies (five-word shingles, Jaccard 0.8 or more) the smallest doc_id stays
4. mixing        sources are repeated or thinned to weights 1, 2, 3 in turn, three epochs at most
5. byte_bpe      every text is encoded by the local rank file and decoded again

A document that the mix repeats comes out of stage 4, and so of stage 5, as that many equal rows.

Defined results: a null text is empty in every stage. Rows that repeat an id are documents of their own; equal texts
among them go in stage 2, where a null id stays only if its text has no other. In stage 3 rows with a null id stay.
A text without words, null or empty, has size 0 and so goes in stage 4; a null source is a source of its own. Columns of
any other name pass through the first four stages unchanged. Without labels of both kinds stage 1 keeps all. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import byte_bpe, dart_minhash, exact_dedup, mixing, quality
from quillon.llm.staging import fresh_path
from quillon.session import read_table, workers_find_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    features = quality.Features(docs, rows=True)
    return quality.keep_good(features, quality.train(features, read_table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="max")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_find_package(spark)
    return dart_minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, weights=[1, 2, 3], max_epochs=3.0)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    workers_find_package(spark)
    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: SQL can't express the classifier, the signatures or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
