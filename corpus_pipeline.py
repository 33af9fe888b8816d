"""Corpus pipeline: documents to token ids in five stages, each one an operator of ``ledgerlens.llm``.

Every stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; its result is written as Parquet in
the session's shared folder and read again as the next one's ``docs``. All stages but the last return the columns of
``documents``:

1. quality: the weak-label classifier is fitted on this stage's input; documents that it rejects go.
2. exact: of documents with equal text (white space folded) the smallest doc_id stays.
3. near: of each SimHash component (3-word shingles, up to 3 bits) the smallest doc_id stays.
4. decontaminate: documents that hold a 10-word window of a benchmark item go.
5. encode: doc_id, n_tokens, ids_sha256, decoded_sha256 by byte-level BPE.

SQL can't express the classifier, SimHash components over merged links or BPE, so ORACLE_SQL is None and the tests hold
run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, common, decontaminate, exact_dedup, quality, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs, width=3, bits=3)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.rank_file())


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
