"""Corpus pipeline: documents to packed token sequences, each stage one of the training-data operators.

Every stage works on all that its predecessor kept; run() writes each stage's rows as Parquet in the session's shared
folder and reads them again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from isthmus.llm.decontaminate import decontaminate
from isthmus.llm.jaccard import drop_near_duplicates
from isthmus.llm.packing import pack
from isthmus.llm.quality import fit_quality, keep_good
from isthmus.llm.secrets import redact_secrets
from isthmus.runtime import checkpoint_dir, delete, prepare, read_table, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier, fitted on them, doesn't reject."""
    prepare(spark)
    return keep_good(docs, fit_quality(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked near copies."""
    prepare(spark)
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of test items; documents that are mostly such passages go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark."""
    prepare(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    prepare(spark)
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("secrets", secrets), ("packing", packing)]

#: Learned models, similarity clusters and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's rows and its intermediate tables are deleted once the next stage's are written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
