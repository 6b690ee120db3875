"""The queries of this subpackage: one opN_<name> each, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import read_table
from .decontaminate import contamination
from .jaccard import jaccard_join
from .licenses import scan_licenses
from .media import media_features, store_media
from .packing import pack
from .quality import fit_quality, score_quality
from .quotes import link_quotes
from .repeats import repeats_report
from .secrets import scan_secrets
from .toxicity import fit_toxicity, score_toxicity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items", "runs")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(read_table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(read_table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels"), lang="lang"))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_media": op2_media,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_repeats": op7_repeats,
    "op8_jaccard": op8_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_quotes": op10_quotes,
}
