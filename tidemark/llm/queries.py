"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprint, hardneg, html, language, lm, neardup, pieces, pii, secrets, suffix, toxicity, whitening
from .tables import read


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op3(read(spark, sf_dir, "documents"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op4(read(spark, sf_dir, "documents"))


def op5_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op5(read(spark, sf_dir, "pages"))


def op6_suffix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.op6(read(spark, sf_dir, "documents"))


def op7_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_fingerprint_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op1(read(spark, sf_dir, "documents"))


def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op2(read(spark, sf_dir, "documents"))


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op8(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op9(read(spark, sf_dir, "documents"))


def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10(read(spark, sf_dir, "documents"))


def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11(read(spark, sf_dir, "embeddings"))


def op12_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op12(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.op13(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprint_iblt, op2_log_bilinear, op3_merge_dropout, op4_language_mixture, op5_html_region, op6_suffix_hash, op7_toxicity_mil, op8_string_tiling, op9_minhash_forest, op10_pii_disclosure, op11_qdwh_whitening, op12_secret_owners, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op12_secret_owners": secrets.SQL, "op13_hard_negatives": hardneg.SQL}
