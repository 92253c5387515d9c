"""The numbered queries and their SQL. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprint, licenses, linededup, lm, merkle, mixing, negatives, passages, quality, quality_sql, simhash, tokenbin, warc
from .common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_simhash_near_dedup,
        op3_warc_revisits,
        op4_source_mixing,
        op5_license_scan,
        op6_token_ids,
        op7_substring_dedup,
        op8_line_dedup,
        op9_lm_scoring,
        op10_quality_rules,
        op11_document_fingerprints,
        op12_hard_negatives,
        op13_merkle_manifest,
    )
}
ORACLES = {
    "op3_warc_revisits": warc.SQL,
    "op4_source_mixing": mixing.SQL,
    "op5_license_scan": licenses.SQL,
    "op8_line_dedup": linededup.SQL,
    "op10_quality_rules": quality_sql.SQL,
    "op11_document_fingerprints": fingerprint.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
