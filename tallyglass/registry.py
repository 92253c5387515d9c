"""Collects the queries and their SQL from the modules of ``tallyglass.plans``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, history, identify, landed, ocr, prices, search, streams

MODULES = [search, identify, prices, history, ocr, catalog, landed, streams]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify.flagship(spark, sf_dir)
