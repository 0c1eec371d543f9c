"""All queries of the library with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import base, decisions, evaluation, models, retrieval, similarity, tables, texts  # noqa: F401  (registering is an import's work)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to macro F0.5: word retrieval within a language, the five best of each, scored
    against records of equal text."""
    return retrieval.retrieval_f05(spark, sf_dir)
