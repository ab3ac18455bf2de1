"""All registered core queries and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import analytics, equivalents, evidence, integrity, records, retrieval, search_sql, views

MODULES = (retrieval, records, evidence, analytics, views, integrity, equivalents, search_sql)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(spark, sf_dir)
