"""Named queries of the engine, each with the SQL that states the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cases, catalog


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every whole benchmark text by BM25."""
    return catalog.QUERIES["bm25_docs"](spark, sf_dir)


def queries() -> dict:
    return catalog.QUERIES | cases.QUERIES


def oracle_sql() -> dict:
    return catalog.SQL | cases.SQL
