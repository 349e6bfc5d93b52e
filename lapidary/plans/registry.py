"""Every registered query over the given tables, with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapidary.plans import documents, merges, records, relational, serving, shapes, stores, trails

QUERIES: dict = relational.QUERIES | documents.QUERIES | shapes.QUERIES | records.QUERIES | stores.QUERIES | trails.QUERIES | merges.QUERIES | serving.QUERIES
SQL: dict[str, str] = relational.SQL | documents.SQL | shapes.SQL | records.SQL | stores.SQL | trails.SQL | merges.SQL | serving.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict-aware selection of facts."""
    return relational.l05_select_facts(spark, sf_dir)
