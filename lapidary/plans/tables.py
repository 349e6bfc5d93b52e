"""The engine's tables, derived from the given ones: an evidence store needs documents, facts and findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registration(queries: dict, sql: dict[str, str]) -> Callable:
    """A decorator that registers a query under its name, with the SQL that its rows equal."""

    def query(text: str | None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    return F.col(column).cast("decimal(20,2)")


def facts(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Order lines as facts: a line number of an order is a work item, suppliers are documents, ship dates are versions."""
    lines = table(spark, sf_dir, "lineitem").filter(where)
    return lines.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"),
        F.col("l_orderkey").alias("project_id"),
        F.col("l_linenumber").alias("item"),
        F.col("l_suppkey").alias("document_id"),
        F.col("l_partkey").alias("sheet_row"),
        F.lit("amount").alias("fact_type"),
        money("l_extendedprice").alias("numeric_value"),
        F.lit(None).cast("string").alias("unit"),
        F.lit("INR").alias("currency"),
        money("l_extendedprice").cast("string").alias("literal"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("extractor_version"),
    )


FACTS_SQL = """
facts AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id, l_orderkey AS project_id,
         l_linenumber AS item, l_suppkey AS document_id, l_partkey AS sheet_row, 'amount' AS fact_type,
         CAST(l_extendedprice AS DECIMAL(20,2)) AS numeric_value, strftime(l_shipdate, '%Y%m%d') AS extractor_version
  FROM lineitem
), sources AS (
  SELECT s_suppkey AS document_id, CASE WHEN s_acctbal >= 0 THEN 'active' ELSE 'superseded' END AS version_state FROM supplier
), retractions AS (
  SELECT DISTINCT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id FROM lineitem WHERE l_returnflag = 'R'
)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents: one that owes is superseded."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("document_id"), F.when(F.col("s_acctbal") >= 0, "active").otherwise("superseded").alias("version_state")
    )


def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines are withdrawn facts."""
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return returned.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id")).distinct()


STATED_SQL = """
stated AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id, l_orderkey AS project_id, l_suppkey % 5 AS document_id, 't' || l_linenumber % 3 AS fact_type,
         CASE WHEN l_linenumber % 3 = 2 AND l_orderkey % 2 = 0 THEN 'identifier' ELSE 'money' END AS kind, CASE WHEN l_discount > 0 THEN floor(l_quantity / 25) END AS numeric_value,
         strftime(l_shipdate, '%Y%m%d') AS extractor_version, l_returnflag = 'R' AS withdrawn, CASE WHEN l_tax >= 0.08 THEN l_partkey END AS work_item_id FROM lineitem)"""


def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as what documents of a project state: some of work items, some withdrawn, some without a number."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when((F.col("l_linenumber") % 3 == 2) & (F.col("l_orderkey") % 2 == 0), "identifier").otherwise("money")
    return lines.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"), F.col("l_orderkey").alias("project_id"),
        (F.col("l_suppkey") % 5).alias("document_id"), F.concat(F.lit("t"), F.col("l_linenumber") % 3).alias("fact_type"), kind.alias("kind"),
        F.when(F.col("l_discount") > 0, F.floor(F.col("l_quantity") / 25)).alias("numeric_value"), F.date_format("l_shipdate", "yyyyMMdd").alias("extractor_version"),
        (F.col("l_returnflag") == "R").alias("withdrawn"), F.when(F.col("l_tax") >= 0.08, F.col("l_partkey")).alias("work_item_id"),
    )
