"""Filters, projections, orders and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import text as T
from lapidary.operators import findings, latest
from lapidary.plans.tables import money, registration, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registration(QUERIES, SQL)


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1995-01-01'
  AND (o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49))""")
def b02_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed filters, and one of two memberships, as semi-joins and not as a join on either."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    builders = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    keys = orders.join(builders, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus").union(orders.join(large, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus"))
    return keys.distinct()


@query("""
SELECT doc_id, CASE WHEN n_chars > 20000 THEN 'failed' WHEN text LIKE '%|%' THEN 'quarantined' WHEN n_chars = 0 THEN 'unreadable' WHEN lang <> 'en' THEN 'processing' ELSE 'processed' END AS status,
       source IS NOT NULL AND source <> 'src0' AS differs FROM documents""")
def b16_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status by precedence, and flags."""
    status = (
        F.when(F.col("n_chars") > 20_000, "failed").when(F.col("text").contains("|"), "quarantined")
        .when(F.col("n_chars") == 0, "unreadable").when(F.col("lang") != "en", "processing").otherwise("processed")
    )
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), (F.col("source").isNotNull() & (F.col("source") != "src0")).alias("differs"))


@query("""
SELECT k, arg_max(name, (priority, key)) AS name, max(priority) AS priority FROM (
  SELECT c_nationkey AS k, c_name AS name, 1 AS priority, c_custkey AS key FROM customer UNION ALL SELECT s_nationkey, s_name, 2, s_suppkey FROM supplier) GROUP BY k""")
def c13_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of origin overrides the other, and of each the latest counts."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit(1).alias("priority"), F.col("c_custkey").alias("key"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit(2).alias("priority"), F.col("s_suppkey").alias("key"))
    both = customers.unionByName(suppliers)
    return both.groupBy("k").agg(F.max_by("name", F.struct("priority", "key")).alias("name"), F.max("priority").alias("priority"))


@query("""
WITH l AS (SELECT doc_id, quality, row_number() OVER (ORDER BY CASE WHEN quality = 1 THEN NULL ELSE doc_id END NULLS FIRST, doc_id) AS place FROM labels)
SELECT doc_id, place FROM l WHERE place <= 100""")
def f07_null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a number first, then by number; the first hundred (a list of that length is the feature)."""
    number = F.when(F.col("quality") != 1, F.col("doc_id"))
    top = table(spark, sf_dir, "labels").orderBy(number.asc_nulls_first(), "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy(number.asc_nulls_first(), "doc_id")).cast("long").alias("place"))


@query("""
SELECT doc_id, left(text, 200) AS shown, length(text) > 200 AS truncated FROM documents""")
def f10_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown is cut to a length, and says so."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(200)).alias("shown"), (F.char_length("text") > 200).alias("truncated"))


@query("""
WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT o_orderkey, (CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND (c // 10) % 2 = 1) THEN c // 10 + 1 ELSE c // 10 END) / 10.0 AS half_even, (CASE WHEN c % 10 >= 5 THEN c // 10 + 1 ELSE c // 10 END) / 10.0 AS half_up FROM c""")
def h22_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves to even, and halves up, in exact decimals."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.bround(money("o_totalprice"), 1).cast("double").alias("half_even"), F.round(money("o_totalprice"), 1).cast("double").alias("half_up"))


@query("""
SELECT o_orderkey, CAST('{"id":' || o_orderkey || ',"total":"' || CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) || '","note":null}' AS VARCHAR) AS json FROM orders""")
def a28_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with decimals as text and absent values shown."""
    body = F.struct(F.col("o_orderkey").alias("id"), money("o_totalprice").cast("string").alias("total"), F.lit(None).cast("string").alias("note"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


@query("""
SELECT l_orderkey AS project_id, CASE WHEN count(l_discount) < 2 THEN 'inconclusive' WHEN count(DISTINCT l_discount) = 1 THEN 'pass' ELSE 'fail' END AS outcome FROM lineitem GROUP BY 1""")
def k06_share_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do all shares of a project agree?"""
    shares = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_discount").alias("share"))
    return findings.share_consistency(shares)


@query("""
WITH t AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS total FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'inconclusive' AS outcome, CAST(total - CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) AS difference,
  CASE WHEN CAST(o_totalprice AS DECIMAL(20,2)) > 0 THEN abs(total - CAST(o_totalprice AS DECIMAL(20,2))) * 100 > CAST(o_totalprice AS DECIMAL(20,2)) END AS far FROM orders JOIN t ON l_orderkey = o_orderkey""")
def k04_against_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: what a bill differs from its estimate by, without a verdict, and whether that is more than one percent: by the exact difference, not by the percentage that is shown."""
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("total"))
    joined = totals.join(table(spark, sf_dir, "orders"), "o_orderkey")
    estimate = money("o_totalprice")
    x = findings.against_estimate(F.col("total"), estimate)
    far = F.when(estimate > 0, F.abs(x["difference"]) * 100 > estimate)
    return joined.select("o_orderkey", x["outcome"].alias("outcome"), x["difference"].cast("double").alias("difference"), far.alias("far"))


@query("""
WITH t AS (SELECT conv_id, turn, text, instr(lower(text), 'the') AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN p > 0 THEN (CASE WHEN p - 90 > 1 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, greatest(1, p - 90), least(length(text), p + 92) - greatest(1, p - 90) + 1), '[ \t\n\x0B\f\r]+', ' ', 'g')) || (CASE WHEN p + 92 < length(text) THEN '…' ELSE '' END) END AS snippet FROM t""")
def h10_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around the first place of a word, with ellipses."""
    at = F.instr(F.lower("text"), "the")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(at > 0, T.snippet(F.col("text"), at, F.lit(3))).alias("snippet"))


@query("""
SELECT count(*) FILTER (n > 1) AS repeated_keys, count(*) FILTER (o_custkey IS NULL) AS orphans, count(*) FILTER (bad) AS below_zero FROM (
  SELECT l_orderkey, l_linenumber, count(*) AS n, any_value(o_custkey) AS o_custkey, bool_or(l_quantity <= 0) AS bad FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)""")
def p05_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants as counts of what breaks them: repeated keys, orphans, impossible values."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_quantity") <= 0).alias("bad"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = lines.join(orders, "l_orderkey", "left")
    return joined.agg(F.count_if(F.col("n") > 1).alias("repeated_keys"), F.count_if(F.col("o_custkey").isNull()).alias("orphans"), F.count_if("bad").alias("below_zero"))


@query("""
SELECT p_partkey, l_orderkey, CAST(amount AS DOUBLE) AS amount FROM (
  SELECT l_partkey AS p_partkey, l_orderkey, CAST(l_extendedprice AS DECIMAL(20,2)) AS amount, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def a14_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of each group, ties to the first."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey", money("l_extendedprice").alias("amount"))
    top = latest.newest(lines, ["p_partkey"], [F.col("amount")], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")])
    return top.select("p_partkey", "l_orderkey", F.col("amount").cast("double").alias("amount"))
