"""Facts, derived values and provisions merged into stores that keep one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.operators import state
from lapidary.plans.tables import facts, registration, table
from lapidary.sources import shared
from lapidary.sources.keyed import Keyed

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registration(QUERIES, SQL)


def merged(spark: SparkSession, runs: list[DataFrame], key: tuple[str, ...], order: tuple[str | Column, ...], constant: str) -> DataFrame:
    """A new store after the runs, the last of which is made twice; one column of the key is constant, and Spark does not group or shuffle by it."""
    store = Keyed(spark, shared.new_path(spark, "keyed"), runs[0].schema, key, near=tuple(c for c in key if c != constant))
    for rows in [*runs, runs[-1]]:
        rewritten = store.merge(rows, order)
    if rewritten:
        raise ValueError(f"buckets {rewritten} were rewritten by rows that are stored")
    return store.rows()


@query("""
WITH k AS (SELECT l_suppkey AS document_id, l_partkey AS sheet_row, strftime(l_shipdate, '%Y%m%d') AS extractor_version, l_returnflag IS NOT DISTINCT FROM 'N' AS again,
  {'f': concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'v': CAST(l_extendedprice AS DECIMAL(20,2))} AS s FROM lineitem),
b AS (SELECT document_id, sheet_row, extractor_version, coalesce(max(s) FILTER (again), max(s) FILTER (NOT again)) AS s FROM k GROUP BY ALL)
SELECT document_id, sheet_row, extractor_version, s.f AS fact_id, CAST(s.v AS DOUBLE) AS amount FROM b""")
def m02_facts_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: facts by document, type, version and row; a second reading replaces the rows that it states again, a third changes nothing."""
    runs = [facts(spark, sf_dir, f"coalesce(l_returnflag, '') {sign} 'N'") for sign in ("<>", "=")]
    found = merged(spark, runs, state.FACT_KEY, ("fact_id",), "fact_type")
    return found.select("document_id", "sheet_row", "extractor_version", "fact_id", F.col("numeric_value").cast("double").alias("amount"))


@query("""
WITH l AS (SELECT *, CAST(l_extendedprice * 100 AS BIGINT) AS cents, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem),
x AS (SELECT 1 AS run, CASE WHEN l_linenumber >= 6 THEN l_suppkey END AS d, CASE WHEN l_linenumber <> 6 THEN l_orderkey END AS p, CASE WHEN l_linenumber < 6 THEN l_partkey || ':' ELSE '' END || 'levy' AS t, cents * 125 AS n, 'amount=' || id AS shown, 1 AS n_inputs FROM l
  UNION ALL SELECT 2, CASE WHEN l_linenumber >= 6 THEN l_suppkey END, CASE WHEN l_linenumber <> 6 THEN l_orderkey END, CASE WHEN l_linenumber < 6 THEN l_partkey || ':' ELSE '' END || 'levy', cents * 250, 'amount=' || id || '|provision:levy=' || l_linenumber, 2 FROM l WHERE l_returnflag = 'N'),
v AS (SELECT run, d, p, t, {'u': n // 1000 + CASE WHEN n % 1000 > 500 OR (n % 1000 = 500 AND n // 1000 % 2 = 1) THEN 1 ELSE 0 END, 'f': sha256(shown), 'i': n_inputs} AS s FROM x WHERE (d IS NULL) <> (p IS NULL)),
b AS (SELECT d, p, t, coalesce(max(s) FILTER (run = 2), max(s) FILTER (run = 1)) AS s FROM v GROUP BY ALL)
SELECT d AS document_id, p AS project_id, t AS fact_type, s.u AS ten_places, s.f AS inputs_fingerprint, s.i AS n_inputs FROM b""")
def m07_derived_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: derived values of items, projects and documents at ten places, with the inputs of the run that made them; one of two subjects is refused."""
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    line, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("decimal(12,2)")
    nothing = F.lit(None).cast("string")
    one = lambda role, fact, provision: F.struct(F.lit(role).alias("role"), fact.alias("fact_id"), provision.alias("provision_id"))
    fact, levy = one("amount", F.col("id"), nothing), one("levy", nothing, line.cast("string"))

    def calculated(rows: DataFrame, rate: str, inputs) -> DataFrame:
        made = rows.select(
            F.when(line >= 6, F.col("l_suppkey")).alias("document_id"), F.when(line != 6, F.col("l_orderkey")).alias("project_id"),
            F.when(line < 6, F.col("l_partkey").cast("string")).alias("work_item"), F.lit("levy").alias("fact_type"), F.lit("1").alias("calculation_version"),
            (price * F.lit(rate).cast("decimal(12,11)")).alias("numeric_value"), inputs.alias("inputs"),
        )
        return state.derived_rows(made).filter("refused IS NULL").drop("refused", "inputs_fingerprint")  # it is told from the inputs that are stored

    runs = [calculated(lines, "0.00000000125", F.array(fact)), calculated(lines.filter("l_returnflag = 'N'"), "0.00000000250", F.array(levy, fact))]
    found = merged(spark, runs, state.DERIVED_KEY, ("numeric_value", state.listed_fingerprint("inputs")), "calculation_version")
    units = (F.col("numeric_value") * F.lit(10_000_000_000)).cast("long")
    return found.select("document_id", "project_id", "fact_type", units.alias("ten_places"), state.listed_fingerprint("inputs").alias("inputs_fingerprint"), F.size("inputs").alias("n_inputs"))


@query("""
WITH x AS (SELECT 1 AS run, l_suppkey AS d, 'c' || l_linenumber AS c, '1' AS v, {'page': l_orderkey, 'share': l_discount} AS s FROM lineitem WHERE l_orderkey % 2 = 0
  UNION ALL SELECT 2, l_suppkey, 'c' || l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN '2' ELSE '1' END, {'page': l_orderkey, 'share': l_discount + 1} FROM lineitem WHERE l_orderkey % 3 = 0 OR l_orderkey % 10 = 1),
b AS (SELECT d, c, v, coalesce(max(s) FILTER (run = 2), max(s) FILTER (run = 1)) AS s FROM x GROUP BY ALL)
SELECT d AS document_id, c AS clause, v AS extractor_version, s.page AS page, CAST(s.share AS DOUBLE) AS share FROM b""")
def m08_provision_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: clauses by document, type, clause and version: a reading replaces its own version, and a new version leaves the old one."""
    order = F.col("l_orderkey")

    def read(where: str, version, more: int) -> DataFrame:
        return table(spark, sf_dir, "lineitem").filter(where).select(
            F.col("l_suppkey").alias("document_id"), F.lit("band").alias("provision_type"), F.concat(F.lit("c"), "l_linenumber").alias("clause"), version.alias("extractor_version"),
            order.alias("page"), (F.col("l_discount").cast("decimal(10,8)") + more).cast("decimal(12,8)").alias("share"),
        )

    runs = [read("l_orderkey % 2 = 0", F.lit("1"), 0), read("l_orderkey % 3 = 0 OR l_orderkey % 10 = 1", F.when(order % 3 == 0, "2").otherwise("1"), 1)]
    found = merged(spark, runs, state.PROVISION_KEY, ("page", "share"), "provision_type")
    return found.select("document_id", "clause", "extractor_version", "page", F.col("share").cast("double").alias("share"))
