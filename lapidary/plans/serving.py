"""Findings as clients see them, attempts of fetches as JSON, ids of contents and stamped methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.operators import serving, state
from lapidary.plans.tables import money, registration, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registration(QUERIES, SQL)

LETTER = "chr(CAST(65 + {} AS INT))"


@query(f"""
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS document_id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS project_id, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey END AS work_item_id,
  ['pass', 'fail', 'review', 'inconclusive'][1 + CAST(o_orderkey % 4 AS INT)] AS outcome, CASE o_orderkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN NULL END AS decision FROM orders),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(CAST(l_extendedprice AS DECIMAL(20,2))) AS price, max(l_returnflag) AS l_returnflag, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, 'r' || l_linenumber % 4 AS role FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
n AS (SELECT *, l_partkey % 900 AS n FROM l),
t AS (SELECT *, CASE WHEN n < 26 THEN {LETTER.format("n")} WHEN n < 702 THEN {LETTER.format("(n - 26) // 26 % 26")} || {LETTER.format("n % 26")} ELSE {LETTER.format("(n - 702) // 676")} || {LETTER.format("(n - 702) // 26 % 26")} || {LETTER.format("n % 26")} END AS col FROM n),
e AS (SELECT l_orderkey AS k, CASE l_linenumber % 3
  WHEN 0 THEN role || '|extracted|' || id || '|amount|' || price || '|' || l_linenumber || '|s|' || price || '||' || l_suppkey || '|' || CASE WHEN l_returnflag = 'N' THEN 'Bill!' || col || l_orderkey ELSE '' END || '|||'
  WHEN 1 THEN role || '|derived|' || id || '|levy|share v2|||' || price || '|a / b|||||'
  ELSE role || '|policy|' || id || '|band|clause 4.' || l_linenumber || '|' || l_linenumber || '|s|0.02||' || l_suppkey || '||4.' || l_linenumber || '|authority|' || CASE l_suppkey % 4 WHEN 0 THEN '1,234.50 to 20,000,000.00' WHEN 1 THEN 'up to 20,000,000.00' WHEN 2 THEN 'above 1,234.50' ELSE 'all values' END END AS piece
  FROM t WHERE l_returnflag <> 'A'),
x AS (SELECT k, count(*) AS n, string_agg(piece, chr(10) ORDER BY piece) AS pieces FROM e GROUP BY k)
SELECT o.k AS finding_id, CASE WHEN work_item_id IS NOT NULL THEN 'work_item' WHEN document_id IS NOT NULL THEN 'document' ELSE 'project' END AS scope, document_id, project_id, work_item_id,
  coalesce(n, 0) AS n_evidence, sha256(coalesce(pieces, '')) AS evidence_sha256, coalesce(decision, 'unreviewed') AS review_state, outcome IN ('fail', 'review') AND decision IS NULL AS needs_human_review FROM o LEFT JOIN x USING (k)""")
def a29_served_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their scope, what they cite of facts, derived values and clauses, and the review that still holds."""
    k = F.col("o_orderkey")
    outcome = F.get(F.array(*map(F.lit, ("pass", "fail", "review", "inconclusive"))), (k % 4).cast("int"))
    print_ = F.sha2(k.cast("string"), 256)
    orders = table(spark, sf_dir, "orders")
    found = orders.select(
        k.alias("finding_id"), F.when(k % 3 == 0, F.col("o_custkey")).alias("document_id"), F.when(k % 3 > 0, F.col("o_custkey")).alias("project_id"), F.when(k % 3 == 2, k).alias("work_item_id"),
        outcome.alias("outcome"), print_.alias("fingerprint"), F.lit("1").alias("rule_version"),
    )
    reviews = orders.filter(k % 5 < 2).select(  # one in two was made of another conclusion
        k.alias("review_id"), k.alias("finding_id"), F.when(k % 5 == 0, print_).otherwise("other").alias("reviewed_fingerprint"), outcome.alias("reviewed_outcome"), F.lit("1").alias("reviewed_rule_version"),
        F.lit("confirmed").alias("decision"), F.lit("r").alias("reviewer"), F.lit(1).alias("reviewed_at"),
    )
    line, supplier = F.col("l_linenumber"), F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max(money("l_extendedprice")).alias("price"), F.max("l_returnflag").alias("l_returnflag"))
    lines = lines.withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    of = lambda n: F.when(line % 3 == n, F.col("id"))
    links = lines.select(F.col("l_orderkey").alias("finding_id"), F.concat(F.lit("r"), line % 4).alias("role"), of(0).alias("fact_id"), of(1).alias("derived_fact_id"), of(2).alias("provision_id"))
    there = lines.filter("l_returnflag <> 'A'")
    place = [line.alias("page"), F.lit("s").alias("snippet"), supplier.alias("document_id")]
    facts = there.filter(line % 3 == 0).select(
        F.col("id").alias("fact_id"), F.lit("amount").alias("fact_type"), F.col("price").cast("string").alias("literal"), F.col("price").alias("numeric_value"),
        F.when(F.col("l_returnflag") == "N", "Bill").alias("sheet_name"), F.col("l_orderkey").alias("sheet_row"), (F.col("l_partkey") % 900 + 1).alias("sheet_column"), *place,
    )
    derived = there.filter(line % 3 == 1).select(F.col("id").alias("derived_fact_id"), F.lit("levy").alias("fact_type"), F.lit("share").alias("calculation"), F.lit("2").alias("calculation_version"), F.col("price").alias("numeric_value"), F.lit("a / b").alias("expression"))
    low, high = F.lit("1234.50").cast("decimal(20,2)"), F.lit("20000000").cast("decimal(20,2)")
    provisions = there.filter(line % 3 == 2).select(
        F.col("id").alias("provision_id"), F.lit("band").alias("provision_type"), F.concat(F.lit("4."), line).alias("clause"), F.lit("authority").alias("authority"), F.lit("0.02").alias("share"),
        F.when(supplier % 2 == 0, low).alias("applies_from"), F.when(supplier % 4 < 2, high).alias("applies_to_max"), *place,
    )
    shown = serving.served(found, serving.evidence(links, facts, derived, provisions), state.current_reviews(found, reviews))
    text = F.array_join(F.array_sort(F.transform("evidence", lambda e: F.array_join(F.array(*(e[name] for name in serving.EVIDENCE)), "|", ""))), "\n")
    return shown.select("finding_id", "scope", "document_id", "project_id", "work_item_id", F.size("evidence").alias("n_evidence"), F.sha2(text, 256).alias("evidence_sha256"), "review_state", "needs_human_review")


SPACE_BYTES = "".join(f"\\x{b:02X}" for b in serving.net.NAMESPACE.bytes)


@query(f"""
WITH d AS (SELECT page_id, CASE WHEN page_id % 9 > 0 THEN sha256(coalesce(html, '')) ELSE upper(sha256(coalesce(html, ''))) END AS x FROM pages),
h AS (SELECT page_id, x, sha1('{SPACE_BYTES}'::BLOB || encode(x)) AS h FROM d)
SELECT page_id, CASE WHEN regexp_full_match(x, '[0-9a-f]{{64}}') THEN h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] END AS document_id FROM h""")
def h32_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that a content has in every run; what is no digest has none."""
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    return table(spark, sf_dir, "pages").select("page_id", serving.document_id(F.when(F.col("page_id") % 9 > 0, digest).otherwise(F.upper(digest))).alias("document_id"))


@query("""
WITH a AS (SELECT user_id // 4 AS k, event_id AS n, event_type AS o, CASE WHEN event_id % 3 > 0 THEN 200 + event_id % 300 END AS s, event_id % 7 AS w FROM events),
j AS (SELECT k, n, '{"attempt":' || n || ',"outcome":"' || o || '","duration_ms":' || n // 4 || '.' || CASE n % 4 WHEN 0 THEN '0' WHEN 1 THEN '25' WHEN 2 THEN '5' ELSE '75' END || ',"status_code":' || coalesce(s::VARCHAR, 'null') || ',"error_type":' || CASE WHEN s IS NULL THEN '"timeout"' ELSE 'null' END || ',"retry_after_seconds":' || CASE WHEN w = 3 THEN '3.0' ELSE 'null' END || ',"delay_before_next_seconds":null,"reason":"said \\"no\\""}' AS b FROM a WHERE n % 5 > 0),
x AS (SELECT DISTINCT k FROM a), g AS (SELECT k, count(*) AS c, string_agg(b, ',' ORDER BY n) AS b FROM j GROUP BY k)
SELECT k AS fetch_id, sha256('[' || coalesce(b, '') || ']') AS attempts_sha256, coalesce(c, 1) AS attempt_count FROM x LEFT JOIN g USING (k)""")
def h51_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of each fetch as JSON, member by member; a fetch without a history counts one."""
    n = F.col("event_id")
    status = F.when(n % 3 > 0, F.lit(200) + n % 300).cast("int")
    nothing = F.lit(None).cast("double")
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 4).alias("fetch_id"), F.when(n % 5 > 0, n).alias("attempt"), F.col("event_type").alias("outcome"), (n / 4 + 0.0001).alias("duration_ms"), status.alias("status_code"),
        F.when(status.isNull(), "timeout").alias("error_type"), F.when(n % 7 == 3, F.lit(3.0)).alias("retry_after_seconds"), nothing.alias("delay_before_next_seconds"), F.lit('said "no"').alias("reason"),
    )
    shown = serving.attempts_json(rows, ["fetch_id"])
    return shown.select("fetch_id", F.sha2("attempts", 256).alias("attempts_sha256"), F.col("attempt_count").cast("long").alias("attempt_count"))


@query("""
SELECT l_orderkey, l_linenumber, m AS method, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'ocr:engine/1.4 | ' ELSE '' END || 'table:' || l_linestatus AS m FROM lineitem) GROUP BY ALL""")
def i23_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of transcribed documents say so in their method, before the rule that found them."""
    engine = F.when(F.col("l_returnflag") == "R", "ocr:engine/1.4")
    method = serving.stamped(F.concat(F.lit("table:"), "l_linestatus"), engine)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", method.alias("method")).agg(F.count(F.lit(1)).alias("n"))
