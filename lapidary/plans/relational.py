"""Relational, selection, calculation and rule queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import text as T
from lapidary.operators import bands, calc, latest, resolve, rules, select
from lapidary.plans.tables import FACTS_SQL, STATED_SQL, facts, money, registration, retractions, sources, stated_facts, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registration(QUERIES, SQL)


@query("""
SELECT count(*) AS n_orders, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(20,2))), 0) AS DOUBLE) AS total,
       CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
       count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_final, count(DISTINCT o_custkey) AS n_customers
FROM orders""")
def d01_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, a sum that is never null, first and last day, conditional counts, in one pass."""
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.coalesce(F.sum(money("o_totalprice")), F.lit(0)).cast("double").alias("total"),
        F.min("o_orderdate").cast("date").alias("first_day"),
        F.max("o_orderdate").cast("date").alias("last_day"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_final"),
        F.count_distinct("o_custkey").alias("n_customers"),
    )


@query("""
SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(*) AS n_lines,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS amount
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def d02_distinct_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents of each group; rows without a group are left out."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag IS NOT NULL")
    return lines.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.count(F.lit(1)).alias("n_lines"), F.sum(money("l_extendedprice")).cast("double").alias("amount"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def d04_count_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each state."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT user_id, count(*) AS seen, count(*) FILTER (event_type = 'purchase') AS stored,
                  count(*) - count(DISTINCT props) AS duplicate FROM events GROUP BY user_id)
SELECT user_id, seen, CASE WHEN seen = 0 THEN 1.0 ELSE stored / seen END AS success_rate,
       CASE WHEN seen = 0 THEN 0.0 ELSE greatest(0, duplicate / seen) END AS duplicate_rate FROM t""")
def d14_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success and duplicate rates; with nothing seen they are 1 and 0."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("stored"), (F.count(F.lit(1)) - F.count_distinct("props")).alias("duplicate")
    )
    return counts.select(
        "user_id", "seen",
        F.when(F.col("seen") == 0, 1.0).otherwise(F.col("stored") / F.col("seen")).alias("success_rate"),
        F.when(F.col("seen") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("duplicate") / F.col("seen"))).alias("duplicate_rate"),
    )


@query("""
SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS total, count(*) AS n_lines,
       string_agg(CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS VARCHAR), ' + ' ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(20,2))) AS expression
FROM lineitem GROUP BY l_orderkey""")
def d09_line_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sum of a bill's lines, written out in order."""
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    out = calc.line_sum(table(spark, sf_dir, "lineitem"), ["l_orderkey"], money("l_extendedprice"), order)
    return out.withColumn("total", F.col("total").cast("double"))


@query("""
SELECT count(*) AS n_rows, count(DISTINCT sha256(text)) AS n_digests, count(*) = count(DISTINCT sha256(text)) AS all_distinct FROM documents""")
def d17_distinctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do all contents have digests of their own?"""
    digests = table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    counts = digests.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("digest").alias("n_digests"))
    return counts.withColumn("all_distinct", F.col("n_rows") == F.col("n_digests"))


SPELLED = """CASE p_partkey % 4 WHEN 0 THEN '0' || p_size || '-' || p_partkey % 7 WHEN 1 THEN p_size || '.0' || p_partkey % 7
  WHEN 2 THEN p_size || ' / ' || p_partkey % 7 || '(a)' ELSE ' ' || p_size || '_' || p_partkey % 7 END"""


@query(rf"""
WITH s AS (SELECT p_partkey, {SPELLED} AS literal FROM part),
k AS (SELECT p_partkey, literal, array_to_string(list_transform(list_filter(string_split(upper(regexp_replace(trim(literal), '[\s\-/_]+', '.', 'g')), '.'), lambda x: x <> ''), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END), '.') AS item_key FROM s)
SELECT item_key, arg_min(literal, p_partkey) AS first_spelling, count(*) AS n_facts,
       CASE WHEN count(DISTINCT literal) = 1 THEN 'exact_identifier' ELSE 'normalised_identifier' END AS match FROM k GROUP BY item_key""")
def d19_first_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items by normalised identifier, first spelling, and whether spellings differ."""
    parts = table(spark, sf_dir, "part").select(F.lit(1).alias("scope"), F.expr(SPELLED).alias("literal"), "p_partkey")
    return resolve.linked_items(parts, T.item_key(F.col("literal")), "scope", F.col("p_partkey")).select("item_key", "first_spelling", "n_facts", "match")


@query("""
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, n_rows FROM orders
JOIN (SELECT o_custkey AS k, max(o_orderdate) AS d, count(*) AS n_rows FROM orders GROUP BY 1) ON o_custkey = k AND o_orderdate = d""")
def c01_latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a customer's latest day, and how many orders there are."""
    return latest.latest_with_ties(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "n_rows")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def c01_latest_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one latest order, ties to the highest key, by one aggregate."""
    return latest.newest_value(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderkey"), F.struct("o_orderdate", "o_orderkey"), "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def c03_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no counterpart."""
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(open_orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def c04_outer_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outer join that keeps what found nothing is an anti-join."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS n_customers FROM nation JOIN (
  SELECT c_custkey, c_nationkey AS k FROM customer WHERE c_acctbal > 0 UNION ALL SELECT NULL, s_nationkey FROM supplier WHERE s_acctbal > 0) ON k = n_nationkey GROUP BY n_name""")
def c05_union_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of origin in one union, joined to what they belong to."""
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.lit(None).cast("long").alias("c_custkey"), F.col("s_nationkey").alias("n_nationkey"))
    both = customers.unionByName(suppliers).join(table(spark, sf_dir, "nation"), "n_nationkey")
    return both.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("n_customers"))


BANDS = [(1, None, "50000.00", "0.02"), (2, "50000.00", "150000.00", "0.015"), (3, "150000.00", "300000.00", "0.01"), (4, "250000.00", None, "0.005")]
BANDS_SQL = """bands(band, low, high, rate) AS (VALUES
  (1, CAST(NULL AS DECIMAL(20,2)), 50000.00, 0.02), (2, 50000.00, 150000.00, 0.015), (3, 150000.00, 300000.00, 0.01), (4, 250000.00, NULL, 0.005))"""


def band_rows(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(BANDS, "band int, low string, high string, rate string")
    return rows.select("band", F.col("low").cast("decimal(20,2)"), F.col("high").cast("decimal(20,2)"), F.col("rate").cast("decimal(12,8)"))


@query(f"""
WITH {BANDS_SQL}, j AS (
  SELECT o_orderkey, band FROM orders LEFT JOIN bands ON (low IS NULL OR CAST(o_totalprice AS DECIMAL(20,2)) >= low) AND (high IS NULL OR CAST(o_totalprice AS DECIMAL(20,2)) <= high))
SELECT o_orderkey, count(band) AS n_bands, CASE WHEN count(band) = 1 THEN min(band) END AS band,
       CASE WHEN count(band) = 1 THEN 'applicable' WHEN count(band) = 0 THEN 'no provision' ELSE 'ambiguous' END AS verdict FROM j GROUP BY o_orderkey""")
def c07_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which band holds a value; none and several are told apart from one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("price"))
    return bands.applicable(orders, ["o_orderkey"], "price", band_rows(spark), "low", "high", "band")


@query("""
WITH i AS (SELECT l_suppkey, l_partkey, arg_max(l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS item FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
SELECT l.l_orderkey, count(*) AS n_lines, count(item) AS n_anchored FROM lineitem l LEFT JOIN i USING (l_suppkey, l_partkey) GROUP BY l.l_orderkey""")
def c09_row_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts take the item that their document's row names, the newest name winning."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_partkey").alias("sheet_row"), "l_orderkey", F.col("l_linenumber").alias("literal"), F.col("l_shipdate").alias("extractor_version"), F.struct("l_orderkey", "l_linenumber").alias("fact_id"))
    anchored = resolve.row_anchors(lines.select("document_id", "sheet_row", "l_orderkey"), lines.filter("literal <= 2"))
    return anchored.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count("item").alias("n_anchored"))


@query("""
SELECT a.s_nationkey, a.s_suppkey AS low_id, b.s_suppkey AS high_id, 'same_nation' AS relationship
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def c11_unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 L2: each pair of a group once, lower id first."""
    return resolve.unordered_pairs(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", F.lit("same_nation"))


@query("""
SELECT n_nationkey, n_name, coalesce(nc, 0) AS n_customers, coalesce(ns, 0) AS n_suppliers, coalesce(no_, 0) AS n_orders FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS no_ FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON k = n_nationkey""")
def c12_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory from sides that are counted before they are joined."""
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    own = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    per_customer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    ordered = per_customer.join(customers, "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("n").alias("n_orders"))
    joined = nations.join(own, "n_nationkey", "left").join(suppliers, "n_nationkey", "left").join(ordered, "n_nationkey", "left")
    return joined.select("n_nationkey", "n_name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_customers", "n_suppliers", "n_orders")))


@query(f"""
WITH {FACTS_SQL}, x AS (
  SELECT f.project_id, f.item, CASE WHEN r.fact_id IS NOT NULL THEN 'retracted' WHEN s.document_id IS NULL THEN 'unknown document' WHEN s.version_state <> 'active' THEN 'superseded' END AS why
  FROM facts f LEFT JOIN retractions r USING (fact_id) LEFT JOIN sources s USING (document_id))
SELECT coalesce(why, 'usable') AS reason, count(*) AS n FROM x GROUP BY 1""")
def b09_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why facts may not be used."""
    judged = select.judged_sources(facts(spark, sf_dir), sources(spark, sf_dir), retractions(spark, sf_dir))
    return judged.groupBy(F.coalesce("excluded", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def e01_newest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest reading of each row, ties to the first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return latest.newest(lines, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate")], [F.col("l_partkey"), F.col("l_suppkey")]).drop("l_shipdate")


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END, o_orderkey) AS n FROM orders) WHERE n = 1""")
def e04_best_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-ranked key of each document."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(9)
    return latest.best_ranked(table(spark, sf_dir, "orders"), "o_custkey", rank, [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""
SELECT conv_id, turn, role, row_number() OVER w AS place, lag(role) OVER w AS role_before,
       last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_turn,
       sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def e08_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running place, the row before, a value carried forward, and blocks by their starts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    order = [F.col("turn")]
    carried = latest.carried_forward(turns, ["conv_id"], order, F.when(F.col("role") == "user", F.col("turn")), "last_user_turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = latest.blocks(carried, ["conv_id"], order, F.col("role") == "user", "block")
    return out.select("conv_id", "turn", "role", F.row_number().over(w).alias("place"), F.lag("role").over(w).alias("role_before"), "last_user_turn", "block")


@query("""
WITH l AS (SELECT o_custkey AS k, list(o_orderkey % 7 ORDER BY o_orderkey) AS v FROM orders GROUP BY 1)
SELECT k AS o_custkey, len(v) AS n_rows, CAST(list_reduce(list_prepend(0, v), lambda a, x: CASE WHEN x = a + 1 THEN x ELSE a END) AS BIGINT) AS accepted FROM l""")
def e09_strict_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far numbers go 1, 2, 3, ... when others are passed over."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 7).alias("n"))
    return latest.strict_sequence(orders, ["o_custkey"], F.col("o_orderkey"), "n")


@query("""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM events""")
def e12_trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the trailing hour."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("n_recent"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT least(500, greatest(1, 700)) OFFSET greatest(0, -3)""")
def f01_catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in total order; limit within 1 and 500, offset from 0 (a page is the feature here)."""
    limit, offset = min(500, max(1, 700)), max(0, -3)
    ordered = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(offset).limit(limit)
    return ordered.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("""
SELECT c_nationkey AS k, 'both' AS side FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT k, 'customers only' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def g03_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of memberships."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c, s = F.col("c_nationkey").alias("k"), F.col("s_nationkey").alias("k")
    both = customers.filter("c_acctbal > 9000").select(c).intersect(suppliers.select(s)).withColumn("side", F.lit("both"))
    only = customers.select(c).subtract(suppliers.filter("s_acctbal > 5000").select(s)).withColumn("side", F.lit("customers only"))
    return both.unionByName(only)


@query("""
WITH u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, sha256(url) AS digest FROM pages)
SELECT host, count(*) AS accepted FROM u GROUP BY host""")
def g05_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each URL once by digest."""
    from lapidary.functions.urls import host

    urls = table(spark, sf_dir, "pages").select(host(F.col("url")).alias("host"), F.sha2(F.col("url").cast("binary"), 256).alias("digest"))
    return urls.dropDuplicates(["host", "digest"]).groupBy("host").agg(F.count(F.lit(1)).alias("accepted"))


@query(f"""
WITH {FACTS_SQL}, ok AS (
  SELECT f.*, r.fact_id IS NOT NULL OR s.document_id IS NULL OR s.version_state <> 'active' AS gone
  FROM facts f LEFT JOIN retractions r USING (fact_id) LEFT JOIN sources s USING (document_id)
), now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, item, document_id, sheet_row ORDER BY extractor_version DESC, fact_id) AS n FROM ok WHERE NOT gone) WHERE n = 1
), c AS (SELECT project_id, item, count(*) AS n_considered, count(DISTINCT numeric_value) AS n_claims, arg_min(fact_id, (document_id, sheet_row, fact_id)) AS first_id,
                arg_min(numeric_value, (document_id, sheet_row, fact_id)) AS first_value FROM now GROUP BY ALL
), e AS (SELECT project_id, item, count(*) AS n_excluded FROM ok WHERE gone GROUP BY ALL)
SELECT project_id, item, CASE WHEN n_claims = 1 THEN 'resolved' WHEN n_claims > 1 THEN 'conflicting' ELSE 'unresolved' END AS status,
       CASE WHEN n_claims = 1 THEN first_id END AS fact_id, CAST(CASE WHEN n_claims = 1 THEN first_value END AS DOUBLE) AS numeric_value,
       coalesce(n_considered, 0) AS n_considered, coalesce(n_excluded, 0) AS n_excluded
FROM c FULL JOIN e USING (project_id, item)""")
def l05_select_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact where all claims agree, a conflict where they do not, never a choice."""
    found = select.select_facts(facts(spark, sf_dir), sources(spark, sf_dir), retractions(spark, sf_dir), ["project_id", "item"])
    return found.select("project_id", "item", "status", "fact_id", F.col("numeric_value").cast("double").alias("numeric_value"), "n_considered", "n_excluded")


@query(f"""
WITH {STATED_SQL}, c AS (SELECT * FROM stated WHERE work_item_id IS NULL AND NOT withdrawn),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fact_type, document_id ORDER BY extractor_version DESC, fact_id) AS place FROM c) WHERE place = 1),
a AS (SELECT project_id, fact_type, count(*) > 1 AND bool_and(kind IN ('money', 'quantity', 'percentage', 'duration') AND numeric_value IS NOT NULL) AS comparable, count(DISTINCT numeric_value) AS n_values FROM n GROUP BY ALL),
o AS (SELECT project_id, CASE WHEN NOT comparable THEN 'inconclusive' WHEN n_values = 1 THEN 'pass' ELSE 'fail' END AS outcome FROM a)
SELECT project_id, count(*) FILTER (outcome = 'fail') AS n_fail, count(*) FILTER (outcome = 'pass') AS n_pass,
       CASE WHEN count(*) FILTER (outcome = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (outcome = 'pass') > 0 THEN 'pass' ELSE 'inconclusive' END AS outcome FROM o GROUP BY project_id""")
def k05_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the documents of a project agree on what several of them state, by their newest readings?"""
    found = stated_facts(spark, sf_dir)
    withdrawn = found.filter("withdrawn").select("fact_id")
    return select.overall(select.agreement(found, withdrawn, ["project_id"]), ["project_id"])


@query("""
WITH t AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS bill, count(*) FILTER (l_quantity = 50) AS refused FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, bill, refused, CASE o_orderkey % 3 WHEN 0 THEN bill + 1 WHEN 1 THEN bill - 1.01 END AS stated FROM orders LEFT JOIN t ON o_orderkey = l_orderkey)
SELECT o_orderkey, CAST(bill AS DOUBLE) AS bill_total, CASE WHEN refused > 0 OR bill IS NULL OR stated IS NULL THEN 'inconclusive' WHEN abs(bill - stated) <= 1.00 THEN 'pass' ELSE 'review' END AS outcome FROM s""")
def k03_bill_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: do a bill's lines add up to the total that it states?  A refused line leaves the sum incomplete."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("bill"), F.count_if(F.col("l_quantity") == 50).alias("refused"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    off = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1.00")).when(F.col("o_orderkey") % 3 == 1, F.lit("-1.01")).cast("decimal(20,2)")
    return joined.select("o_orderkey", F.col("bill").cast("double").alias("bill_total"), rules.bill_total(F.col("bill"), F.col("bill") + off, F.col("refused")).alias("outcome"))


@query(f"""
WITH {BANDS_SQL}, o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS cost, CAST(o_totalprice AS DECIMAL(20,2)) * 0.01 AS stated FROM orders
), j AS (SELECT o_orderkey, any_value(cost) AS cost, any_value(stated) AS stated, count(band) AS n, min(rate) AS rate FROM o LEFT JOIN bands ON (low IS NULL OR cost >= low) AND (high IS NULL OR cost <= high) GROUP BY 1)
SELECT o_orderkey, CAST(CASE WHEN n = 1 THEN least(cost * rate, 2500) END AS DOUBLE) AS required,
       CASE WHEN n <> 1 THEN 'inconclusive' WHEN abs(stated - least(cost * rate, 2500)) <= 1.00 THEN 'pass' ELSE 'fail' END AS outcome FROM j""")
def k02_policy_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount a policy requires, share then cap, against the amount stated."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("cost"))
    joined = bands.band_join(orders, "cost", band_rows(spark), "low", "high")
    one = joined.groupBy("o_orderkey", "cost").agg(F.count("band").alias("n"), F.min("rate").alias("rate"))
    required = F.when(F.col("n") == 1, calc.required_amount(F.col("cost"), F.col("rate"), F.lit("2500").cast("decimal(20,2)")))
    out = one.select("o_orderkey", required.alias("required"), (F.col("cost") * F.lit("0.01").cast("decimal(4,2)")).alias("stated"))
    return out.select("o_orderkey", F.col("required").cast("double").alias("required"), rules.stated_security(F.col("stated"), F.col("required")).alias("outcome"))


@query("""
WITH l AS (SELECT CAST(l_quantity AS DECIMAL(20,2)) AS q, CAST((2 * CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * 100 AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(18,0)) * 0.01 AS r, CAST(l_extendedprice AS DECIMAL(20,2)) + CASE l_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.3 ELSE 7 END AS a FROM lineitem)
SELECT CASE WHEN q * r = a THEN 'exact' WHEN least(q * (r - 0.005), q * (r + 0.005)) <= a + 0.005 AND greatest(q * (r - 0.005), q * (r + 0.005)) >= a - 0.005 THEN 'consistent_with_display_rounding' ELSE 'review' END AS consistency,
       count(*) AS n FROM l GROUP BY 1""")
def j08_row_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does quantity times rate give the amount, within what printing the rate and the amount hides?"""
    off = F.when(F.col("l_orderkey") % 3 == 0, F.lit("0.00")).when(F.col("l_orderkey") % 3 == 1, F.lit("0.30")).otherwise("7.00").cast("decimal(20,2)")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.round(money("l_extendedprice") / money("l_quantity"), 2).cast("decimal(20,2)").cast("string").alias("rate"),
        (money("l_extendedprice") + off).cast("decimal(20,2)").cast("string").alias("amount"),
    )
    return calc.row_arithmetic(lines, "quantity", "rate", "amount").groupBy("consistency").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(20,2)) - 25 AS gap, CASE l_orderkey % 3 WHEN 0 THEN 'Cum' WHEN 1 THEN 'MT' END AS unit, CAST(l_tax AS DECIMAL(20,2)) AS rate FROM lineitem),
v AS (SELECT *, CASE WHEN unit IS NULL OR lower(unit) = 'cum' THEN gap END AS variance FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(variance AS DOUBLE) AS variance, CASE WHEN variance IS NOT NULL THEN coalesce(unit, 'cum ') END AS unit, CAST(greatest(variance, CASE WHEN variance IS NOT NULL THEN 0 END) * rate AS DOUBLE) AS exposure FROM v""")
def j07_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed variance of comparable quantities, the unit as written, and what the part above zero costs."""
    unit, other = F.when(F.col("l_orderkey") % 3 == 0, "Cum").when(F.col("l_orderkey") % 3 == 1, "MT"), F.lit("cum ")
    variance = calc.difference(money("l_quantity"), F.lit(25).cast("decimal(20,2)"), unit, other)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", variance.cast("double").alias("variance"),
        F.when(variance.isNotNull(), calc.either_unit(unit, other)).alias("unit"), calc.exposure(variance, money("l_tax")).cast("double").alias("exposure"),
    )


@query("""
WITH e AS (SELECT o_custkey AS a, max(o_orderkey) AS new, min(o_orderkey) AS old FROM orders GROUP BY 1 HAVING count(*) > 1)
SELECT o.o_orderkey AS document_id, CASE WHEN e1.new IS NOT NULL THEN 'active' WHEN e2.old IS NOT NULL THEN 'superseded' END AS version_state
FROM orders o LEFT JOIN e e1 ON o.o_orderkey = e1.new LEFT JOIN e e2 ON o.o_orderkey = e2.old WHERE e1.new IS NOT NULL OR e2.old IS NOT NULL""")
def l06_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What supersedes what; mutual edges leave both unknown."""
    span = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("superseding_id"), F.min("o_orderkey").alias("superseded_id"))
    return resolve.supersession(span.select("superseding_id", "superseded_id"))


@query("""
SELECT CASE WHEN o_orderkey IS NULL THEN 'no document' WHEN c_custkey IS NULL THEN 'no provenance' WHEN n_nationkey IS NULL THEN 'no origin' WHEN r_regionkey IS NULL THEN 'no store' ELSE 'traced' END AS break_kind, count(*) AS n
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY 1""")
def p01_traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows every fact to its store and names where the chain breaks."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    # tallied before the wide joins: the chain depends on the order alone
    lines = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("has_order"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.lit(1).alias("has_customer"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"), F.lit(1).alias("has_nation"))
    regions = table(spark, sf_dir, "region").filter("r_name <> 'ASIA'").select("r_regionkey", F.lit(1).alias("has_region"))
    chain = lines.join(orders, "o_orderkey", "left").join(customers, "c_custkey", "left").join(nations, "n_nationkey", "left").join(regions, "r_regionkey", "left")
    kind = (
        F.when(F.col("has_order").isNull(), "no document").when(F.col("has_customer").isNull(), "no provenance")
        .when(F.col("has_nation").isNull(), "no origin").when(F.col("has_region").isNull(), "no store").otherwise("traced")
    )
    return chain.groupBy(kind.alias("break_kind")).agg(F.sum("n").alias("n"))
