"""Bills, notices, projects, writes and registries, over records derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import addresses, net, urls
from lapidary.functions import text as T
from lapidary.functions import vocabulary as V
from lapidary.operators import bands, bills, calc, extract, findings, frontier, latest, notices, resolve, rules, state
from lapidary.plans.relational import BANDS_SQL, band_rows
from lapidary.plans.tables import facts, money, registration, retractions, table
from lapidary.sources import listings, objects, registry, shared

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registration(QUERIES, SQL)

NUMBERED_SQL = """
n AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(20,2)) AS q, CAST(l_extendedprice AS DECIMAL(20,2)) AS a,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rate = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).cast("decimal(20,2)")
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(order))
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "k", money("l_quantity").alias("q"), rate.alias("r"), money("l_extendedprice").alias("a"))


def as_pages(shown: DataFrame, head: str, foot: Column) -> DataFrame:
    """(document_id, page, text): the shown rows of an order, in order, on two pages, as a table of their own."""
    rows = shown.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.sort_array(F.collect_list(F.struct("k", "shown"))).alias("v"), F.sum("a").alias("total"))
    part = lambda odd: F.array_join(F.slice(F.col("v")["shown"], 4 if odd else 1, F.size("v") if odd else F.lit(3)), "\n")
    both = F.array(F.struct(F.lit(1).alias("page"), F.concat(F.lit(head), part(False)).alias("text")), F.struct(F.lit(2).alias("page"), F.concat(part(True), foot).alias("text")))
    return shared.written(rows.select("document_id", F.explode(both).alias("p")).select("document_id", "p.page", "p.text"), "pages")


def amount(c: str) -> Column:
    return F.format_number(c, 2)


def vertical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as vertical bills: every third line is a heading with one sub-item, credits have brackets."""
    lines = numbered(spark, sf_dir)
    credit = F.when(F.col("k") % 5 == 0, F.concat(F.lit("("), amount("a"), F.lit(")"))).otherwise(amount("a"))
    rate = F.when(F.col("k") % 5 == 0, F.concat(F.lit("("), amount("r"), F.lit(")"))).otherwise(amount("r"))
    what = F.when(F.col("k") % 3 == 0, F.concat(F.lit("\nSupply of part\n(a)\npart "), "l_partkey", F.lit("\nNos."))).otherwise(F.concat(F.lit(" Supply of part "), "l_partkey", F.lit("\n400 mm thick Cum")))
    shown = F.concat_ws("\n", F.concat(F.col("k").cast("string"), what), amount("q"), rate, credit)
    return as_pages(lines.withColumn("shown", shown), "Priced Bill of Quantities\nQuantity\nRate per\nRate\nII-4\n", F.concat(F.lit("\nTotal Estimated Cost\n"), amount("total"), F.lit("\nremarks 7")))


def one_line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bills of one-line rows: some numbered in the row, some described on lines above, some with the unit above their figures."""
    lines = numbered(spark, sf_dir)
    n = F.concat(F.lit("3."), F.col("k").cast("string"))
    figs = F.concat_ws(" ", F.format_number(F.col("q").cast("int"), 0), amount("r"), amount("a"))
    shown = (
        F.when(F.col("k") % 3 == 0, F.concat(n, F.lit(" Supply of part "), "l_partkey", F.lit("\nin layers\nNos."), figs))
        .when(F.col("k") % 3 == 1, F.concat(n, F.lit(" Supply of part "), "l_partkey", F.lit(" Sqm "), figs)).otherwise(F.concat(n, F.lit("Supply of part "), "l_partkey", F.lit("\nMtrs.\n"), figs))
    )
    return as_pages(lines.withColumn("shown", shown), "PART - I\nTotal 0.01\n", F.concat(F.lit("\nTOTAL OF SECTION A 9,999,999,999.00\nGrand Total "), amount("total")))


@query(f"""
WITH {NUMBERED_SQL}
SELECT l_orderkey AS document_id, CASE WHEN k % 3 = 0 THEN k || '(a)' ELSE k || '' END AS item, CASE WHEN k % 3 = 0 THEN 'Nos.' ELSE 'Cum' END AS unit, CAST(q AS DOUBLE) AS quantity,
  CAST(CASE WHEN k % 5 = 0 THEN -a ELSE a END AS DOUBLE) AS amount, CASE WHEN k % 3 = 0 THEN 'Supply of part part ' || l_partkey ELSE 'Supply of part ' || l_partkey || ' 400 mm thick Cum' END AS description FROM n""")
def i06_vertical_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of vertical bills, sub-items with their headings, credits below zero."""
    read = bills.vertical_rows(vertical_pages(spark, sf_dir))
    return read.select("document_id", "item", "unit", F.col("quantity").cast("double").alias("quantity"), F.col("amount").cast("double").alias("amount"), "description")


@query(f"""
WITH {NUMBERED_SQL}
SELECT l_orderkey AS document_id, '3.' || k AS item, CASE k % 3 WHEN 0 THEN 'Nos' WHEN 1 THEN 'Sqm' ELSE 'Mtrs' END AS unit, CAST(q AS DOUBLE) AS quantity, CAST(a AS DOUBLE) AS amount,
  'Supply of part ' || l_partkey || CASE k % 3 WHEN 0 THEN ' in layers' WHEN 1 THEN '' ELSE ' Mtrs.' END AS description FROM n""")
def i07_bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one-line bills, with what the lines above say."""
    read = bills.line_rows(one_line_pages(spark, sf_dir))
    return read.select("document_id", "item", "unit", F.col("quantity").cast("double").alias("quantity"), F.col("amount").cast("double").alias("amount"), "description")


@query(f"""
WITH {NUMBERED_SQL}, v AS (SELECT l_orderkey, sum(a) AS t, max(k) AS m FROM n GROUP BY 1)
SELECT l_orderkey * 2 + x AS document_id, CAST(t AS DOUBLE) AS stated_total, 2 AS page FROM v, (VALUES (0), (1)) AS l(x)""")
def i14_bill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total that a bill states for itself: behind its label, or the first bare one that is not less than its rows."""
    pages = vertical_pages(spark, sf_dir).withColumn("document_id", F.col("document_id") * 2).unionByName(one_line_pages(spark, sf_dir).withColumn("document_id", F.col("document_id") * 2 + 1))
    return bills.bill_totals(pages).select("document_id", F.col("stated_total").cast("double").alias("stated_total"), "page")


@query("""
SELECT l_orderkey AS document_id, CAST(sum(CAST(l_quantity AS DECIMAL(20,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS amount, 5 * count(*) AS n_facts FROM lineitem GROUP BY 1""")
def i17_bill_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priced row as the facts that it states, and sums by type."""
    found = bills.bill_facts(bills.line_rows(one_line_pages(spark, sf_dir)))
    of = lambda t: F.sum(F.when(F.col("fact_type") == t, F.col("numeric_value"))).cast("double")
    return found.groupBy("document_id").agg(of("contracted_quantity").alias("quantity"), of("line_amount").alias("amount"), F.count(F.lit(1)).alias("n_facts"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS cost, o_orderdate, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey AS document_id, 'AB/Dean (IPS)/' || o_orderkey AS nit_number, CAST(o_orderdate AS DATE) AS document_date, CAST(cost AS DOUBLE) AS estimated_cost, CAST(CASE WHEN k < 2 THEN round(cost * (0.02 + 0.003 * k), 2) END AS DOUBLE) AS bid_security,
       CASE WHEN k = 0 THEN 'pass' WHEN k = 1 THEN 'fail' ELSE 'inconclusive' END AS outcome FROM o""")
def k01_tender_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices in four layouts, read back and judged by the share that they prescribe."""
    k, shown = F.col("o_orderkey") % 4, lambda c: F.concat(F.lit("Rs. "), F.format_number(c, 2), F.lit("/-"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", money("o_totalprice").alias("cost"), "o_orderdate")
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")  # narrow rows now, long texts soon
    rate = F.lit("0.02").cast("decimal(6,3)") + F.lit("0.003").cast("decimal(6,3)") * k
    security, half = F.round(F.col("cost") * rate, 2), F.round(F.col("cost") / 2, 2).cast("decimal(20,2)")
    far = F.lit(" and so on" * 15)
    body = (
        F.when(k == 0, F.concat(F.lit("Estimated Cost (in Rs.)  Bid Security (in Rs.)\nPeriod\nCost of Bid Document Rs. 500 "), far, shown("cost"), F.lit(" "), shown(security)))
        .when(k == 1, F.concat(F.lit("Estimated  Cost: "), shown("cost"), far, F.lit(" Bid Security "), shown(security)))
        .when(k == 2, F.concat(F.lit("Estimated Cost: civil "), shown(half), F.lit(" other "), shown(F.col("cost") - half), F.lit(" Total "), shown("cost"), F.lit(" Total with 18% GST Rs. 1")))
        .otherwise(F.concat(F.lit("two percent of the estimated cost."), far, F.lit(" Estimated Cost "), shown("cost"), far, F.lit(" EMD "), shown("cost")))
    )
    head = F.concat(F.lit("Tender No. AB/Dean (IPS)/"), "o_orderkey", F.lit(". dated "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("\n"), body)
    rules_page = F.lit("EMD or Retention of 9% of estimated cost. Performance Security @ 5% of estimated cost. EMD @ 2% of estimated cost.")
    both = F.array(F.struct(F.lit(1).alias("page"), head.alias("text")), F.struct(F.lit(2).alias("page"), rules_page.alias("text")))
    pages = shared.written(orders.select(F.col("o_orderkey").alias("document_id"), F.explode(both).alias("p")).select("document_id", "p.page", "p.text"), "pages")
    share = calc.share(F.col("bid_security"), F.col("estimated_cost"))
    return notices.tender_notice(pages).select(
        "document_id", "nit_number", "document_date", F.col("estimated_cost").cast("double").alias("estimated_cost"), F.col("bid_security").cast("double").alias("bid_security"),
        rules.share_of_cost(share, F.col("prescribed_share")).alias("outcome"),
    )


@query(f"""
WITH {BANDS_SQL}, t AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS bill, count(*) FILTER (l_quantity = 50) AS refused FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS cost, CASE WHEN o_orderkey % 5 > 0 THEN round(CAST(o_totalprice AS DECIMAL(20,2)) * (0.010 + 0.005 * (o_orderkey % 3)), 2) END AS security, CASE WHEN o_orderkey % 7 > 0 THEN 0.015 END AS prescribed FROM orders),
j AS (SELECT o_orderkey, count(band) AS n, min(rate) AS rate FROM o LEFT JOIN bands ON (low IS NULL OR cost >= low) AND (high IS NULL OR cost <= high) GROUP BY 1),
w AS (SELECT o.*, bill, refused, CASE o.o_orderkey % 3 WHEN 0 THEN bill + 1 WHEN 1 THEN bill - 1.01 END AS stated, CASE WHEN n = 1 THEN least(cost * rate, 2500) END AS required FROM o JOIN j USING (o_orderkey) LEFT JOIN t ON o_orderkey = k)
SELECT o_orderkey AS document_id, 'bid_security_matches_reference_policy' AS rule_id, CASE WHEN security IS NULL OR required IS NULL THEN 'inconclusive' WHEN abs(security - required) <= 1 THEN 'pass' ELSE 'fail' END AS outcome FROM w
UNION ALL SELECT o_orderkey, 'bid_security_share_of_estimated_cost', CASE WHEN security IS NULL OR prescribed IS NULL THEN 'inconclusive' WHEN abs(security - prescribed * cost) <= 0.001 * cost THEN 'pass' ELSE 'fail' END FROM w
UNION ALL SELECT o_orderkey, 'bill_items_reconcile_to_stated_total', CASE WHEN refused > 0 OR bill IS NULL OR stated IS NULL THEN 'inconclusive' WHEN abs(bill - stated) <= 1.00 THEN 'pass' ELSE 'review' END FROM w
UNION ALL SELECT o_orderkey, 'priced_bill_matches_advertised_estimate', 'inconclusive' FROM w""")
def k11_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every calculation and every rule over every document, in the order of rule ids."""
    key = F.col("o_orderkey")
    off = F.when(key % 3 == 0, F.lit("1.00")).when(key % 3 == 1, F.lit("-1.01")).cast("decimal(20,2)")
    part = F.lit("0.010").cast("decimal(6,3)") + F.lit("0.005").cast("decimal(6,3)") * (key % 3)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("bill_total"), F.count_if(F.col("l_quantity") == 50).alias("refused_rows"))
    cost = money("o_totalprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", cost.alias("cost"), F.when(key % 5 > 0, F.round(cost * part, 2)).alias("bid_security"), F.when(key % 7 > 0, F.lit("0.015").cast("decimal(12,8)")).alias("prescribed_share"))
    applied = bands.band_join(orders, "cost", band_rows(spark), "low", "high").groupBy("o_orderkey", "cost", "bid_security", "prescribed_share").agg(F.count("band").alias("n"), F.min("rate").alias("rate"))
    wide = applied.join(lines, "o_orderkey", "left").select(
        key.alias("document_id"), "bid_security", "prescribed_share", "bill_total", "refused_rows", (F.col("bill_total") + off).alias("stated_total"),
        calc.share(F.col("bid_security"), F.col("cost")).alias("bid_security_share"), F.when(F.col("n") == 1, calc.required_amount(F.col("cost"), F.col("rate"), F.lit("2500").cast("decimal(20,2)"))).alias("required_security"),
    )
    return rules.evaluate(wide, ["document_id"], rules.DOCUMENT_RULES)


@query("""
WITH f AS (SELECT l_orderkey AS d, CASE l_linenumber % 3 WHEN 0 THEN 'nit_number' WHEN 1 THEN 'project_reference' ELSE 'other' END AS t, lpad(l_linenumber || '', 2, '0') || l_partkey AS id, CASE WHEN l_suppkey % 2 = 0 THEN 'Ab/ ' ELSE 'aB/  ' END || l_partkey % 100 AS v FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT d, arg_min(t, (t <> 'nit_number', id, t, v)) AS t, arg_min(v, (t <> 'nit_number', id, t, v)) AS v FROM f WHERE t <> 'other' GROUP BY d),
p AS (SELECT d, t, o_orderpriority AS source_id, upper(regexp_replace(trim(v), '\\s+', ' ', 'g')) AS external_ref FROM b JOIN orders ON o_orderkey = d)
SELECT source_id, external_ref, arg_min(t, d) AS keyed_by, CASE arg_min(t, d) WHEN 'nit_number' THEN 'same_tender' ELSE 'same_contract' END AS relationship, count(*) AS n_documents, count(*) * (count(*) - 1) // 2 AS n_pairs FROM p GROUP BY ALL""")
def l01_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects from the identifiers that documents state, the strongest of each, sources apart."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "nit_number").when(F.col("l_linenumber") % 3 == 1, "project_reference").otherwise("other")
    literal = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "Ab/ ").otherwise("aB/  "), F.col("l_partkey") % 100)
    named = lines.select(F.col("l_orderkey").alias("document_id"), kind.alias("fact_type"), F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), "l_partkey").alias("fact_id"), literal.alias("literal"), "l_returnflag").filter("l_returnflag <> 'R'")
    origins = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("source_id"))
    placed = resolve.projects(named, origins, named.select("fact_id").limit(0))
    n = F.count(F.lit(1))
    return placed.groupBy("source_id", "external_ref", "keyed_by", "relationship").agg(n.alias("n_documents"), F.floor(n * (n - 1) / 2).alias("n_pairs"))


@query("""
SELECT d AS document_id, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS source_id, count(DISTINCT s) > 1 AS ambiguous FROM (SELECT l_orderkey AS d, l_shipdate < TIMESTAMP '1996-01-01' AS s FROM lineitem UNION ALL SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-01-01' FROM orders) GROUP BY d""")
def c08_sole_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origin of a document that has one; several are ambiguous, whichever way they came."""
    before = lambda c: (F.col(c) < F.lit("1996-01-01").cast("timestamp_ntz")).alias("source_id")
    retrieved = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), before("l_shipdate"))
    uploaded = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), before("o_orderdate"))
    return resolve.sole_origin(retrieved.unionByName(uploaded))


def line_id() -> Column:
    return F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH f AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id, l_orderkey AS d, 't' || l_linenumber AS t, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber END AS sheet_row, l_returnflag FROM lineitem),
s AS (SELECT o_orderkey AS d, 't' || x AS t FROM orders, (VALUES (1), (3)) AS v(x) WHERE o_orderstatus = 'O')
SELECT fact_id, 'reference document' AS reason, '5' AS version FROM f JOIN s USING (d, t) WHERE sheet_row IS NULL AND fact_id NOT IN (SELECT fact_id FROM f WHERE l_returnflag = 'R')""")
def m03_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: facts of documents, of any version, that a run withdraws because it suppresses their type; once each."""
    lines = table(spark, sf_dir, "lineitem")
    stated = lines.select(line_id().alias("fact_id"), F.col("l_orderkey").alias("document_id"), F.concat(F.lit("t"), "l_linenumber").alias("fact_type"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber")).alias("sheet_row"))
    kinds = F.explode(F.array(F.lit("t1"), F.lit("t3"))).alias("fact_type")
    suppressed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("document_id"), kinds)
    return state.withdrawn(stated, retractions(spark, sf_dir), suppressed, "reference document", "5")


@query("""
WITH l AS (SELECT l_orderkey AS id, l_linenumber % 3 AS s, 'r' || l_linenumber % 2 AS rule_id, l_returnflag = 'N' AS fresh, l_linestatus AS outcome, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id FROM lineitem),
f AS (SELECT s, id, rule_id, fresh, arg_max(outcome, (fact_id, outcome)) AS outcome FROM l GROUP BY ALL), k AS (SELECT s, id, rule_id, bool_or(fresh) AS fresh FROM f GROUP BY ALL),
g AS (SELECT k.*, f.outcome FROM k JOIN f ON k.s = f.s AND k.id = f.id AND k.rule_id = f.rule_id AND k.fresh = f.fresh),
e AS (SELECT g.s, g.id, g.rule_id, count(*) AS n, sha256(string_agg(fact_id, '|' ORDER BY fact_id)) AS h FROM g JOIN l ON g.s = l.s AND g.id = l.id AND g.rule_id = l.rule_id AND g.fresh = l.fresh GROUP BY ALL)
SELECT CASE s WHEN 0 THEN 'document' WHEN 1 THEN 'project' ELSE 'work_item' END AS scope, id AS scope_id, rule_id, outcome, n AS n_evidence, h AS cited FROM g JOIN e USING (s, id, rule_id)""")
def m04_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 M5 M6: findings of documents, projects and work items: a run replaces its own, with the evidence rebuilt and not appended to."""
    scope = F.get(F.array(*map(F.lit, ("document", "project", "work_item"))), F.col("l_linenumber") % 3)
    links = table(spark, sf_dir, "lineitem").select(
        scope.alias("scope"), F.col("l_orderkey").alias("scope_id"), F.concat(F.lit("r"), F.col("l_linenumber") % 2).alias("rule_id"), F.lit("1").alias("rule_version"),
        line_id().alias("fact_id"), F.col("l_linestatus").alias("outcome"), (F.col("l_returnflag") == "N").alias("fresh"),
    )
    key = [*state.FINDING_KEY]
    made = lambda own: own.groupBy(*key).agg(F.max_by("outcome", F.struct("fact_id", "outcome")).alias("outcome"), F.lit(0).alias("run"))
    old, new = links.filter("NOT fresh").drop("fresh"), links.filter("fresh").drop("fresh")
    stored = state.stored_findings(made(old), made(new), F.col("run"))
    cited = state.rebuilt_evidence(old, new, made(new)).groupBy(*key).agg(F.count(F.lit(1)).alias("n_evidence"), F.sha2(F.array_join(F.array_sort(F.collect_list("fact_id")), "|").cast("binary"), 256).alias("cited"))
    return stored.join(cited, key).select("scope", "scope_id", "rule_id", "outcome", "n_evidence", "cited")


@query("""
WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) AS v FROM orders)
SELECT o_orderkey AS finding_id, sha256('{"detail":{"a":"' || v || '","b":"é"},"evidence":[["cost","fact","' || v || '",null]],"rule":["r","1"],"verdict":["' || o_orderstatus || '","at most ' || o_orderpriority || '","' || v || '"]}') AS fingerprint FROM t""")
def h46_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a conclusion, from canonical JSON with keys in order."""
    v = money("o_totalprice").cast("string")
    evidence = F.array(F.array(F.lit("cost"), F.lit("fact"), v, F.lit(None).cast("string")))
    print_ = state.conclusion_fingerprint([F.lit("r"), F.lit("1")], [F.col("o_orderstatus"), F.concat(F.lit("at most "), "o_orderpriority"), v], F.create_map(F.lit("b"), F.lit("é"), F.lit("a"), v), evidence)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), print_.alias("fingerprint"))


@query("""
WITH i AS (SELECT l_orderkey AS k, l_linenumber % 2 AS p, 'role' || l_linenumber AS role, l_partkey || '-' || l_suppkey AS id FROM lineitem)
SELECT k AS derived_id, sha256(string_agg(CASE p WHEN 1 THEN 'provision:' ELSE '' END || role || '=' || id, '|' ORDER BY p, role, CASE p WHEN 1 THEN 'provision:' ELSE '' END || role || '=' || id)) AS fingerprint FROM i GROUP BY k""")
def h47_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what fed a calculation: facts, then provisions, by role."""
    provision, id_ = F.col("l_linenumber") % 2 == 1, F.concat_ws("-", "l_partkey", "l_suppkey")
    inputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("derived_id"), F.concat(F.lit("role"), "l_linenumber").alias("role"), F.when(~provision, id_).alias("fact_id"), F.when(provision, id_).alias("provision_id"))
    return state.inputs_fingerprint(inputs, ["derived_id"])


@query("""
WITH a AS (SELECT o_orderkey AS k, o_custkey AS f, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'seen' END AS note, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ' qs' END AS who FROM orders)
SELECT k AS review_id, CASE WHEN f % 3 = 0 THEN 'no finding' WHEN note = ' ' THEN 'no note' WHEN who IS NULL THEN 'no reviewer' END AS refused, trim(who) AS reviewer, CASE WHEN f % 3 > 0 THEN sha256(f || '') END AS reviewed_fingerprint FROM a""")
def m09_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: reviews capture the conclusion as it stands; a blank note or reviewer is refused."""
    own = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("finding_id"), F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256).alias("fingerprint"), F.lit("fail").alias("outcome"), F.lit("1").alias("rule_version"))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("finding_id"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("seen").alias("note"), F.when(F.col("o_orderkey") % 7 > 0, " qs").alias("reviewer"))
    return state.recorded_reviews(own, asked).select("review_id", "refused", "reviewer", "reviewed_fingerprint")


TYPE_NAMES = sorted(V.DOCUMENT_TYPES)
KIND = f"CAST({TYPE_NAMES} AS VARCHAR[])"


@query(f"""
WITH p AS (SELECT p_partkey, {KIND}[1 + p_partkey % 23] AS kind, CASE WHEN p_size % 4 > 0 THEN {KIND}[1 + p_size % 23] END AS suggested, CASE WHEN p_size % 3 = 0 THEN 'N/1' END AS nit, ['pdf','xlsx','docx'][1 + p_size % 3] AS fmt, {list(("failed", "quarantined", "processing", "processed", "downloaded"))}[1 + p_partkey % 5] AS st FROM part)
SELECT p_partkey, kind IN {V.REFERENCE_TYPES} AND nit IS NULL AS suppressed, fmt NOT IN ('pdf', 'xlsx') AS unreadable, coalesce(suggested <> kind, false) AS disputed,
  CASE WHEN st = 'failed' THEN 'failed' WHEN st = 'quarantined' THEN 'needs_attention' WHEN fmt = 'docx' THEN 'unsupported' WHEN st = 'processing' THEN 'processing' WHEN st = 'processed' AND p_partkey % 2 = 0 THEN 'needs_attention' WHEN st = 'processed' THEN 'processed' ELSE 'uploaded' END AS status FROM p""")
def b16_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a document, and the flags that go with it."""
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n)
    kind, suggested = pick(TYPE_NAMES, (F.col("p_partkey") % 23).cast("int")), F.when(F.col("p_size") % 4 > 0, pick(TYPE_NAMES, F.col("p_size") % 23))
    fmt, now = pick(("pdf", "xlsx", "docx"), F.col("p_size") % 3), pick(("failed", "quarantined", "processing", "processed", "downloaded"), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", V.suppressed(kind, F.when(F.col("p_size") % 3 == 0, "N/1")).alias("suppressed"), V.unreadable(fmt).alias("unreadable"), V.disputed(kind, suggested).alias("disputed"), V.status(now, fmt, F.col("p_partkey") % 2 == 0).alias("status")
    )


TYPES_SQL = ", ".join(f"('{k}', '{c}', '{w}')" for k, (c, w) in V.DOCUMENT_TYPES.items())


@query(f"""
WITH t(kind, category, workflow) AS (VALUES {TYPES_SQL}), p AS (SELECT {KIND}[1 + p_partkey % 23] AS kind, CASE p_size % 3 WHEN 0 THEN 'parent_document' WHEN 1 THEN 'child_document' ELSE 'amends' END AS rel FROM part)
SELECT category, workflow, CASE WHEN kind IN {V.ROLES} THEN kind ELSE 'unclassified' END AS role, CASE rel WHEN 'parent_document' THEN 'child_document' WHEN 'child_document' THEN 'parent_document' ELSE rel END AS inverse, count(*) AS n FROM p JOIN t USING (kind) GROUP BY ALL""")
def h43_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, link of the chain, role and inverse of relationships."""
    kind = F.get(F.array(*map(F.lit, TYPE_NAMES)), (F.col("p_partkey") % 23).cast("int"))
    rel = F.when(F.col("p_size") % 3 == 0, "parent_document").when(F.col("p_size") % 3 == 1, "child_document").otherwise("amends")
    rows = table(spark, sf_dir, "part").select(V.category(kind).alias("category"), V.workflow(kind).alias("workflow"), V.role(kind).alias("role"), V.inverse(rel).alias("inverse"))
    return rows.groupBy("category", "workflow", "role", "inverse").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT p_partkey AS document_id, p_brand AS document_type, 'declared' AS type_authority FROM part), c AS (SELECT l_partkey AS document_id, arg_max('t' || l_linenumber, (l_shipdate, 't' || l_linenumber)) AS t FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT document_id, coalesce(t, document_type) AS document_type, CASE WHEN t IS NULL THEN type_authority ELSE 'human_confirmed' END AS type_authority FROM d LEFT JOIN c USING (document_id)""")
def m11_confirmed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that a named person confirmed last; a confirmation without a name counts for nothing."""
    documents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("document_type"), F.lit("declared").alias("type_authority"))
    said = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("document_id"), F.concat(F.lit("t"), "l_linenumber").alias("document_type"), F.col("l_shipdate").alias("confirmed_at"), F.when(F.col("l_returnflag") == "A", "qs").otherwise(" ").alias("confirmed_by"))
    return state.confirmed_types(documents, said)


@query("""
WITH q AS (SELECT event_id, event_id % 4 AS depth, ts FROM events WHERE event_type = 'view' AND event_id % 6 < 5)
SELECT event_id AS id, depth FROM q ORDER BY depth, ts, event_id LIMIT 50""")
def f02_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty rows of a queue by depth, age and id (the claim's size is the feature)."""
    rows = table(spark, sf_dir, "events").filter("event_type = 'view'").select(
        F.col("event_id").alias("id"), F.lit("discovered").alias("state"), (F.col("event_id") % 6).alias("attempts"), (F.col("event_id") % 4).alias("depth"), F.col("ts").cast("timestamp").alias("discovered_at"),
        *(F.lit(None).cast("timestamp").alias(c) for c in ("lease_expires_at", "next_attempt_after", "dead_lettered_at")),
    )
    return frontier.claim(rows, F.lit("2025-01-01").cast("timestamp"), 50).select("id", "depth")


@query("""
(SELECT 'run' AS list, event_id AS id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20) UNION ALL (SELECT 'dead', event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100)
UNION ALL (SELECT 'small first', doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 50) UNION ALL (SELECT 'null as 0', doc_id FROM labels ORDER BY CASE WHEN quality = 1 THEN 0 ELSE doc_id END, doc_id LIMIT 30)""")
def f03_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent runs, dead letters, documents by size, and rows without a number as number 0 (lists of a length)."""
    events, docs, labels = (table(spark, sf_dir, t) for t in ("events", "documents", "labels"))
    newest = lambda kind, n: events.filter(F.col("event_type") == kind).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    named = lambda rows, name, c: rows.select(F.lit(name).alias("list"), F.col(c).alias("id"))
    number = F.when(F.col("quality") == 1, F.lit(0)).otherwise(F.col("doc_id"))
    return (
        named(newest("click", 20), "run", "event_id").unionByName(named(newest("error", 100), "dead", "event_id"))
        .unionByName(named(docs.orderBy("n_chars", "doc_id").limit(50), "small first", "doc_id")).unionByName(named(labels.orderBy(number, "doc_id").limit(30), "null as 0", "doc_id"))
    )


@query("""
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'manual_upload' ELSE 'http_crawl' END AS r, CASE WHEN c_custkey % 5 > 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'http' ELSE 'https' END || '://h' || c_custkey END AS u, c_custkey % 2 = 0 AS ins, CASE WHEN c_custkey % 11 = 0 THEN 'ignore' ELSE 'respect' END AS rob,
  CASE WHEN c_custkey % 7 = 0 THEN 'restricted' ELSE 'public' END AS acc, c_acctbal > 0 AS en, CASE WHEN c_custkey % 9 > 0 THEN 'approved' END AS v, CASE WHEN c_custkey % 13 > 0 THEN 'c' || c_custkey % 13 END AS cr, c_nationkey AS rpm, 3.0 AS delay FROM customer)
SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN r <> 'manual_upload' AND u IS NULL THEN 'base_url is required' END, CASE WHEN u LIKE 'http://%' AND NOT ins THEN 'plain HTTP is not acknowledged' END, CASE WHEN (u IS NULL OR u NOT LIKE 'http://%') AND ins THEN 'insecure transport is allowed for nothing' END,
  CASE WHEN r = 'http_crawl' AND rob <> 'respect' THEN 'robots are not respected' END, CASE WHEN en AND r <> 'manual_upload' AND acc = 'restricted' THEN 'restricted access is enabled' END, CASE WHEN en AND v IS NULL THEN 'enabled without approval' END,
  CASE WHEN en AND r <> 'manual_upload' AND cr IS NULL THEN 'enabled without a crawler' END, CASE WHEN rpm > 20 THEN 'requests_per_minute cannot be reached with the delay' END, CASE WHEN en AND cr = 'c12' THEN 'enabled with an unknown crawler' END], lambda x: x IS NOT NULL)) AS problem FROM c) GROUP BY 1
UNION ALL SELECT 'collectable', count(*) FROM c WHERE en AND v = 'approved'""")
def p05_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a registry, all at once, and how much of it may be collected."""
    k = F.col("c_custkey")
    sources = table(spark, sf_dir, "customer").select(
        F.lit("a.yaml").alias("file"), k.cast("int").alias("position"), F.lit(None).cast("string").alias("error"), k.cast("string").alias("id"), F.when(k % 4 == 0, "manual_upload").otherwise("http_crawl").alias("retrieval"),
        F.when(k % 5 > 0, F.concat(F.when(k % 3 == 0, "http").otherwise("https"), F.lit("://h"), k)).alias("base_url"), (k % 2 == 0).alias("allow_insecure_transport"), F.when(k % 11 == 0, "ignore").otherwise("respect").alias("robots_policy"),
        F.when(k % 7 == 0, "restricted").otherwise("public").alias("access"), (F.col("c_acctbal") > 0).alias("enabled"), F.when(k % 9 > 0, "approved").alias("verification_status"), F.when(k % 13 > 0, F.concat(F.lit("c"), k % 13)).alias("crawler"),
        F.col("c_nationkey").alias("requests_per_minute"), F.lit(3.0).alias("min_delay_seconds"),
    )
    wrong = registry.problems(sources, [f"c{i}" for i in range(1, 12)]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    return wrong.unionByName(registry.collectable(sources).agg(F.lit("collectable").alias("problem"), F.count(F.lit(1)).alias("n")))


@query("""
WITH p AS (SELECT page_id, 'https://h' || page_id % 3 || '/a' AS cur, CASE page_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 304 WHEN 2 THEN 303 ELSE 301 END AS status, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/b' WHEN 2 THEN 'http://h1/c' WHEN 3 THEN 'ftp://x/' ELSE 'a' END AS loc, page_id % 7 AS hops FROM pages)
SELECT page_id, CASE WHEN status IN (200, 304) THEN 'status' WHEN loc = '' THEN 'no location' WHEN hops >= 5 THEN 'hops' WHEN loc LIKE 'ftp%' THEN 'location' WHEN loc = 'a' THEN 'loop' WHEN loc LIKE 'http:%' THEN 'downgrade' END AS reason,
  CASE WHEN status NOT IN (200, 304) AND loc = '/b' AND hops < 5 THEN replace(cur, '/a', '/b') END AS url FROM p""")
def n10_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a redirect is followed, and the first reason against it."""
    k = F.col("page_id")
    current = F.concat(F.lit("https://h"), k % 3, F.lit("/a"))
    status = F.when(k % 9 == 0, 200).when(k % 9 == 1, 304).when(k % 9 == 2, 303).otherwise(301)
    location = F.when(k % 5 == 0, "").when(k % 5 == 1, "/b").when(k % 5 == 2, "http://h1/c").when(k % 5 == 3, "ftp://x/").otherwise("a")
    history = F.concat(F.array_repeat(F.lit("https://other/"), (k % 7).cast("int")), F.array(current))
    found = frontier.redirect(status, location, current, history, F.lit(False))
    return table(spark, sf_dir, "pages").select("page_id", found["reason"].alias("reason"), found["url"].alias("url"))


@query("""
WITH u AS (SELECT user_id, min(value) AS v FROM events GROUP BY 1), d AS (SELECT user_id, CASE WHEN user_id % 4 > 0 THEN CAST(round(CAST(v AS DECIMAL(20,2)) * (user_id % 5), 1) AS DOUBLE) END AS asked FROM u)
SELECT user_id, CASE WHEN asked > 2 THEN least(30, greatest(1, CAST(floor(60 / asked) AS INT))) ELSE 30 END AS per_minute, CASE WHEN asked > 2 THEN asked ELSE 2.0 END AS delay, coalesce(asked > 2 AND asked > 300, false) AS refused FROM d""")
def n13_polite_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl delay only slows down, and one that is too long is refused."""
    asked = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("v")).select("user_id", F.when(F.col("user_id") % 4 > 0, F.round(money("v") * (F.col("user_id") % 5), 1).cast("double")).alias("asked"))
    x = frontier.polite_limits(F.lit(30), F.lit(4), F.lit(2.0), F.col("asked"))
    return asked.select("user_id", x["per_minute"].alias("per_minute"), x["delay"].alias("delay"), x["refused"].alias("refused"))


@query("""
SELECT l_orderkey AS finding_id, count(*) FILTER (l_linenumber % 3 = 0 AND l_partkey % 2 = 0) AS n_missing, count(*) FILTER (l_linenumber % 3 = 0 AND l_partkey % 2 = 1 AND s_suppkey IS NULL) AS n_no_document, count(*) FILTER (l_linenumber % 3 = 0 AND l_partkey % 2 = 1 AND s_suppkey IS NOT NULL AND s_acctbal < 0) AS n_no_provenance
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey > 3 GROUP BY 1""")
def p04_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions that findings cite, down to a document with an origin, and where the chain breaks."""
    lines = table(spark, sf_dir, "lineitem")
    links = lines.filter("l_linenumber % 3 = 0").select(F.col("l_orderkey").alias("finding_id"), F.lit("policy").alias("role"), F.lit(None).cast("string").alias("fact_id"), F.lit(None).cast("string").alias("derived_fact_id"), line_id().alias("provision_id"))
    provisions = lines.filter("l_linenumber % 3 = 0 AND l_partkey % 2 = 1").select(line_id().alias("provision_id"), F.col("l_discount").alias("value"), F.col("l_suppkey").alias("document_id")).dropDuplicates(["provision_id"])
    none = lambda c: lines.limit(0).select(F.lit("").alias(c), F.lit("").alias("value"), F.lit(0).cast("long").alias("document_id"))
    documents = table(spark, sf_dir, "supplier").filter("s_nationkey > 3").select(F.col("s_suppkey").alias("document_id"), "s_acctbal")
    resolved = findings.evidence_resolved(links, none("fact_id"), none("derived_fact_id"), provisions)
    broken = findings.breaks(resolved, documents.select("document_id"), documents.filter("s_acctbal >= 0"))
    of = lambda k, name: F.coalesce(F.sum(F.when(F.col("break_kind") == k, 1)), F.lit(0)).alias(name)
    tallies = broken.groupBy("finding_id").agg(of("no fact", "n_missing"), of("no document", "n_no_document"), of("no provenance", "n_no_provenance"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return lines.select(F.col("l_orderkey").alias("finding_id")).distinct().join(tallies, "finding_id", "left").select("finding_id", *map(zero, ("n_missing", "n_no_document", "n_no_provenance")))


@query(r"""
WITH n AS (SELECT page_id, sha256(html) AS h, url, 'C:\x\' || CASE page_id % 3 WHEN 0 THEN 'CON' WHEN 1 THEN '_a b' ELSE 'n(1)' END || '.pdf' AS f FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'CON_file.pdf' WHEN 1 THEN 'a_b.pdf' ELSE 'n_1_.pdf' END AS safe, CASE page_id % 3 WHEN 0 THEN 'CON.pdf' WHEN 1 THEN '_a b.pdf' ELSE 'n(1).pdf' END AS shown, 'derived/text/' || h || '/p1' AS key, 'pdf' AS declared, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'zip' END AS sniffed, page_id % 2 = 0 AS fits FROM n""")
def h15_names_and_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made safe and shown, formats by name and by first bytes, derived keys."""
    k = F.col("page_id")
    name = F.concat(F.lit("C:\\x\\"), F.when(k % 3 == 0, "CON").when(k % 3 == 1, "_a b").otherwise("n(1)"), F.lit(".pdf"))
    head = F.when(k % 2 == 0, F.lit("255044462D31")).otherwise("504B030400")
    declared, sniffed = urls.format_of_path(name), urls.sniffed(F.unhex(head))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    return table(spark, sf_dir, "pages").select(
        "page_id", net.safe_filename(name).alias("safe"), net.shown_name(name).alias("shown"), objects.derived_key(F.lit("text"), digest, F.lit("p1")).alias("key"), declared.alias("declared"), sniffed.alias("sniffed"), urls.compatible(declared, sniffed).alias("fits")
    )


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN 'ipv4_mapped' ELSE NULL END AS refused, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN 60 END AS wait, event_id * 2 AS length, CASE event_id % 2 WHEN 0 THEN 'a;' || event_id || '.pdf' ELSE 'naïve ' || event_id END AS filename FROM events""")
def h37_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that are refused, waits, lengths and file names of headers."""
    k = F.col("event_id")
    address = F.when(k % 4 == 0, "127.0.0.1").when(k % 4 == 1, "192.168.0.9").when(k % 4 == 2, "::ffff:8.8.8.8").otherwise("8.8.8.8")
    after = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "Mon, 01 Jan 2024 00:01:00 GMT").otherwise("soon")
    name = F.when(k % 2 == 0, F.concat(F.lit('attachment; filename="a;'), k, F.lit('.pdf"'))).otherwise(F.concat(F.lit("inline; filename*=UTF-8''na%C3%AFve%20"), k))
    return table(spark, sf_dir, "events").select(
        "event_id", addresses.refused(address).alias("refused"), net.retry_after_seconds(after, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("wait"), net.content_length((k * 2).cast("string")).alias("length"), net.disposition_filename(name).alias("filename")
    )


@query("""
WITH c AS (SELECT c_custkey AS d, c_nationkey + 2 AS item_row FROM customer)
SELECT d AS document_id, 1 AS n_items, CAST(CASE WHEN d % 3 = 0 THEN -12.50 ELSE 1200.0 END AS DOUBLE) AS quantity, 'BOQ!' || CASE WHEN d % 2 = 0 THEN 'B' ELSE 'AB' END || item_row AS cell, 'PRJ-' || d AS reference FROM c""")
def i08_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows, item rows, cell names and project lines of sheets."""
    k, row = F.col("c_custkey"), F.col("c_nationkey")
    cell = lambda r, c, v: F.struct(r.cast("int").alias("row"), F.lit(c).alias("col"), v.cast("string").alias("value"))
    cells = F.array(
        cell(F.lit(1), 1, F.concat(F.lit("Project Ref: PRJ-"), k)), cell(row + 1, 1, F.lit(" Item  No")), cell(row + 1, 2, F.lit("Quantity (Rs)")), cell(row + 2, 1, F.lit("4.7.1")),
        cell(row + 2, 2, F.when(k % 3 == 0, "(12.50)").otherwise("1,200")), cell(row + 3, 1, F.lit("Total")), cell(row + 3, 2, F.lit("9")),
    )
    sheet = table(spark, sf_dir, "customer").select(k.alias("document_id"), F.explode(cells).alias("c")).select("document_id", "c.*")
    aliases = spark.createDataFrame([("item no", "item"), ("quantity", "quantity")], "label string, field string")
    header = extract.sheet_header(sheet, aliases)
    rows = extract.sheet_rows(sheet, header).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_items"), F.max("quantity_value").alias("quantity"), F.max("row").alias("row"))
    at = extract.cell_reference(F.lit("BOQ"), F.col("row"), F.when(F.col("document_id") % 2 == 0, 2).otherwise(28))
    return rows.join(extract.project_reference(sheet).select("document_id", "reference").hint("merge"), "document_id").select("document_id", "n_items", F.col("quantity").cast("double").alias("quantity"), at.alias("cell"), "reference")


@query("""
SELECT kind, reason, count(*) AS n FROM (SELECT 'detail' AS kind, NULL AS reason FROM pages UNION ALL SELECT 'listing', NULL FROM pages WHERE page_id % 7 < 5 UNION ALL SELECT 'file', CASE page_id % 4 WHEN 1 THEN 'no extension' WHEN 2 THEN 'format' WHEN 3 THEN 'empty' END FROM pages) GROUP BY ALL""")
def i21_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings to details and next pages, details to files, with what is passed over."""
    k = F.col("page_id")
    body = F.concat(F.lit('{"total_pages": 5, "page": '), k % 7, F.lit(', "items": [{"id": "'), k, F.lit('"}, {"id": "x"}, {"id": "'), k, F.lit('"}]}'))
    link = F.when(k % 4 == 0, "http://h/a.pdf").when(k % 4 == 1, "http://h/a").when(k % 4 == 2, "http://h/a.png").otherwise("")
    pages = table(spark, sf_dir, "pages").select("url", F.lit(0).alias("depth"), body.alias("body"), F.concat(F.lit('{"id": "1", "files": {"f": "'), link, F.lit('"}}')).alias("detail"))
    links = listings.listing_links(pages.select("url", "depth", "body"), "http://d/", "http://l/").select("kind", F.lit(None).cast("string").alias("reason"))
    files = listings.detail_documents(pages.select("url", "depth", F.col("detail").alias("body"))).select(F.lit("file").alias("kind"), "reason")
    return links.unionByName(files).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_partkey || '|' || p_size AS item, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey AND l_linenumber <= 3 GROUP BY ALL")
def b07_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived values of an item by the item itself; a prefix of a name would take % and _ for more than they are."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_partkey", "p_size").alias("item"))
    derived = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.col("l_partkey"), F.lit(":variance")).alias("fact_type"))
    return derived.filter(F.col("fact_type").startswith(F.concat(F.col("p_partkey"), F.lit(":")))).join(parts, "p_partkey").groupBy("p_partkey", "item").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT 's' || o_custkey % 50 AS source_id, upper(o_orderpriority || '/' || o_custkey % 9) AS ref, o_orderkey FROM orders)
SELECT source_id, ref AS external_ref FROM s GROUP BY ALL HAVING min(o_orderkey) > 100""")
def m01_declared_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that are declared for the first time; a reference is unique within its source."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 50).alias("source_id"), T.project_key(F.concat_ws("/", "o_orderpriority", F.col("o_custkey") % 9)).alias("external_ref"), "o_orderkey")
    key = ["source_id", "external_ref"]
    return state.new_rows(rows.filter("o_orderkey > 100").select(*key), rows.filter("o_orderkey <= 100").select(*key), key)


@query("""
WITH d AS (SELECT sha256(html) AS h, min(length(html)) AS n FROM pages GROUP BY 1)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'size' ELSE 'format' END AS conflict FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0""")
def p07_provenance_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrievals whose size or format contradicts the stored document with their digest."""
    k, digest, size = F.col("page_id"), F.sha2(F.col("html").cast("binary"), 256), F.char_length("html")
    pages = table(spark, sf_dir, "pages")
    documents = pages.groupBy(digest.alias("sha256")).agg(F.min(size).alias("length"), F.lit("html").alias("file_format"))
    seen = pages.select("page_id", digest.alias("sha256"), F.when(k % 3 == 0, size + 1).otherwise(size).alias("length"), F.when(k % 5 == 0, "pdf").otherwise("html").alias("file_format"))
    return objects.conflicts(seen, documents).select("page_id", F.when(F.col("length") != F.col("known_length"), "size").otherwise("format").alias("conflict"))


@query("""
WITH n AS (SELECT l_suppkey, l_partkey, max(strftime(l_shipdate, '%Y%m%d')) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT l_suppkey AS document_id, count(*) AS n_rows, max(v) AS newest FROM n GROUP BY 1""")
def e03_document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest reading of each row of a document, withdrawn ones left out."""
    own = facts(spark, sf_dir).join(retractions(spark, sf_dir), "fact_id", "left_anti")
    current = latest.newest(own, ["document_id", "sheet_row"], [F.col("extractor_version")], [F.col("fact_id")])
    return current.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("extractor_version").alias("newest"))
