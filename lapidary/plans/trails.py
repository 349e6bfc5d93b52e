"""Job counters over restarts, links of pages, chains of redirects, findings followed to the bytes that they rest on, and rate schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions import addresses, markup
from lapidary.operators import bands, extract, findings, frontier
from lapidary.plans.tables import money, registration, table
from lapidary.sources import shared
from lapidary.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registration(QUERIES, SQL)


@query("""
WITH o AS (SELECT CASE WHEN user_id % 3 > 0 THEN user_id ELSE 0 END AS job_id, event_id % 12 AS k, ts FROM events),
c AS (SELECT job_id, count(*) FILTER (k < 4) AS pages_read, count(*) FILTER (k IN (4, 5, 6)) AS documents_stored, count(*) FILTER (k IN (7, 8)) AS documents_duplicate, count(*) FILTER (k = 9) AS documents_failed, count(*) FILTER (k = 10) AS documents_quarantined,
  floor(epoch(max(ts))) - floor(epoch(min(ts))) AS elapsed FROM o GROUP BY 1)
SELECT * EXCLUDE elapsed, CASE WHEN job_id % 5 > 0 AND elapsed >= 1000000 THEN 'time limit' WHEN documents_stored + documents_duplicate + documents_failed + documents_quarantined >= 30 THEN 'document limit' WHEN pages_read >= 10 THEN 'page limit' END AS stopped FROM c""")
def n06_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of jobs kept over a stop, a start and a start with nothing new, and the limits that they have reached; a third of the users are one job."""
    k = F.col("event_id") % 12
    outcome = F.when(k < 4, "page").when(k < 7, "stored").when(k < 9, "duplicate").when(k == 9, "failed").when(k == 10, "quarantined").otherwise("seen")
    job = F.when(F.col("user_id") % 3 > 0, F.col("user_id")).otherwise(0)
    events = table(spark, sf_dir, "events").select("event_id", job.cast("bigint").alias("job_id"), outcome.alias("outcome"), F.col("ts").cast("timestamp").alias("at"))
    inbox, path = shared.new_path(spark, "outcomes"), shared.new_path(spark, "jobs")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1 OR event_id IS NULL"):
        events.filter(part).drop("event_id").write.mode("append").parquet(inbox)
        jobs.resumed(spark, inbox, path)
    counters = jobs.resumed(spark, inbox, path)  # nothing new: nothing changes
    stopped = jobs.stop_reason(F.when(F.col("job_id") % 5 > 0, 1_000_000), F.lit(30), F.lit(10))
    return counters.select("job_id", *jobs.COUNTERS.values(), stopped.alias("stopped"))


#: Forms of links, and what looks like one, put before each page's own; {k} is the page's number.
FORMS = """<area href=/a{k}><IFRAME name=f SRC='/f{k}?x=1&amp;y=2'></iframe><!-- <a href="/no"> --><script>"<a href='/no'>"</script><a class="x"
 href = "  /s{k} "><a title="<a href=/no>">t</a><a href><a href=''><link href="/no"><a href="/u{k}" href=/v><img src=/no>"""


@query(r"""
WITH p AS (SELECT page_id, ['/a' || page_id, '/f' || page_id || '?x=1&y=2', '/s' || page_id, '/u' || page_id, '/v'] || regexp_extract_all(coalesce(html, ''), '<a href="([^"]+)"', 1) AS own FROM pages),
e AS (SELECT page_id, own || CASE WHEN page_id % 50 = 0 THEN ['/r' for x in range(5000)] ELSE [] END AS l FROM p)
SELECT page_id, least(5000, len(l)) AS n_links, len(l) > 5000 AS more, sha256(array_to_string(l[:5000], chr(10))) AS links_sha256 FROM e""")
def a17_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages link to, in every form; comments, scripts and other elements are passed over, and a page with too many says so."""
    k = F.col("page_id")
    many = F.when(k % 50 == 0, F.repeat(F.lit("<a href=/r>"), F.lit(5000))).otherwise("")
    html = F.concat(F.replace(F.lit(FORMS), F.lit("{k}"), k.cast("string")), F.coalesce("html", F.lit("")), many)
    found = table(spark, sf_dir, "pages").select("page_id", markup.links(html).alias("x"))
    return found.select("page_id", F.size("x.links").alias("n_links"), F.col("x.more").alias("more"), F.sha2(F.array_join("x.links", "\n"), 256).alias("links_sha256"))


@query("""
WITH RECURSIVE r AS (SELECT DISTINCT page_id AS k, CASE WHEN page_id % 23 = 0 THEN 'end' WHEN page_id % 37 = 0 THEN 'no location' WHEN page_id % 41 = 0 THEN 'location' WHEN page_id % 29 = 0 THEN 'go' WHEN page_id % 31 = 0 THEN 'downgrade' ELSE 'go' END AS e,
  CASE WHEN page_id % 29 = 0 THEN page_id - 3 ELSE page_id + 1 END AS t FROM pages WHERE page_id IS NOT NULL),
w AS (SELECT k AS start, k AS cur, [k] AS hist, 0 AS n FROM r UNION ALL SELECT start, t, list_append(hist, t), n + 1 FROM w JOIN r ON r.k = w.cur WHERE e = 'go' AND n < 20 AND NOT list_contains(hist, t)),
l AS (SELECT start, max(n) AS n, arg_max(cur, n) AS cur, arg_max(hist, n) AS hist FROM w GROUP BY 1)
SELECT start AS page_id, 'https://h.example/' || cur AS final_url, n AS n_hops, CASE WHEN r.k IS NULL THEN 'no response' WHEN e = 'end' THEN NULL WHEN e = 'no location' THEN e WHEN n >= 20 THEN 'hops' WHEN e = 'location' THEN e WHEN e = 'go' THEN 'loop' ELSE 'downgrade' END AS reason FROM l LEFT JOIN r ON r.k = l.cur""")
def n10_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page followed through a table of responses, up to 20 hops, to where its chain ends and why."""
    k = F.col("page_id")
    own = table(spark, sf_dir, "pages").select("page_id").filter("page_id IS NOT NULL").distinct().withColumn("url", F.concat(F.lit("https://h.example/"), k))
    location = F.when(k % 37 == 0, " ").when(k % 41 == 0, "ftp://x/").when(k % 29 == 0, F.concat(F.lit("/"), k - 3)).when(k % 31 == 0, F.concat(F.lit("http://h.example/"), k + 1)).otherwise((k + 1).cast("string"))
    responses = own.select("url", F.when(k % 23 == 0, 200).when(k % 2 == 0, 302).otherwise(308).alias("status"), location.alias("location"))
    return frontier.redirect_chains(own, responses, 20).drop("url")


LINE_ID = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query(f"""
WITH i AS (SELECT DISTINCT {LINE_ID} AS id, l_orderkey AS f, l_linenumber % 4 AS n, l_partkey AS p, l_suppkey AS s, l_tax > 0.01 AS cited FROM lineitem), r AS (SELECT DISTINCT {LINE_ID} AS id FROM lineitem WHERE l_returnflag = 'R'),
l AS (SELECT DISTINCT id, f, n, p, s FROM i WHERE cited),
d AS (SELECT s_suppkey AS s, s_nationkey > 3 AS known, s_acctbal >= 0 AS placed, s_suppkey % 6 > 0 AS sound FROM supplier),
v AS (SELECT * FROM l WHERE n = 2 AND p % 7 > 0),
facts AS (SELECT f, id, s FROM l WHERE n = 1 OR (n = 3 AND p % 10 > 0) UNION ALL SELECT f, id, s FROM v WHERE p % 5 > 0),
rules AS (SELECT f, id, p, s FROM l WHERE n = 0 UNION ALL SELECT f, id, p, s FROM v WHERE p % 5 > 0 AND p % 3 = 0),
b AS (SELECT o_orderkey AS f, 'no evidence' AS k FROM orders WHERE o_orderkey NOT IN (SELECT f FROM l)
  UNION ALL SELECT f, 'cites nothing' FROM l WHERE n = 3 AND p % 10 = 0 GROUP BY 1
  UNION ALL SELECT f, 'missing derived value' FROM l WHERE n = 2 AND p % 7 = 0
  UNION ALL SELECT f, 'no inputs' FROM v WHERE p % 5 = 0
  UNION ALL SELECT f, CASE WHEN s % 11 = 0 THEN 'missing fact' WHEN id IN (SELECT id FROM r) THEN 'retracted fact' WHEN NOT coalesce(known, false) THEN 'no document' WHEN NOT placed THEN 'no provenance' WHEN NOT sound THEN 'no artifact' END FROM facts LEFT JOIN d USING (s)
  UNION ALL SELECT f, CASE WHEN p % 13 = 0 THEN 'missing provision' WHEN NOT coalesce(known, false) THEN 'no document' WHEN NOT sound THEN 'no artifact' END FROM rules LEFT JOIN d USING (s))
SELECT f AS finding_id, k AS break_kind, f % 4 > 0 AS fatal, count(*) AS n FROM b WHERE k IS NOT NULL AND f IN (SELECT o_orderkey FROM orders) GROUP BY ALL""")
def c18_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings through links, derived values, inputs, facts and provisions to documents, their origins and their bytes; each break once."""
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).withColumn("n", F.col("l_linenumber") % 4)
    outcome = F.when(F.col("o_orderkey") % 4 == 0, "inconclusive").when(F.col("o_orderkey") % 4 == 1, "pass").when(F.col("o_orderkey") % 4 == 2, "fail").otherwise("review")
    judged = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), outcome.alias("outcome"))
    when = lambda condition, name: F.when(F.expr(condition), F.col("id")).alias(name)
    links = lines.filter("l_tax > 0.01").select(F.col("l_orderkey").alias("finding_id"), when("n = 1 OR (n = 3 AND l_partkey % 10 > 0)", "fact_id"), when("n = 2", "derived_fact_id"), when("n = 0", "provision_id"))
    derived = lines.filter("n = 2 AND l_partkey % 7 > 0").select(F.col("id").alias("derived_fact_id"))
    used = lines.filter("n = 2 AND l_partkey % 5 > 0")
    inputs = used.select(F.col("id").alias("derived_fact_id"), F.col("id").alias("fact_id"), F.lit(None).cast("string").alias("provision_id"))
    inputs = inputs.unionByName(used.filter("l_partkey % 3 = 0").select(F.col("id").alias("derived_fact_id"), F.lit(None).cast("string").alias("fact_id"), F.col("id").alias("provision_id")))
    facts = lines.filter("l_suppkey % 11 > 0").select(F.col("id").alias("fact_id"), F.col("l_suppkey").alias("document_id"), (F.col("l_returnflag") == "R").alias("retracted"))
    provisions = lines.filter("l_partkey % 13 > 0").select(F.col("id").alias("provision_id"), F.col("l_suppkey").alias("document_id"))
    of = lambda condition: table(spark, sf_dir, "supplier").filter(condition).select(F.col("s_suppkey").alias("document_id"))
    broken = findings.trail_breaks(judged, links, derived, inputs, facts, provisions, of("s_nationkey > 3"), of("s_acctbal >= 0"), of("s_suppkey % 6 > 0"))
    return broken.groupBy("finding_id", "break_kind", "fatal").agg(F.count(F.lit(1)).alias("n"))


RATES = ("1/2%", "one and one-half percent", "some percent")


def schedule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page, text): a manual for each customer: who issued it, a schedule of rates in most, and another one that counts where the first says nothing."""
    k = F.col("c_custkey")
    high = F.concat(F.lit("Rs. "), k % 10 + 10, F.lit(" lakh"))
    rate = F.when(k % 3 == 0, RATES[0]).when(k % 3 == 1, RATES[1]).otherwise(RATES[2])
    issuer = F.when(k % 5 > 0, "Issued by the  National Highway\nAuthority of India").otherwise("Issued by the town")
    first = F.concat(
        F.lit("See 3.2. 4.14."), k % 9, F.lit(" The  bid\nsecurity shall be taken at the following rates:\n(a) two percent of the estimated cost for works up to "), high, F.lit(" subject to a maximum of Rs. 3 lakh or Rs. 9\n(B) "),
        rate, F.lit(" of the estimated cost (as sanctioned) between Rs. 50 lakh and "), high, F.lit("; (c) 0.25% of the estimated cost above Rs. 50 lakh (d) 1% of the contract price above Rs. 1 (e) 2% of the estimated cost"),
    )
    second = F.lit("4.15.1 Bid security at the following rates : (a) 9 per cent of the estimated cost not exceeding Rs. 70 lakh (b) 8% of the estimated cost below INR 60,00,000")
    page = lambda n, text: F.struct(F.lit(n).alias("page"), text.alias("text"))
    pages = F.array(page(1, issuer), page(2, F.when(k % 7 > 0, first)), page(3, second))
    return table(spark, sf_dir, "customer").select(k.alias("document_id"), F.explode(pages).alias("p")).select("document_id", "p.*")


RATES_SQL = """
k AS (SELECT DISTINCT c_custkey AS k, '4.14.' || c_custkey % 9 AS c, 100000 * (10 + c_custkey % 10) AS h, [0.005, 0.015, NULL][1 + c_custkey % 3] AS b,
  'See 3.2. 4.14.' || c_custkey % 9 || ' The bid security shall be taken at the following rates:' AS head, ' (a) two percent of the estimated cost for works up to Rs. ' || 10 + c_custkey % 10 || ' lakh subject to a maximum of Rs. 3 lakh or Rs. 9' AS ta,
  ' (B) ' || ['1/2%', 'one and one-half percent', 'some percent'][1 + c_custkey % 3] || ' of the estimated cost (as sanctioned) between Rs. 50 lakh and Rs. ' || 10 + c_custkey % 10 || ' lakh;' AS tb, ' (c) 0.25% of the estimated cost above Rs. 50 lakh' AS tc FROM customer WHERE c_custkey % 5 > 0),
p AS (SELECT k, c || '(a)' AS clause, 0.02 AS share, NULL AS low, h AS high, 300000 AS cap, len(head) + 1 AS span_start, len(ta) - 1 AS n FROM k WHERE k % 7 > 0
  UNION ALL SELECT k, c || '(b)', b, h, 5000000, NULL, len(head || ta) + 1, len(tb) - 1 FROM k WHERE k % 7 > 0 AND b IS NOT NULL
  UNION ALL SELECT k, c || '(c)', 0.0025, 5000000, NULL, NULL, len(head || ta || tb) + 1, len(tc) - 1 FROM k WHERE k % 7 > 0
  UNION ALL SELECT k, '4.15.1(a)', 0.09, 7000000, NULL, NULL, len('4.15.1 Bid security at the following rates : '), len('(a) 9 per cent of the estimated cost not exceeding Rs. 70 lakh') FROM k WHERE k % 7 = 0
  UNION ALL SELECT k, '4.15.1(b)', 0.08, NULL, 6000000, NULL, len('4.15.1 Bid security at the following rates : (a) 9 per cent of the estimated cost not exceeding Rs. 70 lakh '), len('(b) 8% of the estimated cost below INR 60,00,000') FROM k WHERE k % 7 = 0)"""


@query(f"""
WITH {RATES_SQL} SELECT k AS document_id, CASE WHEN k % 7 > 0 THEN 2 ELSE 3 END AS page, clause, 'nhai' AS authority, CAST(share AS DOUBLE) AS share, CAST(low AS DOUBLE) AS applies_from, CAST(high AS DOUBLE) AS applies_to_max, CAST(cap AS DOUBLE) AS cap_amount, span_start, span_start + n AS span_end FROM p""")
def i19_rate_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of rates in manuals as bands, under the authority that issued them, with the place of each in its page."""
    found = extract.rate_schedules(schedule_pages(spark, sf_dir)).distinct()
    number = lambda c: F.col(c).cast("double").alias(c)
    return found.select("document_id", "page", "clause", "authority", *map(number, ("share", "applies_from", "applies_to_max", "cap_amount")), "span_start", "span_end")


@query(f"""
WITH {RATES_SQL}, o AS (SELECT o_orderkey, o_custkey AS k, CAST(o_totalprice AS DECIMAL(20,2)) * 30 AS cost FROM orders),
j AS (SELECT o_orderkey, cost, clause, share, cap FROM o LEFT JOIN p ON o.k = p.k AND (low IS NULL OR cost >= low) AND (high IS NULL OR cost <= high)),
n AS (SELECT o_orderkey, count(clause) AS n, min(clause) AS clause, min(cost) AS cost, min(share) AS share, min(cap) AS cap FROM j GROUP BY 1)
SELECT o_orderkey, n AS n_bands, CASE WHEN n = 1 THEN clause END AS band, CASE n WHEN 0 THEN 'no provision' WHEN 1 THEN 'applicable' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 1 THEN CAST(least(cost * CAST(share AS DECIMAL(12,8)), coalesce(cap, cost)) AS DOUBLE) END AS required FROM n""")
def c07_schedule_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that governs each order's cost by its customer's manual, and the security that it asks for."""
    rules = extract.rate_schedules(schedule_pages(spark, sf_dir)).distinct().select("document_id", "clause", "share", "applies_from", "applies_to_max", "cap_amount")
    rules = shared.written(rules, "rules")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"), (money("o_totalprice") * 30).alias("cost"))
    chosen = bands.applicable(orders, ["o_orderkey", "document_id", "cost"], "cost", rules, "applies_from", "applies_to_max", "clause", ["document_id"])
    governing = chosen.join(rules.withColumnRenamed("clause", "band").hint("merge"), ["document_id", "band"], "left")
    asked = F.least(F.col("cost") * F.col("share"), F.coalesce("cap_amount", "cost"))
    return governing.select("o_orderkey", "n_bands", "band", "verdict", F.when(F.col("band").isNotNull(), asked).cast("double").alias("required"))


#: An address of each kind, with {k} for a number of the row's own below 250.
ADDRESSES = {
    "::ffff:8.8.{k}.8": "ipv4_mapped", "64:ff9b::8.8.8.{k}": "embedded_ipv4", "2002:{k}::1": "embedded_ipv4", "0.0.0.0": "unspecified", "::": "unspecified", "127.{k}.0.1": "loopback", "0:0:0:0:0:0:0:1": "loopback", "169.254.{k}.7": "link_local",
    "FE80::{k}%eth0": "link_local", "224.{k}.0.1": "multicast", "ff02::{k}": "multicast", "100.64.{k}.1": "carrier_grade_nat", "203.0.113.{k}": "documentation", "2001:DB8::{k}": "documentation", "240.0.0.{k}": "reserved", "100::{k}": "reserved",
    "172.16.{k}.1": "private", "fd00::{k}": "private", "192.0.0.9": None, "8.8.{k}.8": None, "2606:4700::{k}": None, "8.8.8.{k}.": "malformed", "1::{k}::1": "malformed", "300.1.1.{k}": "malformed", "08.8.8.{k}": "malformed", "": "malformed",
}


@query(f"""
WITH r(i, refused) AS (VALUES {", ".join(f"({i}, {'NULL' if why is None else repr(why)})" for i, why in enumerate(ADDRESSES.values()))})
SELECT event_id, refused FROM events JOIN r ON i = event_id % {len(ADDRESSES)}""")
def h37_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of every kind, and what is no address, with the reason against them; expressions only."""
    k = F.col("event_id")
    forms = F.array(*map(F.lit, ADDRESSES))
    form = F.get(forms, (k % len(ADDRESSES)).cast("int"))
    return table(spark, sf_dir, "events").filter("event_id IS NOT NULL").select("event_id", addresses.refused(F.replace(form, F.lit("{k}"), (k % 250).cast("string"))).alias("refused"))
