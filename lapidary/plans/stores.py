"""Workbooks, the content store, uploads, robots files of many hosts and the policy for URLs, over files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions import urls
from lapidary.operators import findings, frontier
from lapidary.plans.tables import FACTS_SQL, facts, registration, retractions, sources, table
from lapidary.sources import shared, store, workbooks
from lapidary.streaming import uploads

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registration(QUERIES, SQL)

BROKEN = b"PK broken"


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, row, col, value, kind): a supplier's parts as a sheet, with a title, a header and a row for each part."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")).agg(F.sum(F.col("l_quantity").cast("decimal(20,2)")).alias("q"))
    numbered = parts.selectExpr("k", "p", "q", "row_number() OVER (PARTITION BY k ORDER BY p) AS n")
    cell = lambda row, col, value, kind: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"), F.lit(kind).alias("kind"))
    n = F.col("n") + 2
    body = numbered.select("k", F.explode(F.array(cell(n, 1, F.concat(F.lit("p<&>"), "p"), "text"), cell(n, 28, F.col("q"), "number"), cell(n, 66, F.lit("far"), "text"))).alias("c"))
    heads = parts.select("k").distinct().select("k", F.explode(F.array(cell(F.lit(1), 1, F.lit("Parts"), "text"), cell(F.lit(2), 3, F.lit("true"), "bool"))).alias("c"))
    return body.unionByName(heads).select("k", "c.*")


ORDER_SHEETS_SQL = """p AS (SELECT l_suppkey AS k, l_partkey AS p, sum(CAST(l_quantity AS DECIMAL(20,2))) AS q FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM p)"""


@query(f"""
WITH {ORDER_SHEETS_SQL}
SELECT k AS document_id, 'number' AS kind, count(*) AS n_cells, CAST(sum(q) AS DOUBLE) AS total, true AS truncated, NULL AS reason FROM n GROUP BY k
UNION ALL SELECT k, 'text', count(*) + 1, NULL, true, NULL FROM n GROUP BY k
UNION ALL SELECT DISTINCT k, 'bool', 1, NULL::DOUBLE, true, NULL FROM n
UNION ALL SELECT s_suppkey, NULL, 1, NULL, false, 'not a workbook' FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM n) OR s_suppkey IS NULL""")
def a15_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks are made, read back from their bytes, and summed by kinds of cells; what is no workbook says so."""
    made = workbooks.made(order_sheets(spark, sf_dir), "k")
    ordered = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    broken = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).join(ordered, "k", "left_anti").withColumn("content", F.lit(BROKEN))
    found = workbooks.cells(shared.written(made.unionByName(broken), "workbooks"), "k")
    value = F.when(F.col("kind") == "number", F.col("value").cast("decimal(20,2)"))
    return found.groupBy(F.col("k").alias("document_id"), "kind").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(value).cast("double").alias("total"), F.bool_or("truncated").alias("truncated"), F.min("reason").alias("reason")
    )


@query(f"""
WITH {ORDER_SHEETS_SQL}, c AS (SELECT k, n + 2 AS row, 1 AS col, 'p<&>' || p AS value FROM n UNION ALL SELECT k, n + 2, 28, CAST(q AS VARCHAR) FROM n UNION ALL SELECT DISTINCT k, 1, 1, 'Parts' FROM n UNION ALL SELECT DISTINCT k, 2, 3, 'true' FROM n),
a AS (SELECT s_suppkey AS k, 1 + s_suppkey % 40 AS spot FROM supplier),
w AS (SELECT k, c.row, c.col, c.value, abs(c.row - a.spot) <= 12 AND c.col <= 26 AS inside FROM c JOIN a USING (k))
SELECT k AS document_id, w.row, col, value, k IN (SELECT k FROM w WHERE NOT inside) AS more FROM w WHERE inside""")
def a16_sheet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells around a row of each sheet, and whether the sheet goes on beyond them."""
    made = shared.written(workbooks.made(order_sheets(spark, sf_dir), "k"), "workbooks")
    around = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 40 + 1).alias("at"))
    return workbooks.window(workbooks.cells(made, "k"), "k", around).withColumnRenamed("k", "document_id")


@query("""
WITH d AS (SELECT DISTINCT html FROM pages WHERE html IS NOT NULL)
SELECT 'raw/crawl/' || substr(sha256(html), 1, 2) || '/' || substr(sha256(html), 3, 2) || '/' || sha256(html) || '.html' AS key, octet_length(encode(html))::BIGINT AS length, sha256(html) AS sha256, true AS sound FROM d WHERE html <> ''""")
def a05_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents are put into a store, again in a second run, and every object is read back and checked."""
    root = shared.new_path(spark, "store")
    html = table(spark, sf_dir, "pages").filter("html <> ''").select(F.col("html").cast("binary").alias("content")).withColumn("sha256", F.sha2("content", 256))
    found = html.select(store.objects.raw_key(F.lit("crawl"), F.col("sha256"), F.lit(".html")).alias("key"), "content")
    store.stored(found, root)
    store.stored(found, root)
    return store.audited(spark, root)


@query("""
WITH u AS (SELECT page_id, html, 0 AS again, CASE WHEN page_id % 3 > 0 THEN 'contract' END AS t, CASE page_id % 10 WHEN 7 THEN 'pdf' ELSE 'html' END AS ext FROM pages UNION ALL SELECT page_id, html, 1, 'bill_of_quantities', 'html' FROM pages WHERE page_id % 4 = 0),
e AS (SELECT sha256(coalesce(html, '')) AS sha256, 2 * page_id + again AS id, t FROM u WHERE coalesce(html, '') <> '')
SELECT sha256, coalesce(arg_max(t, id), 'unclassified') AS document_type, count(*) AS n_events, count(DISTINCT t) AS n_types, min(id) AS first_upload FROM e GROUP BY 1""")
def a10_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of uploads, stopped and started again: one document for each content, whose type a later upload changes."""
    k, inbox = F.col("page_id"), shared.new_path(spark, "inbox")
    pages = table(spark, sf_dir, "pages")

    def sent(rows: DataFrame, again: int, kind, ext) -> None:
        at = F.timestamp_seconds(2 * k + again)
        rows.select(
            (2 * k + again).alias("upload_id"), F.lit("p").alias("project"), F.concat(F.lit("page "), k, F.lit("."), ext).alias("filename"),
            F.coalesce("html", F.lit("")).cast("binary").alias("content"), kind.cast("string").alias("declared_type"), at.alias("uploaded_at"),
        ).write.mode("append").parquet(inbox)

    log, checkpoint = shared.new_path(spark, "events"), shared.new_path(spark, "checkpoint")
    sent(pages, 0, F.when(k % 3 > 0, "contract"), F.when(k % 10 == 7, "pdf").otherwise("html"))
    uploads.ingest(spark, inbox, log, checkpoint)
    sent(pages.filter(k % 4 == 0), 1, F.lit("bill_of_quantities"), F.lit("html"))
    uploads.ingest(spark, inbox, log, checkpoint)
    events = uploads.ingest(spark, inbox, log, checkpoint)  # nothing new: nothing changes
    return uploads.documents(events).drop("key")


#: The robots files that hosts have, by the length of their names.
ROBOTS = {
    0: "User-agent: *\nDisallow: /\nUser-agent: bot\nSitemap: x\nUser-agent: Crawler # us\nDisallow: /en/\nAllow: /en/1*\nDisallow: /*5$\nAllow: /*5\nCrawl-delay: 3\nCrawl-delay: 1",
    1: "User-agent: demo\nDisallow: /fr\nUser-agent: DemoCrawler\nDisallow: /en/9$\nAllow: /en/9\nDisallow: /e\nDisallow: /\nAllow: /de/*?page\nCrawl-delay: 400",
    2: "User-agent: *\nDisallow:\nCrawl-delay: 0\nUser-agent: other\nDisallow: /",
    3: "hello",
}


@query(r"""
WITH p AS (SELECT page_id, len(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))) % 4 AS g, CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE g WHEN 0 THEN regexp_matches(path, '^/en/1') OR NOT regexp_matches(path, '^/en/') WHEN 1 THEN regexp_matches(path, '^/en/9') OR regexp_matches(path, '^/de/.*\?page') ELSE true END AS allowed,
  CASE g WHEN 0 THEN 20 WHEN 1 THEN 1 ELSE 30 END AS per_minute, CASE g WHEN 0 THEN 3.0 WHEN 1 THEN 400.0 ELSE 2.0 END::DOUBLE AS delay, g = 1 AS refused FROM p""")
def h24_robots_of_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robots files of all hosts, the group that holds, each page's decision and each host's limits."""
    agent = "DemoCrawler/1.0 (+x)"
    paths = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("authority"), urls.path_and_query(F.col("url")).alias("path"))
    kind = F.char_length("authority") % 4
    text = F.coalesce(*(F.when(kind == g, F.lit(body)) for g, body in ROBOTS.items()))
    lines = paths.select("authority").distinct().select("authority", F.posexplode(F.split(text, "\n")).alias("line", "text"))
    decided = frontier.robots_decisions(paths, frontier.parsed_robots(lines, agent), "page_id")
    asked = paths.select("page_id", "authority").join(frontier.crawl_delays(lines, agent), "authority", "left")
    x = frontier.polite_limits(F.lit(30), F.lit(4), F.lit(2.0), F.col("seconds"))
    limits = asked.select("page_id", x["per_minute"].alias("per_minute"), x["delay"].alias("delay"), x["refused"].alias("refused"))
    return decided.join(limits, "page_id")


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'http://h.example:443/' || page_id WHEN 2 THEN 'https://xn--mnchen-3ya.example/' || page_id WHEN 3 THEN 'https://h.example/' || page_id WHEN 4 THEN NULL ELSE 'http://h.example/' || page_id END AS canonical FROM pages""")
def h33_url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports other than the web's are refused, other scripts go as Punycode, final dots go."""
    k = F.col("page_id")
    head = F.when(k % 6 == 0, "http://h.example:22/").when(k % 6 == 1, "HTTP://H.example:443/").when(k % 6 == 2, "https://M\u00fcnchen.example:443/").when(k % 6 == 3, "https://h.example./").when(k % 6 == 4, "https://h.example:8443/").otherwise("http://h.example:80/")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.concat(head, k)).alias("canonical"))


@query(f"""
WITH {FACTS_SQL}, m AS (SELECT s_suppkey AS document_id, s_nationkey AS project_id FROM supplier UNION SELECT s_suppkey, s_suppkey % 3 FROM supplier)
SELECT m.project_id AS project_id, fact_id, version_state FROM facts JOIN m USING (document_id) JOIN sources USING (document_id) WHERE fact_id NOT IN (SELECT fact_id FROM retractions)""")
def a02_project_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: what the documents of each project state, withdrawn facts left out, with the state of the document."""
    documents = sources(spark, sf_dir)
    nation = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("document_id"))
    members = nation.unionByName(nation.withColumn("project_id", F.col("document_id") % 3))
    found = findings.project_facts(members, documents, facts(spark, sf_dir), retractions(spark, sf_dir))
    return found.select("project_id", "fact_id", "version_state")
