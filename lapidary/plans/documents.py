"""Text, link, extraction, queue and stream queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import text as T
from lapidary.functions import urls
from lapidary.operators import frontier, reconcile, resolve, select, state
from lapidary.plans.tables import money, registration, retractions, sources, table
from lapidary.sources import objects, shared
from lapidary.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registration(QUERIES, SQL)


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS even_sha256, length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS even_chars,
       len(regexp_extract_all(text, '(?i)(Rs\.?|INR|₹)[ \t\n\x0B\f\r]*[0-9]')) AS n_marked FROM documents""")
def h09_even_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with even white space, their digests, and how many amounts are marked."""
    even = T.even_spaces(F.col("text"))
    marked = F.size(F.regexp_extract_all("text", F.lit(r"(?i)(Rs\.?|INR|₹)\s*[0-9]"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(even.cast("binary"), 256).alias("even_sha256"), F.char_length(even).cast("long").alias("even_chars"), marked.cast("long").alias("n_marked"))


@query(r"""
SELECT p_partkey, upper(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS project_key, trim(regexp_replace(lower(p_name || '-' || p_type || '.PDF'), '[-_.\s()\[\]]+', ' ', 'g')) AS words,
       CASE WHEN p_name LIKE '%bolt%' THEN 'drawing' END AS type_of_drawing FROM part""")
def h11_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and file-name words, and the type that a name suggests."""
    name = F.concat("p_name", F.lit("-"), "p_type", F.lit(".PDF"))
    suggested = T.file_type(F.concat(F.regexp_replace("p_name", "bolt", "Drawing"), F.lit("_r1.pdf")))
    return table(spark, sf_dir, "part").select("p_partkey", T.project_key(F.col("p_name")).alias("project_key"), T.filename_words(name).alias("words"), suggested["type"].alias("type_of_drawing"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day, hour(ts) AS hour FROM events""")
def h50_json_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON, null where the text is none, and parts of times."""
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("hour"))


CANONICAL_SQL = r"""
CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) IN ('http', 'https') THEN
  lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) ||
  CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#:]+(:[0-9]+)', 1) IN ('', CASE WHEN url LIKE 'https%' THEN ':443' ELSE ':80' END) THEN '' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#:]+(:[0-9]+)', 1) END ||
  CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]*)', 1) END"""


@query(rf"""SELECT page_id, {CANONICAL_SQL} AS canonical, sha256({CANONICAL_SQL}) AS digest, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def h33_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs, their digests, hosts and a query parameter."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.canonical(url).alias("canonical"), F.sha2(urls.canonical(url).cast("binary"), 256).alias("digest"), urls.host(url).alias("host"),
        F.nullif(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), F.lit("")).alias("page"),
    )


@query(r"""
WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''#]*)', 1))) AS link FROM pages),
r AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS base,
  CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN link LIKE '//%' THEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || ':' || link
       WHEN link LIKE '/%' THEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || link WHEN link = '' THEN url
       ELSE lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || regexp_replace(CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END, '[^/]*$', '') || link END AS t FROM l),
k AS (SELECT *, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch, lower(regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS h, lower(regexp_extract(regexp_extract(t, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '\.([^./?#]+)$', 1)) AS ext FROM r)
SELECT page_id, CASE WHEN sch NOT IN ('http', 'https') OR NOT (h = base OR h LIKE '%.' || base) THEN 'ignored' WHEN ext IN ('pdf','xlsx','xls','docx','doc','csv','json','xml','zip','png','jpg','jpeg','tif','tiff') THEN 'document' ELSE 'page' END AS kind,
  CASE WHEN sch NOT IN ('http', 'https') THEN 'scheme' WHEN NOT (h = base OR h LIKE '%.' || base) THEN 'host' END AS reason, count(*) AS n FROM k GROUP BY ALL""")
def i20_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved and classified by the first reason that fails."""
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(urls.hrefs(F.col("html"))).alias("link"))
    target = links.select("page_id", urls.host(F.col("url")).alias("base"), urls.resolved(F.col("url"), F.col("link")).alias("target"))
    kinds = target.select("page_id", urls.link_kind(F.col("target"), F.col("base"), F.lit(1), 5).alias("k"))
    return kinds.groupBy("page_id", "k.kind", "k.reason").agg(F.count(F.lit(1)).alias("n"))


ROBOTS = [(False, "/en/"), (True, "/en/1*"), (False, "/*5$"), (True, "/de")]


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '^/en/1') THEN true WHEN regexp_matches(path, '^/en/') THEN false WHEN regexp_matches(path, '^/de') THEN true WHEN regexp_matches(path, '^/.*5$') THEN false ELSE true END AS allowed FROM p""")
def h25_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest matching pattern decides; of equals one that allows."""
    return table(spark, sf_dir, "pages").select("page_id", frontier.robots_decision(urls.path(F.col("url")), ROBOTS).alias("allowed"))


@query("""
SELECT sha256(html) AS sha256, min(page_id) AS first_page, count(*) AS n_pages, 'raw/crawl/' || substr(sha256(html), 1, 2) || '/' || substr(sha256(html), 3, 2) || '/' || sha256(html) || '.html' AS key FROM pages GROUP BY ALL""")
def a08_content_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by content, with the key under which each is stored once."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    kept = rows.groupBy("sha256").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n_pages"))
    return kept.withColumn("key", objects.raw_key(F.lit("crawl"), F.col("sha256"), F.lit(".html")))


TYPES = ("contracted_quantity", "measured_quantity", "cumulative_claim", "previous_certified", "contract_rate", "claimed_rate")


@query("""
WITH f AS (SELECT l_partkey * 5 + l_orderkey % 5 AS item, CASE (l_linenumber - 1) % 6 WHEN 0 THEN 'contracted' WHEN 1 THEN 'measured' WHEN 2 THEN 'claim' WHEN 3 THEN 'previous' WHEN 4 THEN 'rate' ELSE 'claimed' END AS t,
  l_suppkey AS d, strftime(l_shipdate, '%Y%m%d') AS version, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, floor(l_quantity / 25) AS v, l_returnflag = 'R' AS gone,
  CASE WHEN (l_linenumber - 1) % 6 < 4 AND l_orderkey % 4 > 0 THEN CASE WHEN l_orderkey % 8 < 6 THEN 'm3' ELSE 'MT' END END AS u FROM lineitem),
ok AS (SELECT f.* FROM f JOIN supplier ON d = s_suppkey WHERE s_acctbal >= 0 AND NOT gone),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, t, d ORDER BY version DESC, id) AS n FROM ok) WHERE n = 1),
s AS (SELECT item, t, count(DISTINCT v || '/' || coalesce(u, '')) > 1 AS x, CASE WHEN count(DISTINCT v || '/' || coalesce(u, '')) = 1 THEN min(v) END AS v, CASE WHEN count(DISTINCT v || '/' || coalesce(u, '')) = 1 THEN min(u) END AS u FROM now GROUP BY ALL),
w AS (SELECT i.item, coalesce(bool_or(x) FILTER (t IN ('measured', 'claim')), false) AS xq, coalesce(bool_or(x) FILTER (t IN ('rate', 'claimed')), false) AS xr, coalesce(bool_or(x) FILTER (t IN ('previous', 'claim')), false) AS xp,
  max(v) FILTER (t = 'measured') AS m, max(u) FILTER (t = 'measured') AS um, max(v) FILTER (t = 'claim') AS c, max(u) FILTER (t = 'claim') AS uc, max(v) FILTER (t = 'previous') AS p, max(v) FILTER (t = 'rate') AS r, max(v) FILTER (t = 'claimed') AS cr,
  count(*) FILTER (x) AS nc, count(*) FILTER (NOT x) AS nr FROM (SELECT DISTINCT item FROM f) i LEFT JOIN s ON s.item = i.item GROUP BY i.item),
y AS (SELECT *, CASE WHEN um = uc OR um IS NULL OR uc IS NULL THEN c - m END AS gap FROM w)
SELECT item, 'claim_within_measured_quantity' AS rule_id, CASE WHEN xq THEN 'review' WHEN gap IS NULL THEN 'inconclusive' WHEN gap <= 0 THEN 'pass' ELSE 'review' END AS outcome FROM y
UNION ALL SELECT item, 'claimed_rate_matches_contract_rate', CASE WHEN xr THEN 'review' WHEN cr - r IS NULL THEN 'inconclusive' WHEN cr = r THEN 'pass' ELSE 'review' END FROM y
UNION ALL SELECT item, 'cumulative_claim_not_below_previous_certified', CASE WHEN xp THEN 'review' WHEN c - p IS NULL THEN 'inconclusive' WHEN c >= p THEN 'pass' ELSE 'review' END FROM y
UNION ALL SELECT item, 'work_item_evidence_unambiguous', CASE WHEN nc > 0 THEN 'review' WHEN nr > 0 THEN 'pass' ELSE 'inconclusive' END FROM y""")
def k13_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Select, calculate and judge every work item by every rule, conflicts by the rule's own types."""
    kinds, place = F.array(*map(F.lit, TYPES)), F.pmod(F.col("l_linenumber") - 1, F.lit(6))
    unit = F.when((place < 4) & (F.col("l_orderkey") % 4 > 0), F.when(F.col("l_orderkey") % 8 < 6, "m3").otherwise("MT"))
    facts = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("fact_id"), (F.col("l_partkey") * 5 + F.col("l_orderkey") % 5).alias("item"),
        F.col("l_suppkey").alias("document_id"), F.lit(1).alias("sheet_row"), F.date_format("l_shipdate", "yyyyMMdd").alias("extractor_version"),
        F.get(kinds, place).alias("fact_type"), F.floor(F.col("l_quantity") / 25).cast("decimal(20,2)").alias("numeric_value"),
        unit.alias("unit"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("literal"),
    )
    selected = select.select_facts(facts, sources(spark, sf_dir), retractions(spark, sf_dir), ["item"])
    return reconcile.findings(reconcile.wide(selected, ["item"]), ["item"])


QUEUE_SQL = """queue AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'failed' WHEN 'view' THEN 'discovered' WHEN 'error' THEN 'failed' ELSE 'stored' END AS state,
  event_id % 6 AS attempts, event_id % 4 AS depth, ts AS discovered_at, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 15 MINUTE END AS lease_expires_at,
  CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 1 HOUR END AS next_attempt_after, CASE WHEN event_id % 11 = 0 THEN ts END AS dead_lettered_at FROM events)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a work queue."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        k.alias("id"), F.when(F.col("event_type").isin("click", "error"), "failed").when(F.col("event_type") == "view", "discovered").otherwise("stored").alias("state"),
        (k % 6).alias("attempts"), (k % 4).alias("depth"), ts.alias("discovered_at"), F.when(k % 7 == 0, ts + F.expr("INTERVAL 15 MINUTES")).alias("lease_expires_at"),
        F.when(k % 5 == 0, ts + F.expr("INTERVAL 1 HOUR")).alias("next_attempt_after"), F.when(k % 11 == 0, ts).alias("dead_lettered_at"),
    )


@query(f"""
WITH {QUEUE_SQL}, n AS (SELECT TIMESTAMP '2024-01-15 00:00:00' AS now)
SELECT state, depth, count(*) AS n FROM queue, n WHERE state IN ('discovered', 'failed') AND dead_lettered_at IS NULL AND attempts < 5 AND (lease_expires_at IS NULL OR lease_expires_at <= now) AND (next_attempt_after IS NULL OR next_attempt_after <= now) GROUP BY ALL""")
def b03_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the queue may be claimed now."""
    rows = queue(spark, sf_dir).filter(frontier.claimable(F.lit("2024-01-15 00:00:00").cast("timestamp")))
    return rows.groupBy("state", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {QUEUE_SQL}, n AS (SELECT TIMESTAMP '2024-01-15 00:00:00' AS now), x AS (SELECT *, lease_expires_at IS NOT NULL AND lease_expires_at <= now AS expired FROM queue, n),
y AS (SELECT id, attempts + CASE WHEN expired THEN 1 ELSE 0 END AS attempts, CASE WHEN expired THEN 'failed' ELSE state END AS state, dead_lettered_at FROM x)
SELECT id, attempts, state, dead_lettered_at IS NOT NULL OR (state = 'failed' AND attempts >= 5) AS given_up, CAST(least(21600, 300 * 2 ** greatest(0, attempts - 1)) AS BIGINT) AS wait_seconds FROM y""")
def n04_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired leases cost an attempt, and rows with too many are given up."""
    rows = frontier.recovered(queue(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return rows.select("id", "attempts", "state", F.col("dead_lettered_at").isNotNull().alias("given_up"), frontier.backoff_seconds(F.col("attempts")).alias("wait_seconds"))


@query("""
WITH s AS (SELECT 100 + CAST(event_id % 500 AS INT) AS status FROM events)
SELECT CASE WHEN status IN (408, 425, 429) OR status BETWEEN 500 AND 599 THEN 'retry' WHEN status BETWEEN 300 AND 399 THEN 'redirect' WHEN status BETWEEN 400 AND 499 THEN 'give up' ELSE 'done' END AS class,
       CASE WHEN status = 429 OR status >= 500 THEN 'deny' WHEN status >= 400 THEN 'allow' ELSE 'parse' END AS robots, count(*) AS n FROM s GROUP BY ALL""")
def n08_retry_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What response statuses mean for another try, and for robots.txt."""
    status = (F.lit(100) + F.col("event_id") % 500).cast("int")
    rows = table(spark, sf_dir, "events").select(frontier.retry_class(status).alias("class"), frontier.robots_access(status).alias("robots"))
    return rows.groupBy("class", "robots").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, max(l_shipdate) FILTER (l_returnflag <> 'N') AS old, max(l_shipdate) FILTER (l_returnflag = 'N') AS new FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CAST(coalesce(new, old) AS DATE) AS day FROM k""")
def m02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: an incoming row replaces the known one with its key, the last of them winning (without a store: `m02_facts_store` keeps one)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    rows = state.upserted(lines.filter("l_returnflag <> 'N'"), lines.filter("l_returnflag = 'N'"), ["l_orderkey", "l_linenumber"], F.col("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))


STATES = ("discovered", "downloading", "downloaded", "validated", "processing", "processed", "failed", "quarantined")
STEPS_SQL = f"""
legal(a, b) AS (VALUES ('discovered','downloading'),('discovered','failed'),('downloading','downloaded'),('downloading','failed'),('downloading','quarantined'),('downloaded','validated'),('downloaded','failed'),('downloaded','quarantined'),('validated','processing'),('validated','failed'),('processing','processed'),('processing','failed'),('processing','quarantined'),('failed','downloading'),('failed','processing')),
e AS (SELECT user_id, ts, event_id, {list(STATES)}[1 + (event_id * event_id + user_id) % 8] AS state FROM events),
s AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e),
x AS (SELECT s.*, legal.a IS NOT NULL AS ok FROM s LEFT JOIN legal ON before = a AND state = b WHERE before IS NOT NULL)"""


@query(f"WITH {STEPS_SQL} SELECT before, state, count(*) AS n FROM x WHERE NOT ok GROUP BY ALL")
def m12_illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state that the state machine does not have."""
    rows = steps(spark, sf_dir)
    return rows.filter(~state.allowed_transition(F.col("before"), F.col("state"))).groupBy("before", "state").agg(F.count(F.lit(1)).alias("n"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the states that documents are in one after the other."""
    now = F.get(F.array(*map(F.lit, STATES)), ((F.col("event_id") * F.col("event_id") + F.col("user_id")) % 8).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", now.alias("state"))
    return rows.withColumn("before", F.lag("state").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("before IS NOT NULL")


@query(f"""
WITH {STEPS_SQL}, y AS (SELECT before, state, CASE WHEN before = state OR before = 'processed' THEN before WHEN ok OR (before = 'downloaded' AND state = 'processing') THEN state END AS advanced,
  CASE WHEN EXISTS (SELECT 1 FROM legal WHERE a = before AND b = 'failed') THEN 'failed' ELSE before END AS after_failure FROM x)
SELECT before, state, advanced, after_failure, count(*) AS n FROM y GROUP BY ALL""")
def m13_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An advance that is satisfied already stays, downloaded goes through validated, and a failure is recorded only where that is legal."""
    rows = steps(spark, sf_dir).select("before", "state", state.advanced(F.col("before"), F.col("state")).alias("advanced"), state.after_failure(F.col("before")).alias("after_failure"))
    return rows.groupBy("before", "state", "advanced", "after_failure").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def n05_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the events, with checkpointed state, until all that is there has been read."""
    # a pattern, as a stream's path is else taken for a folder
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    out = windows.run_available(spark, source, windows.tumbling, "complete", shared.new_path(spark, "windows"))
    return out.select(F.unix_micros("window_start").alias("window_us"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS session_us, count(*) AS n FROM s GROUP BY user_id, k""")
def n06_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by gaps, in one aggregation."""
    found = windows.sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.unix_micros("session_start").alias("session_us"), "n")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def d12_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tallies over every combination of two dimensions."""
    cube = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("amount"))


@query("""
WITH f AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus AS outcome, o_orderdate FROM orders), r AS (SELECT o_custkey AS id, max(o_orderkey) AS m, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS finding_id, coalesce(n, 0) AS n_current, CASE WHEN r.id IS NOT NULL THEN 'noted ' || m END AS decision, c_acctbal < 0 AND r.id IS NULL AS reviewable
FROM customer LEFT JOIN (SELECT o_custkey AS id, max(o_orderkey) AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r ON c_custkey = r.id""")
def e05_current_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest review of a conclusion as it stands; reviews of older ones are stale."""

    def conclusion(key: str, seen: Column) -> Column:
        nothing = F.lit(None).cast("map<string,string>")
        return state.conclusion_fingerprint([F.lit("r"), F.lit("1")], [F.col(key), seen], nothing, F.array(F.array(seen)))

    outcome = F.when(F.col("c_acctbal") < 0, "review").otherwise("pass")
    findings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("finding_id"), outcome.alias("outcome"), F.lit("1").alias("rule_version"))
    findings = findings.withColumn("fingerprint", conclusion("finding_id", F.lit("F")))
    reviews = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("finding_id"), F.concat(F.lit("noted "), "o_orderkey").alias("decision"), F.lit("x").alias("reviewer"),
        F.col("o_orderkey").alias("reviewed_at"), conclusion("o_custkey", F.col("o_orderstatus")).alias("reviewed_fingerprint"), F.lit("1").alias("reviewed_rule_version"),
    )
    reviews = reviews.join(findings.select("finding_id", F.col("outcome").alias("reviewed_outcome")), "finding_id")
    return state.current_reviews(findings, reviews).select("finding_id", "n_current", "decision", "reviewable")


@query("""
SELECT o_custkey, sha256(o_custkey || '|' || min(o_orderpriority)) AS project_id, count(*) AS n FROM orders GROUP BY o_custkey""")
def l01_project_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: projects get the same id in every run."""
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("n"))
    return grouped.select("o_custkey", resolve.key_id(F.col("o_custkey").cast("string"), F.col("p")).alias("project_id"), "n")
