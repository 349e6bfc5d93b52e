import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from lapidary.functions import net
from lapidary.operators import findings as fd
from lapidary.sources import listings
from lapidary.streaming import windows


def test_names_and_addresses(spark):
    names = {"a/b\\\ufb01le?.pdf": "file_.pdf", "CON.pdf": "CON_file.pdf", "nul": "nul_file", "a b.pdf": "a_b.pdf", "-_x_-": "x", "..": None, "": None, "con.tar.gz": "con.tar.gz"}
    assert {n: net.safe_name(n) for n in names} == names and net.safe_name(None) is None
    assert net.safe_name("x" * 300 + ".pdf") == "x" * 124 + ".pdf" and net.safe_name("y" * 300) == "y" * 128
    reasons = {
        "127.0.0.1": "loopback", "10.1.1.1": "private", "8.8.8.8": None, "0.0.0.0": "unspecified", "x": "malformed", "169.254.1.1": "link_local", "224.0.0.1": "multicast", "100.64.1.1": "carrier_grade_nat",
        "192.0.2.7": "documentation", "2001:db8::1": "documentation", "255.255.255.255": "reserved", "::ffff:8.8.8.8": "ipv4_mapped", "::ffff:10.0.0.1": "ipv4_mapped", "64:ff9b::808:808": "embedded_ipv4", "2002:808:808::1": "embedded_ipv4", "2606:4700::1": None,
    }
    assert {a: net.address_reason(a) for a in reasons} == reasons
    shown = spark.createDataFrame([("C:\\x\\a  b.pdf",), ("\x01..",)], "n string").select(net.shown_name(F.col("n")).alias("s")).collect()
    assert [r.s for r in shown] == ["a b.pdf", "upload"]


def test_headers(spark):
    now = F.lit(datetime.datetime(2025, 1, 1)).cast("timestamp")
    rows = spark.createDataFrame([("120",), ("Wed, 01 Jan 2025 00:01:00 GMT",), ("Tue, 31 Dec 2024 00:00:00 GMT",), ("soon",)], "v string")
    assert [r.s for r in rows.select(net.retry_after_seconds(F.col("v"), now).alias("s")).collect()] == [120, 60, 0, None]
    names = spark.createDataFrame([("attachment; filename=\"a;b.pdf\"",), ("x; filename*=UTF-8''na%C3%AFve.pdf; filename=y",), ("inline",)], "v string")
    assert [r.n for r in names.select(net.disposition_filename(F.col("v")).alias("n")).collect()] == ["a;b.pdf", "naïve.pdf", None]
    assert spark.range(1).select(net.content_length(F.lit("12")).alias("n")).first().n == 12
    with pytest.raises(Exception, match="no content length"):
        spark.range(1).select(net.content_length(F.lit("1x"))).collect()
    ids = spark.createDataFrame([("ab",), ("ab",), (None,)], "d string").select(net.document_id(F.col("d")).alias("i"), net.safe_filename(F.col("d")).alias("n")).collect()
    assert ids[0].i == ids[1].i == str(uuid.uuid5(uuid.UUID("852e666c-780a-5903-85c4-d357129f3878"), "ab")) and ids[2].i is None


def test_listings(spark):
    bodies = [("http://l/1", 0, '{"total_pages": 3, "page": 1, "items": [{"id": "7"}, {"id": "x"}, {"id": "7"}]}'), ("http://l/3", 0, '{"total_pages": 3, "page": 3, "items": []}'), ("http://bad", 0, "[]")]
    pages = spark.createDataFrame(bodies, "url string, depth int, body string")
    got = sorted((r.url, r.kind, r.depth) for r in listings.listing_links(pages, "http://d/", "http://l/").collect())
    assert got == [("http://d/7", "detail", 1), ("http://l/2", "listing", 0)]
    detail = spark.createDataFrame([("http://d/7", 1, '{"id": "7", "files": {"a": "http://x/a.pdf", "b": "http://x/b.exe", "c": "", "d": "http://x/d.png"}}')], "url string, depth int, body string")
    assert {r.field: r.reason for r in listings.detail_documents(detail).collect()} == {"a": None, "b": "no extension", "c": "empty", "d": "format"}


def test_findings(spark):
    links = spark.createDataFrame([("f1", "a", "x1", None, None), ("f1", "b", None, None, "p1"), ("f2", "a", "gone", None, None)], "finding_id string, role string, fact_id string, derived_fact_id string, provision_id string")
    facts = spark.createDataFrame([("x1", "1.50", "d1")], "fact_id string, value string, document_id string")
    derived = spark.createDataFrame([], "derived_fact_id string, value string, document_id string")
    provisions = spark.createDataFrame([("p1", "0.02", "d9")], "provision_id string, value string, document_id string")
    resolved = fd.evidence_resolved(links, facts, derived, provisions)
    documents, origins = (spark.createDataFrame([("d1",), ("d9",)][:n], "document_id string") for n in (2, 1))
    assert {(r.finding_id, r.break_kind) for r in fd.breaks(resolved, documents, origins).collect()} == {("f1", "no provenance"), ("f2", "no fact")}
    rows = spark.createDataFrame([("f1", "r", "pass", "p", None), ("f2", "r", "fail", None, None), ("f3", "r", "review", None, "w"), ("f4", "r", "inconclusive", None, None)], "finding_id string, rule_id string, outcome string, project_id string, work_item_id string")
    assert [r.finding_id for r in fd.untraced(rows, links).collect()] == ["f3"]
    shown = {r.finding_id: json.loads(r.json) for r in fd.serialised(rows, resolved).collect()}
    assert shown["f1"]["scope"] == "project" and [e["value"] for e in shown["f1"]["evidence"]] == ["1.50", "0.02"] and shown["f3"]["evidence"] == []
    shares = spark.createDataFrame([("p", "0.02"), ("p", "0.02"), ("q", "0.02"), ("r", "0.02"), ("r", "0.03")], "project_id string, share string")
    assert {r.project_id: r.outcome for r in fd.share_consistency(shares).collect()} == {"p": "pass", "q": "inconclusive", "r": "fail"}


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    day = datetime.datetime(2025, 1, 1)
    part = lambda *minutes: spark.createDataFrame([(m, day + datetime.timedelta(minutes=m), 1, "view", 1.5) for m in minutes], schema)
    part(1, 2, 61).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run = lambda plan, mode, name: windows.run_available(spark, spark.readStream.schema(part(1).schema).parquet(f"file://{tmp_path}/in"), plan, mode, f"file://{tmp_path}/{name}")
    assert sorted(r.n for r in run(windows.tumbling, "complete", "w").collect()) == [1, 2]
    assert run(windows.once, "append", "o").count() == 3
    part(2, 62).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert sorted(r.n for r in run(windows.tumbling, "complete", "w").collect()) == [2, 3]
    assert run(windows.once, "append", "o").count() == 4
