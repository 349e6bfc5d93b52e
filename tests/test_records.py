"""Fingerprints, registries, redirects, projects and words, on rows small enough to check by hand."""

import hashlib
import json

from pyspark.sql import functions as F

from lapidary.functions import text as T
from lapidary.operators import frontier, resolve, state
from lapidary.sources import registry


def test_conclusions_equal_canonical_json(spark):
    payload = {"rule": ["r", "1"], "verdict": ["fail", "at most 470", "520 m³"], "detail": {"z": "1", "a": "\"é\"/\n"}, "evidence": [["cost", "fact", "5", None], ["x", "", None, "é"]]}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    text = lambda values: F.array(*(F.lit(v).cast("string") for v in values))
    detail = F.create_map(*(F.lit(x) for pair in payload["detail"].items() for x in pair))
    print_ = state.conclusion_fingerprint([F.lit(x) for x in payload["rule"]], [F.lit(x) for x in payload["verdict"]], detail, F.array(*map(text, payload["evidence"])))
    assert spark.range(1).select(print_.alias("f")).first().f == want


def test_inputs(spark):
    rows = spark.createDataFrame([("d", "measured", "f2", None), ("d", "claimed", "f1", None), ("d", "band", None, "p1")], "k string, role string, fact_id string, provision_id string")
    assert state.inputs_fingerprint(rows, ["k"]).first().fingerprint == hashlib.sha256(b"claimed=f1|measured=f2|provision:band=p1").hexdigest()


def test_registry(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("sources:\n - {id: one, retrieval: http_crawl, base_url: 'https://h/', robots_policy: respect, enabled: true, verification_status: approved, crawler: c, requests_per_minute: 10, min_delay_seconds: 5}\n - {id: two, retrieval: manual_upload, enabled: true}\n")
    (tmp_path / "b.yml").write_text("sources:\n - {id: one, retrieval: http_crawl, base_url: 'http://h/', requests_per_minute: 20, min_delay_seconds: 5}\n")
    (tmp_path / "c.yaml").write_text("no list")
    found = registry.read(spark, f"file://{tmp_path}")
    assert sorted((r.file, r.id or "", r.problem) for r in registry.problems(found, ["other"]).collect()) == [
        ("a.yaml", "one", "enabled with an unknown crawler"), ("a.yaml", "two", "enabled without approval"), ("b.yml", "one", "plain HTTP is not acknowledged"), ("b.yml", "one", "repeats an id of a.yaml"),
        ("b.yml", "one", "requests_per_minute cannot be reached with the delay"), ("b.yml", "one", "robots are not respected"), ("c.yaml", "", "TypeError: no list of sources"),
    ]
    assert [r.id for r in registry.collectable(found).collect()] == ["one"]


def test_redirects_and_delays(spark):
    rows = [(301, "/b", "https://h/a", ["https://h/a"]), (301, "http://h/b", "https://h/a", ["https://h/a"]), (302, "a", "https://h/a", ["https://h/a"]), (303, " ", "https://h/a", []), (301, "/x", "https://h/a", [str(i) for i in range(6)]), (200, "/b", "https://h/a", [])]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, l string, c string, h array<string>")
    found = frame.select("i", frontier.redirect(F.col("s"), F.col("l"), F.col("c"), F.col("h"), F.lit(False)).alias("x")).orderBy("i").collect()
    assert [(r.x.follow, r.x.url or r.x.reason) for r in found] == [(True, "https://h/b"), (False, "downgrade"), (False, "loop"), (False, "no location"), (False, "hops"), (False, "status")]
    limits = spark.createDataFrame([(None,), (1.0,), (7.0,), (90.0,), (301.0,)], "d double").select(frontier.polite_limits(F.lit(30), F.lit(4), F.lit(2.0), F.col("d")).alias("x")).collect()
    assert [tuple(r.x) for r in limits] == [(30, 4, 2.0, False), (30, 4, 2.0, False), (8, 1, 7.0, False), (1, 1, 90.0, False), (1, 1, 301.0, True)]
    lines = spark.createDataFrame([("h", i, x) for i, x in enumerate(["User-agent: *", "Crawl-delay: 9", "User-agent: crawler", "Crawl-delay: 4.5"])], "authority string, line int, text string")
    assert [(r.authority, r.seconds) for r in frontier.crawl_delays(lines, "crawler").collect()] == [("h", 4.5)]


def test_projects(spark):
    facts = spark.createDataFrame([("f1", "a", "project_reference", "x/1"), ("f2", "a", "nit_number", "N/ 1"), ("f3", "b", "nit_number", "n/  1 "), ("f4", "c", "nit_number", "N/ 1"), ("f5", "d", "nit_number", "N/ 1"), ("f6", "e", "other", "N/ 1")], "fact_id string, document_id string, fact_type string, literal string")
    origins = spark.createDataFrame([("a", "s"), ("a", "s"), ("b", "s"), ("c", "t"), ("d", "s"), ("e", "s")], "document_id string, source_id string")
    gone = spark.createDataFrame([("f5",)], "fact_id string")
    got = sorted(tuple(r) for r in resolve.projects(facts, origins, gone).select("document_id", "source_id", "external_ref", "keyed_by", "relationship").collect())
    assert got == [("a", "s", "N/ 1", "nit_number", "same_tender"), ("b", "s", "N/ 1", "nit_number", "same_tender"), ("c", "t", "N/ 1", "nit_number", "same_tender")]
    assert sorted((r.document_id, r.source_id, r.ambiguous) for r in resolve.sole_origin(origins.union(spark.createDataFrame([("b", "t")], origins.schema))).filter("document_id < 'c'").collect()) == [("a", "s", False), ("b", None, True)]


def test_worded_percentages(spark):
    worded = {"two percent": 0.02, "1/2%": 0.005, "0.5 %": 0.005, "two and a half percent": 0.025, "one and one-half per cent": 0.015, "six-and-half percent": 0.065, "some percent": None, "two and a third percent": None, "1/0%": None}
    frame = spark.createDataFrame([(w,) for w in worded], "w string")
    assert {r.w: r.v for r in frame.select("w", T.percent_as_fraction(F.col("w")).cast("double").alias("v")).collect()} == worded
