"""Job counters, links of pages, chains of redirects, and findings followed to their bytes."""

import datetime
import random

from pyspark.sql import functions as F

from lapidary.functions import markup
from lapidary.operators import extract, findings, frontier
from lapidary.streaming import jobs


def test_targets():
    for html, found in (
        (None, []), ("", []), ("<a", []), ("<a href='x'", []), ("<A HREF=x>", ["x"]), ("<a href=a href=b>", ["a", "b"]), ("<a href='?a=1&amp;b=2'>", ["?a=1&b=2"]), ("<a href='\n x '>", ["x"]),
        ("<iframe href=no src=yes>", ["yes"]), ("<abbr href=no><link href=no>", []), ("<!-- <a href=no> --><style><a href=no></style><area href=y/>", ["y/"]), ("<a href=1><![bad<a href=2>", ["1"]),
    ):
        assert markup.targets(html)[0] == found, html
    assert markup.targets("<a href=x>" * 3, 3) == (["x"] * 3, False)
    assert markup.targets("<a href=x>" * 4, 3) == (["x"] * 3, True)
    assert markup.targets("<a href=x>" + "<p>" * 200_000)[0] == ["x"]


def walked(url, responses, most):
    """One chain, a hop at a time."""
    seen = [url]
    while True:
        if seen[-1] not in responses:
            return seen[-1], len(seen) - 1, "no response"
        status, location = responses[seen[-1]]
        if status not in (301, 302, 303, 307, 308):
            return seen[-1], len(seen) - 1, None
        target = location if location and location.startswith("http") else None
        why = "no location" if not location else "hops" if len(seen) > most else "location" if not target else "loop" if target in seen else "downgrade" if seen[-1].startswith("https") and target.startswith("http:") else None
        if why:
            return seen[-1], len(seen) - 1, why
        seen.append(target)


def test_chains_as_walked(spark):
    rng = random.Random(5)
    names = [f"{rng.choice(('https', 'https', 'http'))}://h.example/{i}" for i in range(150)]
    responses = {u: (rng.choice((301, 302, 307, 308, 308, 301, 200)) if i % 4 == 0 else 301, names[(i + 1) % 150] if i % 5 else rng.choice([*names, "", None, "ftp://x/", names[0]])) for i, u in enumerate(names)}
    del responses[names[77]]
    rows = [(u, *r) for u, r in responses.items()]
    table = spark.createDataFrame(rows + rows[:9], "url string, status int, location string")
    starts = spark.createDataFrame([(i, u) for i, u in enumerate(names)] + [(200, names[3]), (201, None), (202, "http://nowhere.example/")], "k int, url string")
    for most in (0, 1, 5, 20):
        got = {r.k: (r.final_url, r.n_hops, r.reason) for r in frontier.redirect_chains(starts, table, most).collect()}
        assert got == {i: walked(u, responses, most) for i, u in enumerate(names)} | {200: walked(names[3], responses, most), 201: (None, 0, "location"), 202: ("http://nowhere.example/", 0, "no response")}


def test_chains_of_nothing(spark):
    none = spark.createDataFrame([], "url string, status int, location string")
    assert frontier.redirect_chains(none.select("url"), none).count() == 0
    assert [tuple(r) for r in frontier.redirect_chains(spark.createDataFrame([("http://a.example/",)], "url string"), none).collect()] == [("http://a.example/", "http://a.example/", 0, "no response")]


def test_jobs_go_on(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "run")
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    sent = lambda rows: spark.createDataFrame(rows, jobs.OUTCOME).write.mode("append").parquet(inbox)
    shown = lambda frame: {r[0]: tuple(r[1:6]) for r in frame.collect()}
    sent([])
    assert shown(jobs.resumed(spark, inbox, path)) == {}
    first = [(1, "page", at(0)), (1, "stored", at(5)), (None, "failed", None), (2, "other", at(1)), (3, None, at(1))]
    sent(first)
    assert shown(jobs.resumed(spark, inbox, path)) == {1: (1, 1, 0, 0, 0), None: (0, 0, 0, 1, 0), 2: (0,) * 5, 3: (0,) * 5}
    second = [(1, "page", at(9)), (1, "page", at(2)), (1, "quarantined", at(60)), (2, "duplicate", at(3))]
    sent(second)
    for _ in range(2):
        now = jobs.resumed(spark, inbox, path, 1)
        assert shown(now) == shown(jobs.counted(spark.createDataFrame(first + second, jobs.OUTCOME)))
    why = lambda *limits: {r[0]: r[1] for r in now.select("job_id", jobs.stop_reason(*map(F.lit, limits))).collect()}
    assert why(60, 1, 1) == {1: "time limit", None: "document limit", 2: "document limit", 3: None}
    assert why(61, 3, 3)[1] == "page limit" and why(None, 2, None)[1] == "document limit" and set(why(None, None, None).values()) == {None}


def test_trails(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    judged = made([("pass", "pass"), ("fail", "fail"), ("bare", "review"), ("open", "inconclusive"), ("odd", None), ("good", "pass")], "finding_id string, outcome string")
    links = made(
        [("pass", "f1", None, None), ("pass", "f1", None, None), ("pass", "gone", None, None), ("fail", None, "d1", None), ("fail", None, "d2", None), ("fail", None, "gone", None), ("open", None, None, None), ("odd", "f2", "d2", "p9"), ("good", "f3", None, "p1"), ("other", "gone", None, None)],
        "finding_id string, fact_id string, derived_fact_id string, provision_id string",
    )
    derived = made([("d1",), ("d2",), ("d2",)], "derived_fact_id string")
    inputs = made([("d1", "f2", "p2"), ("d1", "f3", None), ("d1", "f2", None), ("d1", "f5", None), ("d2", None, None)], "derived_fact_id string, fact_id string, provision_id string")
    facts = made([("f1", 1, True), ("f2", 2, False), ("f3", 3, False), ("f5", None, None)], "fact_id string, document_id int, retracted boolean")
    provisions = made([("p1", 2), ("p2", 9)], "provision_id string, document_id int")
    ids = lambda *x: made([(i,) for i in x], "document_id int")
    got = sorted(tuple(r) for r in findings.trail_breaks(judged, links, derived, inputs, facts, provisions, ids(2, 3, 3, None), ids(3), ids(2, 3)).select("finding_id", "break_kind", "trail", "fatal").collect())
    assert got == sorted([
        ("pass", "retracted fact", "fact:f1", True), ("pass", "missing fact", "fact:gone", True), ("fail", "no provenance", "derived:d1>fact:f2>document:2", True), ("fail", "no document", "derived:d1>provision:p2>document:9", True),
        ("fail", "no document", "derived:d1>fact:f5", True), ("fail", "no inputs", "derived:d2", True), ("fail", "missing derived value", "derived:gone", True), ("bare", "no evidence", "", True), ("open", "cites nothing", "", False), ("odd", "missing provision", "provision:p9", False),
    ])
    empty = lambda frame: frame.limit(0)
    assert findings.trail_breaks(*map(empty, (judged, links, derived, inputs, facts, provisions, ids(1), ids(1), ids(1)))).count() == 0


def test_rate_schedules(spark):
    head = "4.1.2 For works, bid security is taken at the following rates: "
    body = {
        "x": "(a) 1% of the estimated cost between Rs. 9 crore and Rs. 2 crore (b) 2% of the estimated cost (c) of the estimated cost above Rs. 1 (d) 3% of the contract above Rs. 1 (e) 1/0% of the estimated cost above Rs. 1 (f) two (2) percent of the estimated cost above Rs. 5 subject to a maximum of Rs. 7 or Rs. 8",
        "town": "(a) 1% of the estimated cost above Rs. 1", "none": None, "empty": "",
    }
    pages = [(d, 2, text and head + text) for d, text in body.items()] + [(d, 1, "NHAI") for d in body if d != "town"] + [("x", 3, head + "(a) 7% of the estimated cost above Rs. 7"), (None, 1, "NHAI"), ("x", 1, None)]
    got = [(r.document_id, r.page, r.clause, float(r.share), *(v and float(v) for v in (r.applies_from, r.applies_to_max, r.cap_amount)), (head + body["x"])[r.span_start : r.span_end][:8]) for r in extract.rate_schedules(spark.createDataFrame(pages, "document_id string, page int, text string")).orderBy("place").collect()]
    assert got == [("x", 2, "4.1.2(a)", 0.01, 2e7, 9e7, None, "(a) 1% o")]
    late = [("y", 1, "NHAI"), ("y", 2, head + "(a) 7% of the fee above Rs. 7"), ("y", 4, head + "(a) 7% of the estimated cost above Rs. 7")]
    assert [r.page for r in extract.rate_schedules(spark.createDataFrame(late, "document_id string, page int, text string")).collect()] == [4]
