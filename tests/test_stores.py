"""Workbooks, the content store, uploads, robots files and the policy for URLs."""

import datetime
import hashlib
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lapidary.functions import urls
from lapidary.operators import frontier
from lapidary.sources import store, workbooks
from lapidary.streaming import uploads

CELLS = [(1, 1, "a<&>", "text"), (2, 28, "1.50", "number"), (3, 2, "true", "bool"), (7, 1, "a<&>", "text")]


def read(content):
    return list(workbooks.workbook_cells(content))


def changed(content, name, text):
    """The workbook with one part replaced, or left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for part in old.namelist():
            if part != name:
                new.writestr(part, old.read(part))
            elif text is not None:
                new.writestr(part, text)
    return out.getvalue()


def test_workbook_round_trip_and_faults():
    content = workbooks.workbook_bytes(CELLS)
    assert content == workbooks.workbook_bytes(CELLS[::-1])
    assert read(content) == [(*c, False, None) for c in CELLS]
    assert read(workbooks.workbook_bytes([])) == [(None, None, None, None, False, "empty sheet")]
    for broken, reason in (
        (b"", "not a workbook"), (b"PK\x03\x04", "not a workbook"), (content[:300], "not a workbook"), (changed(content, "xl/workbook.xml", None), "broken workbook"),
        (changed(content, "xl/worksheets/sheet1.xml", "<worksheet><row"), "broken workbook"), (changed(content, "xl/sharedStrings.xml", None), "broken workbook"),
        (changed(content, "xl/workbook.xml", "<workbook/>"), "no sheet"),
    ):
        assert read(broken) == [(None, None, None, None, False, reason)]


def test_sheet_forms_and_limits():
    start = f'<worksheet xmlns="{workbooks.SHEET[1:-1]}"><sheetData>'
    body = '<row r="4"><c><v>1</v></c><c t="str"><f>A4&amp;1</f><v>x</v></c><c t="e"><v>#REF!</v></c><c/><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c></row><row><c r="B5" t="b"><v>0</v></c></row>'
    content = changed(workbooks.workbook_bytes(CELLS), "xl/worksheets/sheet1.xml", start + body + "</sheetData></worksheet>")
    assert [c[:4] for c in read(content)] == [(4, 1, "1", "number"), (4, 2, "x", "text"), (4, 5, "inline", "text"), (5, 2, "false", "bool")]
    long = read(workbooks.workbook_bytes([(r, 1, str(r), "number") for r in range(4998, 5003)]))
    assert [c[0] for c in long] == [4998, 4999, 5000] and all(c[4] for c in long)
    wide = read(workbooks.workbook_bytes([(1, 64, "1", "number"), (1, 65, "2", "number")]))
    assert wide == [(1, 64, "1", "number", True, None)]


def test_workbook_source(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.xlsx").write_bytes(workbooks.workbook_bytes(CELLS))
    (tmp_path / "deep" / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    (tmp_path / "c.txt").write_bytes(b"x")
    workbooks.register(spark)
    found = spark.read.format("workbook").load(str(tmp_path))
    got = sorted((os.path.basename(r.path), r.row or 0, r.col or 0, r.value, r.reason) for r in found.collect())
    assert got == [*(("a.xlsx", r, c, v, None) for r, c, v, _ in CELLS), ("b.xlsx", 0, 0, None, "not a workbook")]
    files = spark.createDataFrame([("x", None), ("y", bytearray(workbooks.workbook_bytes(CELLS[:1])))], "path string, content binary")
    assert sorted((r.path, r.value, r.reason) for r in workbooks.cells(files).collect()) == [("x", None, "not a workbook"), ("y", "a<&>", None)]
    assert workbooks.cells(files.limit(0)).collect() == []


def contents(spark, *bodies):
    rows = [(f"raw/s/{(d := hashlib.sha256(b).hexdigest())[:2]}/{d[2:4]}/{d}.txt", bytearray(b)) for b in bodies]
    return spark.createDataFrame(rows, "key string, content binary").repartition(3)


def test_store_is_written_once(spark, tmp_path):
    root = str(tmp_path / "store")
    store.stored(contents(spark, b"one", b"two", b"two"), root)
    times = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "store").rglob("*.txt"))}
    store.stored(contents(spark, b"two", b"three"), root)
    rows = store.audited(spark, f"file://{root}").collect()
    assert len(rows) == 3 and all(r.sound and r.key.startswith("raw/s/") for r in rows)
    assert {p: os.stat(p).st_mtime_ns for p in times} == times
    assert not list((tmp_path / "store" / store.STAGED).glob("*"))


def test_store_faults(spark, tmp_path):
    root = str(tmp_path / "store")
    found = contents(spark, b"one")
    store.stored(found, root)
    path = next((tmp_path / "store").rglob("*.txt"))
    path.write_bytes(b"ONE")
    assert [(r.sound, r.length) for r in store.audited(spark, f"file://{root}").collect()] == [(False, 3)]
    with pytest.raises(Exception, match="another content is stored"):
        store.stored(found, root)
    assert path.read_bytes() == b"ONE"
    with pytest.raises(Exception, match="does not have the digest"):
        store.stored(found.withColumn("content", F.lit(b"x")), root)
    with pytest.raises(Exception, match="never overwritten"):
        found.write.format("content_store").mode("overwrite").save(root)
    assert not list((tmp_path / "store" / store.STAGED).glob("*"))


def test_a_task_that_runs_twice_changes_nothing(tmp_path):
    final = str(tmp_path / "k" / "x")
    for name, body in (("1", b"a"), ("2", b"a"), ("3", b"b")):
        (tmp_path / name).write_bytes(body)
    assert store.placed(str(tmp_path / "1"), final) and not store.placed(str(tmp_path / "2"), final)
    with pytest.raises(ValueError, match="another content"):
        store.placed(str(tmp_path / "3"), final)


def test_uploads(spark, tmp_path):
    inbox, log, checkpoint = (f"file://{tmp_path}/{x}" for x in ("inbox", "log", "checkpoint"))

    def send(*rows):
        at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)
        spark.createDataFrame([(i, p, f, bytearray(b), t, at(i)) for i, p, f, b, t in rows], uploads.UPLOAD).write.mode("append").parquet(inbox)
        return uploads.ingest(spark, inbox, log, checkpoint)

    send((1, "p", "boq.csv", b"a,b", None), (2, "p", "x.pdf", b"PK\x03\x04", "contract"), (3, None, "y.csv", b"", None))
    events = send((4, "q", "again.csv", b"a,b", "contract"))
    assert uploads.ingest(spark, inbox, log, checkpoint).count() == events.count() == 4
    assert {r.upload_id: r.refused for r in events.collect()} == {1: None, 2: "contradiction", 3: "empty", 4: None}
    assert [(r.document_type, r.n_events, r.n_types, r.first_upload) for r in uploads.documents(events).collect()] == [("contract", 2, 1, 1)]
    assert sorted(r.project for r in uploads.memberships(events).collect()) == ["p", "q"]
    assert [r.document_type for r in uploads.documents(events.filter("upload_id = 1")).collect()] == ["bill_of_quantities"]


ROBOTS = {
    "a": "User-agent: bot\nDisallow: /x\nUser-agent: *\nDisallow: /\nUser-agent: crawler\nDisallow: /a$\nAllow: /a\nDisallow: /b.c\nDisallow: /*.pdf$\nAllow: /open/*/x\nDisallow: /open\nCrawl-delay: nan\nCrawl-delay: 2\nCrawl-delay: 7",
    "b": "﻿User-Agent: other\nSitemap: s\nUser-agent: crawlerbot # us\nDisallow: /s\nUser-agent: wler\nDisallow: /\nUser-agent: CRAWLERBOT\nDisallow: /t",
    "c": "User-agent: crawl\nUser-agent: lerbo\nDisallow: /both\n\nUser-agent: rawle\nDisallow: /third\nCrawl-delay: -1",
    "d": "no directives",
}


def test_robots_of_many_hosts(spark):
    lines = spark.createDataFrame([(h, i, x) for h, text in ROBOTS.items() for i, x in enumerate(text.split("\n"))], "authority string, line int, text string")
    want = [
        ("a", "/a", True), ("a", "/abc", True), ("a", "/x", True), ("a", "/b.c", False), ("a", "/bxc", True), ("a", "/q.pdf", False), ("a", "/q.pdf?", True), ("a", "/open/1", False), ("a", "/open/1/x", True), ("a", "/", True),
        ("b", "/s", False), ("b", "/t", False), ("b", "/u", True), ("c", "/both", False), ("c", "/third", True), ("d", "/", True), ("e", "/", True),
    ]
    paths = spark.createDataFrame([(i, h, p) for i, (h, p, _) in enumerate(want)], "i int, authority string, path string").repartition(3)
    got = {r.i: r.allowed for r in frontier.robots_decisions(paths, frontier.parsed_robots(lines, "CrawlerBot/2 x"), "i").collect()}
    assert [got[i] for i in range(len(want))] == [x for _, _, x in want]
    assert {tuple(r) for r in frontier.crawl_delays(lines, "CrawlerBot/2 x").collect()} == {("a", 7.0)}
    assert frontier.crawl_delays(lines, "else/1").collect() == []
    decided = spark.createDataFrame([("/a",)], "p string").select(frontier.robots_decision(F.col("p"), [(False, "/a$"), (True, "/a")]).alias("ok"))
    assert decided.first().ok


def test_ports_and_hosts(spark):
    want = {
        "http://h.example:22/x": None, "http://h.example:443/": "http://h.example:443/", "https://h.example:443/": "https://h.example/", "http://München.de/x": "http://xn--mnchen-3ya.de/x",
        "https://h.example./a": "https://h.example/a", "http://h.example:08/": None,
    }
    frame = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.c for r in frame.select("u", urls.canonical(F.col("u")).alias("c")).collect()} == want
