"""What must not depend on how large the tables are."""

import hashlib
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapidary.functions import markup
from lapidary.operators import bands, extract
from lapidary.plans import shapes, stores
from lapidary.sources import store, workbooks


def sent_by_document(frame):
    """The joins on documents whose one side is sent to all tasks."""
    return re.findall(r"BroadcastHashJoin \[[^\]]*document_id.*", frame._jdf.queryExecution().toString())


def test_rates_of_documents_are_not_broadcast(spark, tmp_path):
    head = "4.14.1 The bid security shall be taken at the following rates:"
    text = [(d, p, "National Highways Authority of India" if p == 1 else f"{head} (a) 2% of the estimated cost up to Rs. {d} lakh (b) 1% of the estimated cost above Rs. {d} lakh") for d in range(1, 9) for p in (1, 2)]
    spark.createDataFrame(text, "document_id long, page int, text string").write.parquet(str(tmp_path / "pages"))
    rules = extract.rate_schedules(spark.read.parquet(str(tmp_path / "pages")))
    assert rules.count() == 16 and not sent_by_document(rules)
    costs = spark.createDataFrame([(i, i % 8 + 1, 100_000 * (i % 8) + 50_000 * (i % 5)) for i in range(80)], "id long, document_id long, cost long")
    key = ["id", "document_id", "cost"]
    few = bands.band_join(costs, "cost", rules, "applies_from", "applies_to_max", ["document_id"])
    many = bands.band_join(costs, "cost", rules, "applies_from", "applies_to_max", ["document_id"], sent=0)
    assert not sent_by_document(many)
    shown = lambda x: sorted(map(tuple, x.select(*key, "clause").collect()), key=str)
    assert shown(many) == shown(few)


def test_sheets_are_not_broadcast(spark, tmp_path):
    cells = [(d, r, c, v) for d in range(1, 9) for r, c, v in [(1, 1, f"Project Ref: P-{d}"), (2, 1, "Item No"), (2, 2, "Quantity"), (3, 1, "1.1"), (3, 2, str(d)), (4, 1, "Total"), (4, 2, "9")]]
    spark.createDataFrame(cells, "document_id long, row int, col int, value string").write.parquet(str(tmp_path / "cells"))
    sheet = spark.read.parquet(str(tmp_path / "cells"))
    aliases = spark.createDataFrame([("item no", "item"), ("quantity", "quantity")], "label string, field string")
    rows = extract.sheet_rows(sheet, extract.sheet_header(sheet, aliases))
    assert sorted((r.document_id, r.row, int(r.quantity_value)) for r in rows.collect()) == [(d, 3, d) for d in range(1, 9)]
    assert not sent_by_document(rows)


def test_far_from_an_estimate_is_exact(spark, tmp_path):
    """A difference of hardly more than one percent, of exactly one percent where doubles say more, and estimates of nothing."""
    cases = [(1_000_000.00, 1_010_000.40), (1_000_000.00, 989_999.60), (1_000_000.00, 1_010_000.00), (100.00, 101.01), (110.00, 111.10), (7.00, 7.07), (0.00, 5.00), (-10.00, 5.00)]
    spark.createDataFrame([(i, e) for i, (e, _) in enumerate(cases)], "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "l_orderkey long, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, shapes.k04_against_estimate(spark, str(tmp_path)).collect()))
    assert [r[3] for r in got] == [True, True, False, True, False, False, None, None]
    with duckdb.connect() as duck:
        for name in ("orders", "lineitem"):
            duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert sorted(duck.execute(shapes.SQL["k04_against_estimate"]).fetchall()) == got


def test_workbooks_are_made_and_read_one_at_a_time(spark):
    """Neither a task's workbooks nor their cells are held at once: both are steps over rows, and sheets are read once."""
    rows = spark.range(3000).selectExpr("id % 60 AS k", "CAST(id DIV 60 + 1 AS int) AS row", "1 AS col", "CAST(id AS string) AS value", "'number' AS kind")
    books = workbooks.made(rows, "k")
    found = workbooks.cells(books, "k")
    assert found.count() == 3000 and found.filter("reason IS NOT NULL OR truncated").isEmpty()
    around = spark.range(60).selectExpr("id AS k", "CAST(id AS int) AS at")
    near = workbooks.window(found, "k", around)
    assert near.count() == sum(1 for k in range(60) for row in range(1, 51) if abs(row - k) <= 12) and near.filter("NOT more").isEmpty()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan


def test_a_workbook_is_made_once_over_a_union(spark):
    """Both sides are dealt by key, and their parts are put together differently: few heads, many cells."""
    conf = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        cells = spark.range(20_000).selectExpr("id % 40 AS k", "CAST(id DIV 40 + 2 AS int) AS row").groupBy("k", "row").count()
        body = cells.selectExpr("k", "CAST(row_number() OVER (PARTITION BY k ORDER BY row) + 1 AS int) AS row", "1 AS col", "CAST(count AS string) AS value", "'number' AS kind")
        heads = spark.range(80).selectExpr("id % 40 AS k").distinct().selectExpr("k", "1 AS row", "1 AS col", "'Parts' AS value", "'text' AS kind")
        books = workbooks.made(body.unionByName(heads), "k").collect()
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert sorted(r.k for r in books) == [*range(40)]
    assert {len([*workbooks.workbook_cells(bytes(r.content))]) for r in books} == {501}


def test_each_workbook_counts_once(spark, tmp_path):
    """A supplier that is listed twice has one workbook, and lines of a supplier that is not listed have one too."""
    spark.createDataFrame([(1,), (1,), (2,), (4,)], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, 7, 2.0), (1, 7, 3.0), (1, 8, 1.0), (3, 7, 4.0)], "l_suppkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(str, map(tuple, stores.a15_workbooks(spark, str(tmp_path)).collect())))
    with duckdb.connect() as duck:
        for name in ("supplier", "lineitem"):
            duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert sorted(map(str, duck.execute(stores.SQL["a15_workbooks"]).fetchall())) == got and len(got) == 8


def test_pages_are_scanned_in_small_steps(spark, monkeypatch):
    """Links of a batch of pages are not all held as Python objects: they go to Arrow every so many."""
    pages = [("<a href=/x>" * n,) for n in (0, 3, 5000, 5001, 1)] + [(None,)]
    sizes = []
    monkeypatch.setattr(markup, "STEP_LINKS", 4)
    made = pa.array
    scan = markup.links_of
    monkeypatch.setattr(markup.pa, "array", lambda x, *kind: sizes.append(sum(len(y["links"]) for y in x)) or made(x, *kind))
    got = scan(made([p for p, in pages]), 5000)
    monkeypatch.undo()
    assert [(len(x["links"]), x["more"]) for x in got.to_pylist()] == [(0, False), (3, False), (5000, False), (5000, True), (1, False), (0, False)]
    assert max(sizes) == 5000 and len(sizes) > 3
    frame = spark.createDataFrame(pages, "html string").select(markup.links(F.col("html")).alias("x")).select(F.size("x.links"), "x.more")
    assert sorted(map(tuple, frame.collect())) == [(0, False), (0, False), (1, False), (3, False), (5000, False), (5000, True)]


def test_a_second_run_stages_nothing(monkeypatch, tmp_path):
    contents = [f"page {i}".encode() for i in range(5)]
    rows = [{"key": f"raw/x/{hashlib.sha256(c).hexdigest()}.html", "content": c} for c in contents]
    monkeypatch.setattr(store.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    for expected in (5, 0):
        writer = store.StoreWriter(str(tmp_path))
        message = writer.write(iter(rows))
        writer.commit([message])
        assert len(message.keys) == expected
    (tmp_path / rows[0]["key"]).write_bytes(b"other")
    with pytest.raises(ValueError, match="another content"):
        store.StoreWriter(str(tmp_path)).write(iter(rows))
