"""Operators on rows small enough to check by hand."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lapidary.functions import text as T
from lapidary.functions import urls
from lapidary.operators import bands, calc, extract, frontier, reconcile, resolve, select, state

FACT = "fact_id string, document_id string, sheet_row int, fact_type string, item string, numeric_value decimal(20,2), unit string, currency string, literal string, extractor_version string"


def facts(spark, rows):
    return spark.createDataFrame([(f"f{i}", d, r, t, item, None if v is None else Decimal(v), u, None, v, ver) for i, (d, r, t, item, v, u, ver) in enumerate(rows)], FACT)


def documents(spark, **states):
    return spark.createDataFrame(list(states.items()), "document_id string, version_state string")


def chosen(spark, rows, gone=(), **states):
    found = select.select_facts(facts(spark, rows), documents(spark, **states), spark.createDataFrame([(x,) for x in gone], "fact_id string"), ["item"])
    r = found.collect()[0]
    return r.status, r.numeric_value, r.n_considered, r.n_excluded


def test_selection(spark):
    q = "contracted_quantity"
    assert chosen(spark, [("a", 1, q, "x", "500", "m3", "1"), ("b", 1, q, "x", "550", "m3", "1")], a="superseded", b="active") == ("resolved", Decimal("550.00"), 1, 1)
    assert chosen(spark, [("a", 1, q, "x", "500", "m3", "1"), ("b", 1, q, "x", "550", "m3", "1")], a="active", b="active") == ("conflicting", None, 2, 0)
    assert chosen(spark, [(d, 1, q, "x", "500", "m3", "1") for d in "abc"], a="active", b="active", c="active") == ("resolved", Decimal("500.00"), 3, 0)
    assert chosen(spark, [("a", 1, q, "x", "500", "m3", "1"), ("a", 1, q, "x", "501", "m3", "2")], a="active") == ("resolved", Decimal("501.00"), 1, 0)
    assert chosen(spark, [("a", 1, q, "x", "500", "m3", "1")], a="superseded") == ("unresolved", None, 0, 1)
    assert chosen(spark, [("a", 1, q, "x", "500", "m3", "1")], gone=["f0"], a="active") == ("unresolved", None, 0, 1)
    assert chosen(spark, [("a", r, q, "x", str(r), "m3", "1") for r in (1, 2, 3)], a="active")[:3] == ("conflicting", None, 3)
    assert chosen(spark, [("a", 1, q, "x", "5", "Cum", "1"), ("b", 1, q, "x", "5", "cum", "1")], a="active", b="active")[0] == "conflicting"


def test_reconciliation(spark):
    """Claims against contract and measurement: item 2 claims 50 too much, item 3 at another rate."""
    wide = {
        "4.7.1": (1200, 1150, 1150, 900, 450, 450),
        "4.7.2": (500, 470, 520, 420, 8000, 8000),
        "4.7.3": (85, 60, 60, 40, 72000, 74500),
    }
    names = ("contracted_quantity", "measured_quantity", "cumulative_claim", "previous_certified", "contract_rate", "claimed_rate")
    rows = [("d", i, n, item, str(v), "m3", "1") for i, (item, values) in enumerate(wide.items()) for n, v in zip(names, values, strict=True)]
    selected = select.select_facts(facts(spark, rows), documents(spark, d="active"), spark.createDataFrame([], "fact_id string"), ["item"])
    items = {r.item: r for r in reconcile.calculated(reconcile.wide(selected, ["item"])).collect()}
    assert [(int(items[k].quantity_variance), int(items[k].remaining_contract_quantity), int(items[k].rate_variance), int(items[k].unsupported_amount)) for k in wide] == [(0, 50, 0, 0), (50, -20, 0, 400000), (0, 25, 2500, 0)]
    found = {(r.item, r.rule_id): r.outcome for r in reconcile.findings(reconcile.wide(selected, ["item"]), ["item"]).collect()}
    assert [found[k, "claim_within_measured_quantity"] for k in wide] == ["pass", "review", "pass"]
    assert [found[k, "claimed_rate_matches_contract_rate"] for k in wide] == ["pass", "pass", "review"]
    assert {found[k, "cumulative_claim_not_below_previous_certified"] for k in wide} == {"pass"}


ROWS = [
    ("115", "8556.65", "984014.26", "consistent_with_display_rounding"),
    ("1125", "5528.09", "6219105.75", "consistent_with_display_rounding"),
    ("215", "654.00", "140610.00", "exact"),
    ("661.50", "-1785.60", "-1181174.40", "exact"),
    ("67", "3260.60", "216960.10", "review"),
    ("86", "631.00", "54518.40", "review"),
    ("1", "5528.09", "5532.59", "review"),
    ("115", "8556.6500", "984014.26", "review"),
    ("0", "100.00", "500.00", "review"),
    ("661.50", "(1,785.60)", "(11,81,174.40)", "exact"),
]


def test_row_arithmetic(spark):
    frame = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ROWS)], "i int, q string, r string, a string")
    got = calc.row_arithmetic(frame, "q", "r", "a").orderBy("i").collect()
    assert [g.consistency for g in got] == [r[3] for r in ROWS]
    assert got[4].implied_rate == Decimal("3238.2104477612") and got[8].implied_rate is None


def judged_items(spark, rows, states):
    selected = select.select_facts(facts(spark, rows), documents(spark, **states), spark.createDataFrame([], "fact_id string"), ["item"])
    items = reconcile.wide(selected, ["item"])
    return reconcile.calculated(items).first(), {r.rule_id: r.outcome for r in reconcile.findings(items, ["item"]).collect()}


def test_units_and_conflicts_by_type(spark):
    both = {"a": "active", "b": "active"}
    claim, measured = ("a", 1, "cumulative_claim", "x", "520", "m3", "1"), lambda u: ("a", 2, "measured_quantity", "x", "470", u, "1")
    rate = ("a", 3, "contract_rate", "x", "8000", None, "1")
    item, found = judged_items(spark, [claim, measured("MT"), rate], both)
    assert (item.quantity_variance, item.unsupported_amount, found["claim_within_measured_quantity"]) == (None, None, "inconclusive")
    item, found = judged_items(spark, [("a", 1, "cumulative_claim", "x", "520", "Cum", "1"), measured("cum"), rate], both)
    assert (int(item.quantity_variance), item.variance_unit, int(item.unsupported_amount), found["claim_within_measured_quantity"]) == (50, "Cum", 400000, "review")
    # contract rates in conflict are no concern of the claim
    item, found = judged_items(spark, [("a", 1, "cumulative_claim", "x", "400", "m3", "1"), measured("m3"), rate, ("b", 3, "contract_rate", "x", "9000", None, "1"), ("a", 4, "claimed_rate", "x", "8000", None, "1")], both)
    assert found == {"claim_within_measured_quantity": "pass", "claimed_rate_matches_contract_rate": "review", "cumulative_claim_not_below_previous_certified": "inconclusive", "work_item_evidence_unambiguous": "review"}
    item, found = judged_items(spark, [("a", 1, "cumulative_claim", "x", "380", "m3", "1"), ("a", 2, "previous_certified", "x", "420", "m3", "1")], both)
    assert found["cumulative_claim_not_below_previous_certified"] == "review" and found["claim_within_measured_quantity"] == "inconclusive"


def agreed(spark, rows, gone=()):
    schema = "fact_id string, project_id string, document_id string, fact_type string, kind string, numeric_value decimal(20,2), extractor_version string, work_item_id string"
    frame = spark.createDataFrame([(f"f{i}", "p", d, t, k, None if v is None else Decimal(v), ver, w) for i, (d, t, k, v, ver, w) in enumerate(rows)], schema)
    per_type = select.agreement(frame, spark.createDataFrame([(x,) for x in gone], "fact_id string"), ["project_id"])
    return select.overall(per_type, ["project_id"]).first().outcome


def test_agreement_across_documents(spark):
    cost = lambda d, v, ver="1", item=None, kind="money": (d, "estimated_cost", kind, v, ver, item)
    assert agreed(spark, [cost("a", "5"), cost("b", "6")]) == "fail"
    assert agreed(spark, [cost("a", "6"), cost("b", "6.00")]) == "pass"
    assert agreed(spark, [cost("a", "6")]) == "inconclusive"
    assert agreed(spark, [cost("a", "6", kind="identifier"), cost("b", "7", kind="identifier")]) == "inconclusive"
    assert agreed(spark, [cost("a", "6"), cost("b", None)]) == "inconclusive"
    assert agreed(spark, [cost("a", "5", "1"), cost("a", "6", "2"), cost("b", "6")]) == "pass"  # two readings of one document
    assert agreed(spark, [cost("a", "5"), cost("b", "6"), cost("b", "5", item="i")]) == "fail"
    assert agreed(spark, [cost("a", "5"), cost("b", "6"), cost("c", "5")], gone=["f1"]) == "pass"


def test_item_keys(spark):
    keys = {"4.7.2": "4.7.2", "4-7-2": "4.7.2", "04.07.02": "4.7.2", "1(a)": "1(A)", " 21 / b ": "21.B", "0.10": "0.10", "00": "0", "4.7.20": "4.7.20"}
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.v for r in frame.select("k", T.item_key(F.col("k")).alias("v")).collect()} == keys


def test_bands(spark):
    rows = [(i, Decimal(v)) for i, v in enumerate(["84649969.00", "200000000.00", "500000000.00"])]
    frame = spark.createDataFrame(rows, "id int, cost decimal(20,2)")
    steps = spark.createDataFrame([(1, None, Decimal(200000000)), (2, Decimal(200000000), Decimal(500000000)), (3, Decimal(500000000), None)], "band int, low decimal(20,2), high decimal(20,2)")
    got = {r.id: (r.n_bands, r.band, r.verdict) for r in bands.applicable(frame, ["id"], "cost", steps, "low", "high", "band").collect()}
    assert got == {0: (1, 1, "applicable"), 1: (2, None, "ambiguous"), 2: (2, None, "ambiguous")}


def test_many_bands(spark):
    import random

    rng = random.Random(4)
    pick = lambda: None if rng.random() < 0.1 else Decimal(rng.randrange(200))
    steps = [(i, *sorted((pick(), pick()), key=lambda x: x or 0)) for i in range(300)]
    values = [(i, pick()) for i in range(100)]
    frame = spark.createDataFrame(values, "id int, v decimal(20,2)")
    side = spark.createDataFrame(steps, "band int, low decimal(20,2), high decimal(20,2)")
    want = sorted((i, k) for i, v in values for k, a, b in steps if (a is None or (v is not None and v >= a)) and (b is None or (v is not None and v <= b)))
    for sent in (10_000, 10):
        got = bands.band_join(frame, "v", side, "low", "high", sent=sent)
        assert sorted((r.id, r.band) for r in got.collect() if r.band is not None) == want
        assert got.select("id").distinct().count() == len(values)


@pytest.mark.parametrize(("text", "value"), [("Rs. 16.93 Lacs", 1693000), ("Rs. 8,46,49,969 only", 84649969), ("INR 2 crore", 20000000), ("1488 Km", None), ("Rs. 5 and Rs. 6", None)])
def test_amounts(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(T.the_amount(F.col("t")).alias("v")).first().v
    assert got == value if value is None else int(got) == value


def test_text_functions(spark):
    row = spark.range(1).select(
        T.item_key(F.lit("04-07.02")).alias("a"), T.item_key(F.lit("4.7.20")).alias("b"), T.accounting_number(F.lit("(1,234.50)")).cast("double").alias("c"), T.accounting_number(F.lit("n/a")).alias("d"),
        T.document_date(F.lit("dated 31.02.2024, date: 03/04/2025")).alias("e"), T.percent_as_fraction(F.lit("1/2%")).cast("double").alias("f"), T.percent_as_fraction(F.lit("one and one-half percent")).cast("double").alias("g"),
        T.file_type(F.lit("iitb-h19-priced-bill-of-quantities.pdf"))["type"].alias("h"), T.plain_decimal(F.lit("12.500").cast("decimal(10,3)")).alias("i"), extract.cell_reference(F.lit("BOQ"), F.lit(6), F.lit(30)).alias("j"),
    ).first()
    assert tuple(row) == ("4.7.2", "4.7.20", -1234.5, None, datetime.date(2025, 4, 3), 0.005, 0.015, "bill_of_quantities", "12.5", "BOQ!AD6")


def test_policy_clause(spark):
    text = "4.14.1 Bid security shall be taken at the following rates: (a) two percent of the estimated cost for works up to Rs. 20 crore subject to maximum of Rs. 30 lacs (b) one and one-half percent for works between Rs. 20 crore and Rs. 50 crore subject to maximum of Rs. 50 lacs (c) 1% for works above Rs. 50 crore"
    pages = spark.createDataFrame([("d", 1, text)], "document_id string, page int, text string")
    got = [(float(r.share), r.applies_from and int(r.applies_from), r.applies_to_max and int(r.applies_to_max), r.cap_amount and int(r.cap_amount)) for r in extract.provisions(pages).orderBy("place").collect()]
    assert got == [(0.02, None, 200000000, 3000000), (0.015, 200000000, 500000000, 5000000), (0.01, 500000000, None, None)]


def test_sheets(spark):
    cells = [("d", 5, c + 1, v) for c, v in enumerate(["Item No", "Description", "Unit", "Quantity", "Rate"])] + [("d", 6, 1, "4.7.1"), ("d", 6, 4, "1,200"), ("d", 6, 5, "450"), ("d", 7, 1, "Total"), ("d", 1, 1, "Item No")]
    frame = spark.createDataFrame(cells, "document_id string, row int, col int, value string")
    aliases = spark.createDataFrame([("item no", "item"), ("description", "description"), ("unit", "unit"), ("quantity", "quantity"), ("rate", "rate")], "label string, field string")
    header = extract.sheet_header(frame, aliases)
    got = extract.sheet_rows(frame, header).collect()
    assert [(r.item, int(r.quantity_value), int(r.rate_value)) for r in got] == [("4.7.1", 1200, 450)]


def test_supersession_and_pairs(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "d"), ("d", "c"), ("e", "e")], "superseding_id string, superseded_id string")
    assert {r.document_id: r.version_state for r in resolve.supersession(edges).collect()} == {"a": "superseded", "b": "active", "c": "unknown", "d": "unknown"}


def test_robots(spark):
    text = ["User-agent: *", "Disallow: /", "", "User-agent: crawler", "User-agent: other", "Disallow: /private # not here", "Allow: /private/open"]
    lines = spark.createDataFrame([("h", i, x) for i, x in enumerate(text)], "authority string, line int, text string")
    rules = [(r.allow, r.pattern) for r in frontier.parsed_robots(lines, "crawler-bot").collect()]
    assert sorted(rules) == [(False, "/private"), (True, "/private/open")]
    paths = spark.createDataFrame([("/",), ("/private/x",), ("/private/open/y",)], "p string")
    assert [r.ok for r in paths.select(frontier.robots_decision(F.col("p"), rules).alias("ok")).collect()] == [True, False, True]


def test_files(spark, tmp_path):
    from lapidary.sources import objects

    for name, body in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"PK\x03\x04", "c.xlsx": b"PK\x03\x04z", "d.csv": b"x,y", "e.bin": b"?", "f.pdf": b"", "again.pdf": b"%PDF-1.7 x"}.items():
        (tmp_path / name).write_bytes(body)
    rows = objects.ingested(objects.files(spark, f"file://{tmp_path}"), "s")
    got = {r.path.rsplit("/", 1)[1]: r.refused for r in rows.collect()}
    assert got == {"a.pdf": None, "again.pdf": None, "b.pdf": "contradiction", "c.xlsx": None, "d.csv": None, "e.bin": "unknown format"}  # the reader passes over empty files
    fresh = objects.new_documents(rows, spark.createDataFrame([], "sha256 string"))
    assert fresh.count() == 3 and all(r.key.startswith("raw/s/") for r in fresh.collect())


def test_reviews_and_urls(spark):
    findings = spark.createDataFrame([("f", "now", "fail", "1"), ("g", "now", "fail", "1")], "finding_id string, fingerprint string, outcome string, rule_version string")
    reviews = spark.createDataFrame([("f", "old", "fail", "1", "dismiss", "a", 3, 1), ("g", "now", "fail", "1", "accept", "b", 1, 2), ("g", "now", "fail", "1", "dismiss", "c", 2, 3)], "finding_id string, reviewed_fingerprint string, reviewed_outcome string, reviewed_rule_version string, decision string, reviewer string, reviewed_at int, review_id int")
    got = {r.finding_id: (r.decision, r.reviewable) for r in state.current_reviews(findings, reviews).collect()}
    assert got == {"f": (None, True), "g": ("dismiss", False)}
    url = spark.createDataFrame([("HTTP://Ex.COM:80/a?q=1#f",), ("ftp://x/y",), ("https://u:p@x/",), ("https://x",)], "u string")
    assert [r.c for r in url.select(urls.canonical(F.col("u")).alias("c")).collect()] == ["http://ex.com/a?q=1", None, None, "https://x/"]
