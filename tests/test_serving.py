"""What clients are shown, against rows written out by hand."""

import json
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from lapidary.functions import net
from lapidary.operators import serving
from lapidary.sources import workbooks

FACTS = "fact_id string, fact_type string, literal string, numeric_value decimal(20,2), page int, snippet string, document_id long, sheet_name string, sheet_row int, sheet_column int"
DERIVED = "derived_fact_id string, fact_type string, calculation string, calculation_version string, numeric_value decimal(28,10), expression string"
PROVISIONS = "provision_id string, provision_type string, clause string, authority string, share string, page int, snippet string, document_id long, applies_from decimal(20,2), applies_to_max decimal(20,2)"
LINKS = "finding_id int, role string, fact_id string, derived_fact_id string, provision_id string"
FINDINGS = "finding_id int, document_id int, project_id int, work_item_id int, outcome string"


def test_served(spark):
    facts = spark.createDataFrame([("f", "amount", "1.5", Decimal("1.50"), 2, "s", 9, "Bill", 43, 6), ("g", "amount", None, None, None, None, 9, "Bill", 1, None)], FACTS)
    derived = spark.createDataFrame([("d", "levy", "share", "2", Decimal("0.5"), "a / b")], DERIVED)
    provisions = spark.createDataFrame([("p", "band", "4.1", None, None, 1, "s", 8, None, Decimal("200000000"))], PROVISIONS)
    links = spark.createDataFrame([(1, "b", "f", "d", "p"), (1, "a", None, "d", None), (1, "c", None, None, "p"), (1, "z", "lost", None, None), (1, "z", None, None, None), (2, "r", "g", None, None)], LINKS)
    findings = spark.createDataFrame([(1, 5, None, None, "fail"), (2, None, 6, 7, "review"), (3, None, 6, None, None), (4, None, 6, None, "inconclusive")], FINDINGS)
    reviewed = spark.createDataFrame([(1, None), (2, "confirmed")], "finding_id int, decision string")
    got = {r["finding_id"]: r for r in serving.served(findings, serving.evidence(links, facts, derived, provisions), reviewed).collect()}
    assert [(got[i]["scope"], got[i]["review_state"], got[i]["needs_human_review"]) for i in (1, 2, 3, 4)] == [
        ("document", "unreviewed", True), ("work_item", "confirmed", False), ("project", "unreviewed", False), ("project", "unreviewed", False)
    ]
    first = [e.asDict() for e in got[1]["evidence"]]
    assert [(e["role"], e["origin"], e["id"], e["literal"], e["value"], e["cell"], e["band"]) for e in first] == [
        ("a", "derived", "d", "share v2", "0.5000000000", None, None), ("b", "extracted", "f", "1.5", "1.50", "Bill!F43", None), ("c", "policy", "p", "clause 4.1", None, None, "up to 200,000,000.00")
    ]
    assert got[2]["evidence"][0]["cell"] is None and got[2]["evidence"][0]["literal"] is None and got[3]["evidence"] == []


def test_served_of_nothing(spark):
    none = [spark.createDataFrame([], s) for s in (LINKS, FACTS, DERIVED, PROVISIONS)]
    pieces = serving.evidence(*none)
    assert serving.served(spark.createDataFrame([], FINDINGS), pieces, spark.createDataFrame([], "finding_id int, decision string")).count() == 0


def test_column_letters(spark):
    numbers = [*range(1, 60), 700, 701, 702, 703, 728, 729, 1378, 1379, 16384, 18278]
    rows = spark.createDataFrame([(n,) for n in [*numbers, 0, -1, 18279, None]], "n int").select("n", serving.column_letters(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == {n: workbooks.column_name(n) for n in numbers} | {0: None, -1: None, 18279: None, None: None}


def test_document_ids(spark):
    digests = ["a" * 64, "0123456789abcdef" * 4, "A" * 64, "a" * 63, "a" * 64 + "\n", "", None]
    rows = spark.createDataFrame([(d,) for d in digests], "d string").select(serving.document_id(F.col("d")).alias("i")).collect()
    assert [r["i"] for r in rows] == [*(str(uuid.uuid5(net.NAMESPACE, d)) for d in digests[:2]), *[None] * 5]


def test_attempts(spark):
    schema = "k int, attempt int, outcome string, duration_ms double, status_code int, error_type string, retry_after_seconds double, delay_before_next_seconds double, reason string"
    rows = [(1, 2, "ok", 1.23456, 200, None, None, None, None), (1, 1, "retry", 2.0, None, "t", 3.0, 0.5, 'a"b'), (2, None, None, None, None, None, None, None, None)]
    got = {r["k"]: r for r in serving.attempts_json(spark.createDataFrame(rows, schema), ["k"]).collect()}
    first, second = json.loads(got[1]["attempts"])
    assert [*first] == [*serving.ATTEMPT] and first["reason"] == 'a"b' and second["duration_ms"] == 1.235 and got[1]["attempt_count"] == 2
    assert (got[2]["attempts"], got[2]["attempt_count"]) == ("[]", 1)


def test_stamps(spark):
    rows = spark.createDataFrame([("m", "ocr:x"), ("m", None), (None, "ocr:x")], "m string, t string").select(serving.stamped(F.col("m"), F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["ocr:x | m", "m", None]
