"""Tender notices in the layouts that notices have."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lapidary.operators import extract, notices


def read(spark, *texts):
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "document_id string, page int, text string")
    return notices.tender_notice(pages).first()


@pytest.mark.parametrize(
    ("text", "cost", "security"),
    [
        ("Estimated Cost (in Rs.) Bid Security (in Rs.) Completion Period\n1 Cost of Bid Documents (Non-Refundable): Rs. 25,000/- " + "w " * 70 + "Rs. 13,28,04,915/- Rs. 13.28 Lacs 12 months", 132804915, 1328000),
        ("Estimated Cost of the work is Rs. 13,28,04,915/- and so on " + "x " * 80 + "Bid Security Time for completion Rs. 13.28 Lacs", 132804915, 1328000),
        ("Estimated cost: For civil Rs.73,86,43,489.22/- For MEP Rs.11,53,37,829.19/- Total Rs.85,39,81,318.41/- Total (including 18% GST) Rs.100,76,97,956.00/-", Decimal("853981318.41"), None),
        ("Estimated cost: For civil Rs.100.00 For MEP Rs.20.00 Total Rs.130.00", 100, None),
        ("Bid Security: two percent of the Estimated Cost. Km 163.468 " + "y " * 80 + "Estimated Cost Rs. 5 crore", 50000000, None),
        ("Estimated Cost " + "z " * 460 + "Rs. 5 crore", None, None),
        ("Estimated Cost Rs. 100 " + "y " * 80 + " EMD Rs. 60", 100, None),
        ("no money here", None, None),
    ],
)
def test_cost_and_security(spark, text, cost, security):
    r = read(spark, text)
    assert (r.estimated_cost, r.bid_security) == (cost, security)


def test_reference_date_and_share(spark):
    r = read(spark, "cover", "NIT No. AB/Dean (IPS)/H-19/R1. dated 31.02.2024, date: 03/04/2025", "Performance Security @ 5% of estimated cost. EMD or Retention 3% of estimated cost. Bid Security @ 2% of the Estimated Cost")
    assert (r.nit_number, str(r.document_date), r.prescribed_share, r.missing) == ("AB/Dean (IPS)/H-19/R1", "2025-04-03", Decimal("0.02"), ["estimated_cost", "bid_security"])
    assert read(spark, None).missing == list(notices.FIELDS)


def test_authority_project_and_columns(spark):
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "the NHAI circular"), ("e", 1, "nhai")], "document_id string, page int, text string")
    assert [tuple(r) for r in extract.authority(pages).collect()] == [("d", "nhai", "IN")]
    cells = spark.createDataFrame([("d", 3, 1, "Project: B"), ("d", 2, 2, "the project ref : A-1 of"), ("e", 1, 1, "Projects")], "document_id string, row int, col int, value string")
    assert [tuple(r) for r in extract.project_reference(cells).collect()] == [("d", "A-1", 2, 2)]
    named = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 53: "BA", 702: "ZZ", 703: "AAA", 728: "AAZ", 729: "ABA", 16384: "XFD"}
    frame = spark.createDataFrame([(c,) for c in named], "c int")
    assert {r.c: r.n for r in frame.select("c", extract.column_letters(F.col("c")).alias("n")).collect()} == named


def test_labels_are_placed_by_characters_and_looked_for_once(spark):
    """Characters beyond the basic plane count as one; an expression that a filter or a second use repeats is a scan of the page too many."""
    assert read(spark, "\U0001f600" * 40 + " Estimated Cost Rs. 100 " + "y " * 80 + "EMD Rs. 2").estimated_cost == 100
    pages = spark.createDataFrame([("d", 1, "Estimated Cost Rs. 5")], "document_id string, page int, text string")
    plan = notices.table_amounts(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Cost, 2)") == 1 and "regexp_instr" not in plan and plan.count("regexp_replace") == 1
