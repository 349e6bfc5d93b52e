"""Bills of quantities in both layouts."""

from decimal import Decimal

from lapidary.operators import bills

HEADER = "Bill of Quantities (BOQ)\nSr\nNo.\nDescription Unit\nQuantity\nRate per\nunit\nAmount (In\nRs)\n"


def pages(spark, *texts, name="d"):
    return spark.createDataFrame([(name, i, t) for i, t in enumerate(texts, 1)], "document_id string, page int, text string")


def rows(spark, *texts):
    return bills.bill_rows(pages(spark, *texts)).orderBy("order").collect()


def total(spark, *texts):
    return [(r.stated_total, r.literal, r.page) for r in bills.bill_totals(pages(spark, *texts)).collect()]


def test_credit_in_parentheses_and_total(spark):
    text = HEADER + "1\nMilling on Bituminous Surface\nCum\n945.00\n679.00\n6,41,655.00\n2 Recovery of Milled Material Cum\n661.50\n(1,785.60)\n(11,81,174.40)\nTotal Estimated Cost\n(5,39,519.40)\nBidder to quote 1.00\n"
    got = rows(spark, "Contents: Bill of Quantities (BOQ)\n1\n2\n", text)
    assert [(r.item, r.unit, r.quantity, r.rate, r.amount, r.consistency, r.page) for r in got] == [
        ("1", "Cum", Decimal("945.00"), Decimal("679.00"), Decimal("641655.00"), "exact", 2),
        ("2", "Cum", Decimal("661.50"), Decimal("-1785.60"), Decimal("-1181174.40"), "exact", 2),
    ]
    assert got[1].description == "Recovery of Milled Material Cum"
    assert total(spark, "x", text) == [(Decimal("-539519.40"), "(5,39,519.40)", 2)]


def test_sub_items(spark):
    text = HEADER + "1\nKilometre Stone: - Reinforced cement concrete M25 grade\n-\n(a)\n5th kilometre stone\nNos\n5.00\n3,550.00\n17,750.00\n(b)\nOrdinary kilometre stone\nNos\n20.00\n2,078.00\n41,560.00\nTotal Estimated Cost\n59,310.00\n"
    got = rows(spark, text)
    assert [(r.item, r.amount) for r in got] == [("1(a)", Decimal("17750.00")), ("1(b)", Decimal("41560.00"))]
    assert "Kilometre Stone" in got[0].description and "5th kilometre stone" in got[0].description and "Ordinary" not in got[0].description
    assert bills.refused_blocks(pages(spark, text)).collect() == []


def test_two_rows_in_a_block_are_refused_and_numbers_in_text_are_no_items(spark):
    text = HEADER + "1\nPlaster\n12 mm thick\nSqm\n2.00\n3.00\n6.00\nNos\n4.00\n5.00\n20.00\n2\nPaint\n7 coats\nSqm\n1.00\n3.00\n4.00\nGrand Total\n"
    got = rows(spark, text)
    assert [(r.item, r.description, r.consistency) for r in got] == [("2", "Paint 7 coats", "review")]
    assert [(r.item, r.refused) for r in bills.refused_blocks(pages(spark, text)).collect()] == [("1", "more than one priced row")]
    assert total(spark, text) == []


def test_a_block_of_many_lines_is_refused_and_not_lost(spark):
    text = HEADER + "1\nPlaster\n" + "note\n" * 60 + "Sqm\n2.00\n3.00\n6.00\n2\nPaint\nSqm\n1.00\n4.00\n4.00\n"
    assert [r.item for r in rows(spark, text)] == ["2"]
    assert [(r.item, r.refused) for r in bills.refused_blocks(pages(spark, text)).collect()] == [("1", "more lines than a row has")]


def test_lines(spark):
    text = """3.6 RCC work
3.6.1.1 M-25 Grade Cum 115 8,556.65       984,014.26
4.2.1 Above Floor VI up to Floor IX Cum. 1900 139.92          265,849.40
9 Pipes
laid in trenches
Rmt 6500 56.00            364,000.00
Nos.30 498.00                  14,940.00
VII-5
4.26.1.1Exterior Grade MDF Board Sqm 2 3.00 6.00
Earthing -Down conductorMtr 600 101.00 60,600.00
Point
12 3.00 36.00
Point

12 3.00 36.00
Providing and laying the platform 12 100.00 1,200.00
Total for RCC Work 392,522,415.84
"""
    got = rows(spark, text)
    assert [(r.item, r.unit, r.quantity_literal, r.rate_literal) for r in got] == [
        ("3.6.1.1", "Cum", "115", "8,556.65"), ("4.2.1", "Cum", "1900", "139.92"), ("9", "Rmt", "6500", "56.00"), ("9", "Nos", "30", "498.00"),
        ("4.26.1.1", "Sqm", "2", "3.00"), ("4.26.1.1", "Mtr", "600", "101.00"), ("4.26.1.1", "Point", "12", "3.00"),
    ]
    assert [r.description for r in got[:4]] == ["M-25 Grade", "Above Floor VI up to Floor IX", "Pipes laid in trenches", ""]
    assert got[0].consistency == "consistent_with_display_rounding" and got[5].description == "Earthing -Down conductor"
    assert [r.item for r in rows(spark, "Nos 1 2.00 2.00")] == ["row 1"]


def test_stated_totals_of_lines(spark):
    work = "1 Excavation in ordinary soil\nCum 100.00 6.00 600.00\n2 Plain cement concrete 1:4:8\nCum 50.00 11.00 550.00\n"
    assert total(spark, "PART - I CIVIL WORK 1,000.00\nTOTAL OF (I+II) 1,200.00\nTotal 1,200.00\nTotal with GST 1,416.00\n", work) == [(Decimal("1200.00"), "Total 1,200.00", 1)]
    assert total(spark, work + "GRAND TOTAL 600.00\nTotal 1,200.00\n") == [(Decimal("1200.00"), "Total 1,200.00", 1)]
    assert total(spark, work + "TOTAL OF SECTION A 600.00\n") == []
    assert sum(r.amount for r in rows(spark, work)) == Decimal("1150.00")


def test_facts_and_empty_tables(spark):
    both = pages(spark, "1 Work\nCum 2 3.00 6.00\nTotal 6.00", name="a").union(pages(spark, None, name="b"))
    facts = bills.bill_facts(bills.bill_rows(both)).unionByName(bills.stated_total_facts(bills.bill_totals(both))).collect()
    assert sorted((f.fact_type, f.literal, f.unit, f.currency) for f in facts) == [
        ("contract_rate", "3.00", None, "INR"), ("contracted_quantity", "2", "Cum", None), ("item_description", "Work", None, None),
        ("item_identifier", "1", None, None), ("line_amount", "6.00", None, "INR"), ("stated_bill_total", "Total 6.00", None, "INR"),
    ]
    assert bills.bill_rows(both.limit(0)).collect() == [] == bills.bill_totals(both.limit(0)).collect()


def test_lines_are_neither_sorted_nor_shuffled(spark, tmp_path):
    """Pages are shuffled once, and nothing is kept that could spill: a document is one row."""
    pages(spark, HEADER + "1\nWork\nSqm\n2.00\n3.00\n6.00\n", name="a").union(pages(spark, "1 Work\nCum 2 3.00 6.00\nTotal 6.00", name="b")).write.parquet(str(tmp_path / "pages"))
    own = spark.read.parquet(str(tmp_path / "pages"))
    for found in (bills.vertical_rows(own).drop("order"), bills.line_rows(own), bills.vertical_totals(bills.documents(own)), bills.line_totals(bills.documents(own))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Sort " not in plan and "Window" not in plan and "MergeJoin" not in plan and "HashJoin" not in plan
    assert [r.item for r in bills.bill_rows(own).orderBy("document_id").collect()] == ["1", "1"]


def test_lines_are_read_in_one_pass_and_not_by_functions_on_arrays(spark):
    """Folding an array with expressions is interpreted, line by line; totals of both layouts take one pass over the documents."""
    both = pages(spark, HEADER + "1\nWork\nSqm\n2.00\n3.00\n6.00\nTotal\n6.00", name="a").union(pages(spark, "1 Work\nCum 2 3.00 6.00\nTotal 6.00", name="b"))
    for found in (bills.line_rows(both), bills.bill_totals(both)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 == plan.count("Exchange") and "aggregate(" not in plan and "transform(" not in plan
    assert sorted(total(spark, HEADER + "1\nWork\nSqm\n2.00\n3.00\n6.00\nTotal\n6.00") + total(spark, "1 Work\nCum 2 3.00 6.00\nTotal 6.00")) == [(Decimal("6.00"), "6.00", 1), (Decimal("6.00"), "Total 6.00", 1)]
    assert [(r.item, r.unit, r.description) for r in rows(spark, "1 Work of soil\nCum 2 3.00 6.00\nxRM 2 3.00 6.00\n2 DepthM2 Nos 2 3.00 6.00")] == [("1", "Cum", "Work of soil"), ("2", "Nos", "DepthM2")]


def test_facts_of_a_row_are_made_without_functions_on_arrays(spark):
    """A row without a description states four facts; what is left out is filtered as rows, not within an array."""
    own = bills.line_rows(pages(spark, "Nos 1 2.00 2.00\n1 Work\nCum 2 3.00 6.00"))
    facts = bills.bill_facts(own)
    assert "lambdafunction(isnotnull" not in facts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((f.sheet_row, f.fact_type) for f in facts.collect() if f.fact_type.startswith("item")) == [(1, "item_identifier"), (2, "item_description"), (2, "item_identifier")]
