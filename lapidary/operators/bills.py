"""Priced bills of quantities, read from pages of text.

Two layouts: in the vertical one, under a heading with column headers, every part of a row
has a line of its own; else a row is one line that ends in unit, quantity, rate and amount.
Documents are independent of each other, and bounded by what a page reader hands on, so each
is read as one row: pages are shuffled once, and an Arrow batch reads the lines of its documents in
order (:mod:`bill_lines`), so that lines are neither sorted nor shuffled.  Nothing is left out for its arithmetic: rows say how their figures
agree, and a block that holds two rows is refused with a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import text as T
from lapidary.operators import bill_lines as L
from lapidary.operators import calc

#: What heads a vertical table.
HEADING = r"(?i)Bill\s+of\s+Quantities\s*\(BOQ\)|Priced\s+Bill\s+of\s+Quantit"
RATE_HEADER, QUANTITY_HEADER = r"(?m)^\s*Rate(\s+per)?\s*$", r"(?m)^\s*Quantity\s*$"
#: Lines of a block, characters of a description.
MOST_BLOCK, MOST_CHARS = 48, 2000

ROW = ("document_id", "layout", "order", "item", "description", "unit", "quantity", "rate", "amount", "quantity_literal", "rate_literal", "amount_literal", "page", "consistency")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once; within a lambda Spark would do it for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def documents(pages: DataFrame) -> DataFrame:
    """(document_id, from_page, pages): the pages of each document in order, as struct(page, text).

    Where there is a vertical table, from_page is its first page and pages begin there; else it is null.
    """
    text = F.col("text")
    table = text.rlike(HEADING) & text.rlike(RATE_HEADER) & text.rlike(QUANTITY_HEADER)
    together = pages.select("document_id", "page", "text").repartition("document_id")
    found = together.groupBy("document_id").agg(F.min(F.when(table, F.col("page"))).alias("from_page"), F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))).alias("pages"))
    own = F.filter(F.sort_array("pages"), lambda p: F.col("from_page").isNull() | (p["page"] >= F.col("from_page")))
    return found.select("document_id", "from_page", own.alias("pages"))


FIGURES = ("quantity", "rate", "amount")


def read_figures(literals: Column) -> Column:
    """Printed figures as numbers.  They are read before rows are exploded, so that no later use of a number reads it again."""
    return F.transform(literals, calc.figure)


def figures(frame: DataFrame, read: Sequence[Column]) -> DataFrame:
    """Numbers from three figures that were read, and how they agree."""
    return frame.select("*", *(x["value"].cast("decimal(20,4)").alias(c) for c, x in zip(FIGURES, read, strict=True)), calc.consistency(*read).alias("consistency"))


# One row on each line.


def line_rows(pages: DataFrame) -> DataFrame:
    """Rows of the one-line layout."""
    found = documents(pages).filter("from_page IS NULL").select("document_id", F.explode(L.read(F.col("pages"), L.LINE_ROW, L.line_rows)).alias("row")).select("document_id", "row.*")
    shown = F.coalesce(F.trim("own"), F.concat_ws(" ", "context", F.nullif(F.col("head"), F.lit(""))))
    found = found.withColumns({"unit": F.regexp_replace("unit", r"\.+$", ""), "description": F.left(F.trim(shown), F.lit(MOST_CHARS)), "layout": F.lit("line"), "item": F.coalesce("item", F.concat(F.lit("row "), F.col("order")))})
    return figures(found, [calc.figure(F.col(f"{c}_literal")) for c in FIGURES]).select(*ROW)


def stated_totals(found: DataFrame) -> DataFrame:
    """(document_id, total) of documents that state one: struct(page, text, value), by the layout of each."""
    total = found.select("document_id", F.explode(L.read(F.col("pages"), L.STATED, L.line_total, F.col("from_page").isNotNull(), L.table_total)).alias("x"))
    return total.select("document_id", F.struct("x.page", "x.text", T.accounting_number(F.col("x.literal"), "decimal(20,4)").alias("value")).alias("total"))


def line_totals(found: DataFrame) -> DataFrame:
    """(document_id, total) of documents without a vertical table: the first bare total that is not less than the sum of the rows, which can only total the whole."""
    return stated_totals(found.filter("from_page IS NULL"))


# Every part of a row on its own line.


def vertical_read(pages: DataFrame) -> DataFrame:
    """Blocks with their figures, and why a block is refused: one with two complete rows, or with too many lines, is not understood."""
    found = documents(pages).filter("from_page IS NOT NULL").select("document_id", F.explode(L.read(F.col("pages"), L.SUB_BLOCK, L.sub_blocks)).alias("own")).select("document_id", "own.*")
    kinds = F.transform("lines", lambda x: F.struct(x.alias("rest"), F.when(x.rlike(L.MONEY_LINE), "money").when(x.rlike(L.UNIT_LINE), "unit").alias("kind")))
    short = F.col("size") <= MOST_BLOCK

    def read(kinds: Column) -> Column:
        of = lambda kind: F.transform(F.filter(kinds, lambda x: x["kind"].eqNullSafe(F.lit(kind))), lambda x: x["rest"])
        tails = F.transform(kinds, lambda x: F.regexp_extract(x["rest"], r"(\S+)$", 1))
        unit = F.coalesce(F.get(of("unit"), F.lit(0)), F.get(F.filter(tails, lambda x: x.rlike(L.UNIT_LINE)), F.lit(0)))
        shown = F.when(short, F.array_join(of(None), " ")).otherwise("")
        cells = lambda money: F.slice(money, F.greatest(F.size(money) - 5, F.lit(1)), F.lit(6))
        row = lambda cells: F.struct(cells.alias("cells"), read_figures(cells).alias("figures"), unit.alias("unit"), F.left(F.trim(shown), F.lit(MOST_CHARS)).alias("description"))
        none = F.array().cast("array<string>")
        return let(cells(F.when(short, of("money")).otherwise(none)), lambda x: F.when((F.size(x) >= 3) | ~short, row(x)))

    item = F.when(F.col("letter").isNull(), F.col("number")).otherwise(F.concat("number", F.lit("("), "letter", F.lit(")")))
    found = found.select("document_id", item.alias("item"), "page", F.struct("block", "sub").alias("place"), "size", F.explode(F.array_compact(F.array(let(kinds, read)))).alias("row"))
    last, figure = (lambda x, i: F.get(x, F.size(x) - i)), F.col("row.figures")
    other = calc.consistency(*(last(figure, 6 - i) for i in range(3)))
    refused = F.when(F.col("size") > MOST_BLOCK, "more lines than a row has").when(other != "review", "more than one priced row")
    return found.select(
        "document_id", "item", "page", "place", "row.unit", "row.description", *(last(F.col("row.cells"), 3 - i).alias(f"{c}_literal") for i, c in enumerate(FIGURES)),
        F.slice(figure, F.greatest(F.size(figure) - 2, F.lit(1)), F.lit(3)).alias("read"), refused.alias("refused"),
    )


def vertical_rows(pages: DataFrame) -> DataFrame:
    read = figures(vertical_read(pages).filter("refused IS NULL"), [F.get("read", F.lit(i)) for i in range(3)])
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("place"))
    return read.withColumns({"order": order, "layout": F.lit("vertical")}).select(*ROW)


def vertical_totals(found: DataFrame) -> DataFrame:
    """(document_id, total) of documents that have a vertical table: the first figure behind the total's label."""
    return stated_totals(found.filter("from_page IS NOT NULL"))


# Both.


def bill_rows(pages: DataFrame) -> DataFrame:
    """The priced rows of every document (document_id, page, text), whichever its layout."""
    return vertical_rows(pages).unionByName(line_rows(pages))


def bill_totals(pages: DataFrame) -> DataFrame:
    """The total that each bill states for itself; bills that state none have no row."""
    return stated_totals(documents(pages)).select("document_id", F.col("total.value").alias("stated_total"), F.col("total.text").alias("literal"), "total.page")


def refused_blocks(pages: DataFrame) -> DataFrame:
    """(document_id, item, page, refused) of blocks that are not understood."""
    return vertical_read(pages).filter("refused IS NOT NULL").select("document_id", "item", "page", "refused")


def bill_facts(rows: DataFrame) -> DataFrame:
    """A fact for each thing that a row states: item, description if there is one, quantity with its unit, rate and amount in rupees."""
    fact = lambda kind, literal, value=None, unit=None, currency=None: F.struct(
        F.lit(kind).alias("fact_type"), literal.alias("literal"), (F.lit(None) if value is None else F.col(value)).cast("decimal(20,4)").alias("numeric_value"),
        (F.lit(None) if unit is None else F.col(unit)).cast("string").alias("unit"), F.lit(currency).cast("string").alias("currency"),
    )
    made = [
        fact("item_identifier", F.col("item")), F.when(F.col("description") != "", fact("item_description", F.col("description"))), fact("contracted_quantity", F.col("quantity_literal"), "quantity", "unit"),
        fact("contract_rate", F.col("rate_literal"), "rate", currency="INR"), fact("line_amount", F.col("amount_literal"), "amount", currency="INR"),
    ]
    return rows.select("document_id", "page", F.col("order").alias("sheet_row"), F.explode(F.array(*made)).alias("f")).filter("f IS NOT NULL").select("document_id", "page", "sheet_row", "f.*")


def stated_total_facts(totals: DataFrame) -> DataFrame:
    """A bill's own total as a fact of the document, which no row has."""
    none = F.lit(None)
    return totals.select("document_id", "page", none.cast("int").alias("sheet_row"), F.lit("stated_bill_total").alias("fact_type"), "literal", F.col("stated_total").alias("numeric_value"), none.cast("string").alias("unit"), F.lit("INR").alias("currency"))
