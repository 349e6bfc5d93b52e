"""Tender notices: reference, date, cost, security and prescribed share, each from the first page that states it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import text as T

#: Labels and wordings that notices use.
REFERENCE_PART = r"[A-Za-z0-9_.\-&'’]*(?: ?\([A-Za-z0-9 _.\-&'’]*\))?"
REFERENCE = rf"(?i)(?:NIT|Tender|IFB)\s*No\.?\s*[:\-]?\s*([A-Za-z0-9]{REFERENCE_PART}(?:/{REFERENCE_PART})+)"
RATE_OF = r"(?:[0-9]{1,9}(?:\.[0-9]{1,9})?\s?(?:%|per\s?cent)|(?:one|two|three|four|five|half|quarter)(?:[\s\-]and[\s\-]\w{1,20})?[\s\-]{0,2}(?:%|per\s?cent))\w{0,9}\sof\s(?:the\s)?"
#: What stands before the label is looked at only where its first word was found.
COST_LABEL = rf"(?i)Estimated(?<!{RATE_OF}Estimated)\s+Cost"
SECURITY_LABEL = r"(?i)Bid\s+Security|Earnest\s+Money|\bEMD\b"
DOCUMENT_FEE = r"(?i)Cost\s+of\s+Bid\s+Document|Tender\s+Fee|Document\s+Fee|Non-?Refundable"
TOTAL_LABEL = r"(?i)\bTotals?\b"
WITH_TAX = r"(?i)(?:incl(?:uding|usive|\.)?|with)\s+(?:of\s+)?(?:[0-9]+(?:\.[0-9]+)?\s*%\s*)?(?:GST|tax|VAT|cess)"
SHARE = r"(?i)(?:Bid\s+Security|EMD)([^.]{0,60}?)@?\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*of\s+(?:the\s+)?estimated\s+cost"
OTHER_INSTRUMENT = r"(?i)Performance\s+Security|Retention|Liquidated|Advance|Turnover|Similar\s+Work"
#: Characters between two labels of one header, behind a label, before an amount for a fee, and for a total.
HEADER_GAP, WINDOW, FEE_WINDOW, TOTAL_WINDOW = 120, 900, 130, 80
#: Fixed value: a security of this share of the cost, or more, is another figure.
MOST_SHARE = "0.5"

FIELDS = ("nit_number", "document_date", "estimated_cost", "bid_security", "prescribed_share")


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """frame with columns that are worked out once for each row: filters and later uses do not go behind an explode and repeat them."""
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return frame.select("*", made.alias("made")).select(*frame.columns, "made.*")


def label_places(pages: DataFrame) -> DataFrame:
    """pages that label a cost, with the places of the first label of each kind (1-based, end exclusive; a security's is 0 where there is none)."""
    text = F.col("text")
    halves = once(once(pages, cost=F.split(text, COST_LABEL, 2)).filter(F.size("cost") == 2), security=F.split(text, SECURITY_LABEL, 2))
    labelled = F.size("security") == 2
    begin, end = (lambda x: F.char_length(F.get(x, F.lit(0))) + 1), (lambda x: F.char_length(text) - F.char_length(F.get(x, F.lit(1))) + 1)
    return once(halves, cost_from=begin("cost"), cost_to=end("cost"), security_from=F.when(labelled, begin("security")).otherwise(0), security_to=F.when(labelled, end("security"))).drop("cost", "security")


def regions(pages: DataFrame) -> DataFrame:
    """(document_id, page, together, side, at, lead, body): the text behind each label of a page that labels a cost.

    Labels close together are the header of a row, with one region; labels apart have one each,
    side 0 for the cost and 1 for the security.
    """
    text = F.col("text")
    placed = label_places(pages)
    together = F.coalesce(F.abs(F.col("security_from") - F.col("cost_to")) <= HEADER_GAP, F.lit(False)) & (F.col("security_from") > 0)
    placed = placed.withColumn("together", together)
    first = F.when(F.col("together"), F.greatest("cost_to", "security_to")).otherwise(F.col("cost_to"))
    second = F.when((F.col("security_from") > 0) & ~F.col("together"), F.col("security_to"))
    found = placed.select("document_id", "page", "text", "together", F.posexplode(F.array(first, second)).alias("side", "at")).filter("at IS NOT NULL")
    lead = F.substring(text, F.greatest(F.lit(1), F.col("at") - TOTAL_WINDOW), F.least(F.lit(TOTAL_WINDOW), F.col("at") - 1))
    return found.select("document_id", "page", "together", "side", "at", lead.alias("lead"), F.substring(text, F.col("at"), F.lit(WINDOW)).alias("body"))


def region_amounts(pages: DataFrame) -> DataFrame:
    """(document_id, page, together, side, nth, place, value, is_total): every amount behind a label, those of document fees left out.

    One is the total if it is called that, without tax, and is the sum of all before it.
    """
    cells = once(regions(pages), cells=T.amount_cells(F.col("body")))
    sizes = F.transform("cells", lambda x: F.char_length(T.amount_literal(x)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    cells = once(cells, starts=starts).select("document_id", "page", "together", "side", "at", "lead", "body", "starts", F.posexplode("cells").alias("i", "cell"))
    found = once(cells.filter("i % 2 = 1"), start=F.get("starts", F.col("i")), value=T.amount_value(F.col("cell")))
    start = F.col("start")
    fee = F.substring("body", F.greatest(F.lit(1), start - FEE_WINDOW + 1), F.least(F.lit(FEE_WINDOW), start)).rlike(DOCUMENT_FEE)
    found = found.filter(F.col("value").isNotNull()).filter(~fee)
    place = F.char_length("lead") + start + 1
    around = F.substring(F.concat("lead", "body"), F.greatest(F.lit(1), place - TOTAL_WINDOW), F.least(F.lit(TOTAL_WINDOW), place - 1))
    found = found.select("document_id", "page", "together", "side", "i", (F.col("at") + start).alias("place"), "value", (around.rlike(TOTAL_LABEL) & ~around.rlike(WITH_TAX)).alias("called"))
    order = Window.partitionBy("document_id", "page", "side").orderBy("i")
    before = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumns({"nth": F.row_number().over(order), "before": before}).withColumn("is_total", F.coalesce(F.col("called") & (F.col("before") == F.col("value")), F.lit(False)))


def table_amounts(pages: DataFrame) -> DataFrame:
    """(document_id, page, estimated_cost, bid_security) of pages that label a cost and state it.

    Behind a header the first amount is the cost and the second the security.  Labels apart own
    what follows each; a total of all amounts before it is then the cost.
    """
    nth = lambda side, n: F.max(F.when((F.col("side") == side) & (F.col("nth") == n), F.struct("value", "place")))
    total = F.min_by(F.struct("value", "place"), F.when((F.col("side") == 0) & F.col("is_total"), F.col("nth")))
    read = region_amounts(pages).groupBy("document_id", "page", "together").agg(nth(0, 1).alias("first"), nth(0, 2).alias("second"), nth(1, 1).alias("other"), total.alias("total"))
    cost = F.when(F.col("together"), F.col("first")).otherwise(F.coalesce("total", "first"))
    security = F.when(F.col("together"), F.col("second")).otherwise(F.col("other"))
    read = read.select("document_id", "page", cost.alias("cost"), security.alias("security")).filter("cost IS NOT NULL")
    c, s = F.col("cost.value"), F.col("security.value")
    plausible = (F.col("security.place") != F.col("cost.place")) & (c > 0) & (s < c * F.lit(MOST_SHARE).cast("decimal(2,1)"))
    return read.select("document_id", "page", c.alias("estimated_cost"), F.when(plausible, s).alias("bid_security"))


def prescribed_share(text: Column) -> Column:
    """The share of cost that the text prescribes for the security, not for another instrument."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(SHARE), F.lit(1)).alias("between"), F.regexp_extract_all(text, F.lit(SHARE), F.lit(2)).alias("percent"))
    own = F.get(F.filter(pairs, lambda x: ~x["between"].rlike(OTHER_INSTRUMENT)), F.lit(0))["percent"]
    return F.when(F.lower(text).contains("estimated cost"), (own.try_cast("decimal(12,4)") / 100).cast("decimal(12,8)"))


def reference(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, REFERENCE, 1), r"[.,;]+$", ""), F.lit(""))


def tender_notice(pages: DataFrame) -> DataFrame:
    """One row for each document of pages (document_id, page, text), with the fields that are missing; pages without text say nothing."""
    even = lambda own: once(own.select("document_id", "page", F.coalesce("text", F.lit("")).alias("shown")), text=T.even_spaces(F.col("shown"))).drop("shown")
    text = F.col("text")
    read = even(pages).select("document_id", "page", reference(text).alias("nit_number"), T.document_date(text).alias("document_date"), prescribed_share(text).alias("prescribed_share"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c)
    fields = read.groupBy("document_id").agg(*(first(c) for c in ("nit_number", "document_date", "prescribed_share")))
    money = table_amounts(even(pages.filter(F.lower("text").contains("estimated")))).groupBy("document_id").agg(F.min_by(F.struct("estimated_cost", "bid_security"), "page").alias("money"))
    out = fields.join(money, "document_id", "left").select("document_id", "nit_number", "document_date", "money.estimated_cost", "money.bid_security", "prescribed_share")
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in FIELDS)))
    return out.withColumn("missing", missing)
