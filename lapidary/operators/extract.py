"""Rows from pages of text and from sheets of cells.

What documents say is joined by shuffles: narrow columns of a compressed file look small enough to
be broadcast, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import text as T

#: Issuing authorities by how documents name them.
AUTHORITIES = [(r"National\s+Highways?\s+Authority\s+of\s+India|\bNHAI\b", "nhai", "IN")]
#: Fixed value: how a sheet names its project.
PROJECT_LINE = r"(?i)project\s*(?:reference|ref|no|number)?\s*[:\-]\s*([A-Za-z0-9][A-Za-z0-9\-_/]*)"


def authority(pages: DataFrame, known: list[tuple[str, str, str]] = AUTHORITIES) -> DataFrame:
    """(document_id, authority, jurisdiction) of documents that name a known authority, by the first page that does."""
    found = F.coalesce(*(F.when(F.col("text").rlike(pattern), F.struct(F.lit(who).alias("authority"), F.lit(where).alias("jurisdiction"))) for pattern, who, where in known))
    first = pages.select("document_id", "page", found.alias("found")).filter("found IS NOT NULL").groupBy("document_id").agg(F.min_by("found", "page").alias("found"))
    return first.select("document_id", "found.*")


def project_reference(cells: DataFrame) -> DataFrame:
    """(document_id, reference, row, col) of the first cell, by row and column, that names a project."""
    named = cells.select("document_id", "row", "col", F.regexp_extract("value", PROJECT_LINE, 1).alias("reference")).filter("reference <> ''")
    return named.groupBy("document_id").agg(F.min(F.struct("row", "col", "reference")).alias("x")).select("document_id", "x.reference", "x.row", "x.col")


#: How a schedule of rates begins, what it is about, and how a sub-clause words its rate, its band and its cap.
SCHEDULE = r"(?i)([0-9]+(?:\.[0-9]+)+)\s+[^.]{0,200}?bid security[^.]{0,200}?at the following rates ?:"
SUBJECT = r"(?i)of the estimated cost"
RATE = r"(?i)(?<![0-9/])(?:[0-9]+ ?/ ?[0-9]+|[0-9]+(?:\.[0-9]+)?|[a-z]+(?:[ -]and[ -](?:a )?[a-z-]+)?) ?(?:%|per ?cent)"
CAP = r"(?i)subject to (?:a )?maximum of"
BETWEEN, ABOVE, UP_TO = r"(?i)\bbetween\b", r"(?i)\b(?:above|exceeding|more than|over)\b", r"(?i)\b(?:up to|upto|not exceeding|below|less than)\b"


def band(condition: Column) -> Column:
    """struct(low, high) of the amounts that a condition names, as they are worded; bounds of "between" are put in order, and null is no band."""
    found = T.amounts(condition)
    value = lambda i: F.get(found, F.lit(i))["value"]
    bounds = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    none = F.lit(None).cast("decimal(30,6)")
    pair = bounds(F.least(value(0), value(1)), F.greatest(value(0), value(1)))
    return F.when(condition.rlike(BETWEEN) & (F.size(found) > 1), pair).when(condition.rlike(ABOVE) & (F.size(found) > 0), bounds(value(0), none)).when(condition.rlike(UP_TO) & (F.size(found) > 0), bounds(none, value(0)))


def provisions(pages: DataFrame, needs: str = "true") -> DataFrame:
    """(document_id, page, clause, place, span_start, span_end, snippet, on_estimate, share, applies_from, applies_to_max, cap_amount) of the first page of each document that states a schedule.

    One row for each lettered sub-clause with a rate and a band, that also has what is needed;
    others are passed over.  Spans count code points of the page with even spaces, from 0, end
    exclusive.  The cap is the first amount behind its wording, and is no part of the band.
    """
    text = T.even_spaces(F.col("text"))
    head = F.regexp_substr("flat", F.lit(SCHEDULE))
    stated = pages.select("document_id", "page", text.alias("flat")).filter(F.col("flat").rlike(SCHEDULE)).withColumn("head", head)
    opened = stated.select("document_id", "page", F.regexp_extract("head", SCHEDULE, 1).alias("clause"), (F.instr("flat", F.col("head")) - 1 + F.char_length("head")).alias("at"), "flat")
    cut = F.split(F.substring("flat", F.col("at") + 1, F.char_length("flat")), r"(?i)(?=\([a-z]\))")
    pieces = opened.select("document_id", "page", "clause", "at", F.posexplode(cut).alias("place", "piece"))
    before = F.sum(F.char_length("piece")).over(Window.partitionBy("document_id", "page").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("span_start", (F.col("at") + F.coalesce(before, F.lit(0))).cast("int"))
    lettered = pieces.select("document_id", "page", "clause", "place", "span_start", F.rtrim("piece").alias("piece")).filter(F.col("piece").rlike(r"(?i)^\([a-z]\)"))
    parts = F.split(F.trim(F.substring("piece", F.lit(4), F.char_length("piece"))), CAP, 2)
    bodies = lettered.withColumn("body", F.trim(F.substring("piece", F.lit(4), F.char_length("piece")))).withColumn("condition", F.get(parts, F.lit(0))).withColumn("behind", F.get(parts, F.lit(1)))
    read = bodies.select(
        "document_id", "page", F.concat("clause", F.lower(F.left("piece", F.lit(3)))).alias("clause"), "place", "span_start", (F.col("span_start") + F.char_length("piece")).alias("span_end"), F.left("body", F.lit(1000)).alias("snippet"),
        F.col("body").rlike(SUBJECT).alias("on_estimate"), T.percent_as_fraction(F.regexp_substr("body", F.lit(RATE))).alias("share"), band(F.col("condition")).alias("band"), F.get(T.amounts(F.col("behind")), F.lit(0))["value"].alias("cap_amount"),
    )
    good = read.filter("share IS NOT NULL AND band IS NOT NULL").filter(needs)
    first = good.withColumn("first", F.min("page").over(Window.partitionBy("document_id"))).filter(F.col("page").eqNullSafe(F.col("first")))
    return first.select(*(c for c in read.columns if c not in ("band", "cap_amount")), F.col("band.low").alias("applies_from"), F.col("band.high").alias("applies_to_max"), "cap_amount")


def rate_schedules(pages: DataFrame) -> DataFrame:
    """Provisions on the estimated cost with the authority whose rule they are; a document of no known authority binds nobody and gives none."""
    own = provisions(pages, "on_estimate").drop("on_estimate").join(authority(pages).hint("merge"), "document_id")
    return own.withColumns({"provision_type": F.lit("bid_security_share"), "applies_to": F.lit("estimated_cost"), "currency": F.lit("INR")})


def sheet_header(cells: DataFrame, aliases: DataFrame, needed: str = "item", one_of: tuple[str, ...] = ("quantity", "rate")) -> DataFrame:
    """(document_id, row, col, field) of the first row with an item column and a quantity or rate column; aliases: label, field."""
    named = cells.withColumn("label", T.header_key(F.col("value"))).join(F.broadcast(aliases), "label")
    rows = named.groupBy("document_id", "row").agg(F.collect_set("field").alias("fields"))
    good = rows.filter(F.array_contains("fields", needed) & F.arrays_overlap("fields", F.array(*map(F.lit, one_of))))
    first = good.groupBy("document_id").agg(F.min("row").alias("row"))
    return named.join(first.hint("merge"), ["document_id", "row"]).select("document_id", "row", "col", "field")


def sheet_rows(cells: DataFrame, header: DataFrame) -> DataFrame:
    """One row for each numbered line under the header; numbers are read exactly, other cells stay text."""
    head = header.select("document_id", F.col("row").alias("head"), "col", "field")
    placed = cells.join(head.hint("merge"), ["document_id", "col"]).filter("row > head")
    wide = placed.groupBy("document_id", "row").pivot("field", ["item", "description", "unit", "quantity", "rate", "amount"]).agg(F.first("value"))
    numbers = {c: T.accounting_number(F.col(c), "decimal(20,4)") for c in ("quantity", "rate", "amount")}
    return wide.filter(F.col("item").rlike(r"^[0-9]+([.\-(][0-9a-z)]+)*$")).withColumns({f"{c}_value": v for c, v in numbers.items()})


def column_letters(col: Column) -> Column:
    """A for 1, Z for 26, AA for 27: up to three letters, which is what sheets have."""
    letter = lambda n: F.char((n % 26 + 65).cast("int"))
    n = (col - 1).cast("long")
    third, second = F.floor((n - 26) / 676) - 1, F.floor(n / 26) - 1
    return F.concat(F.when(n >= 702, letter(third + 0)).otherwise(""), F.when(n >= 26, letter(F.pmod(second, F.lit(26)))).otherwise(""), letter(n))


def cell_reference(sheet: Column, row: Column, col: Column) -> Column:
    """Sheet!D6 for row 6 and column 4."""
    return F.concat(sheet, F.lit("!"), column_letters(col), row.cast("string"))
