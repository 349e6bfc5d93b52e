"""Listings and details of an interface that answers in JSON, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PAGES = 200
LISTING = "struct<total_pages:int, page:int, items:array<struct<id:string>>>"
DETAIL = "struct<id:string, files:map<string,string>>"


def listing_links(pages: DataFrame, detail: str, listing: str) -> DataFrame:
    """(page_url, url, kind, depth) of details (one deeper) and the next page (as deep); pages: url, depth, body.

    A body that is no such object gives nothing; ids are digits only; pages are followed up to MOST_PAGES.
    """
    read = pages.withColumn("p", F.from_json("body", LISTING)).filter("p IS NOT NULL")
    items = read.select("url", "depth", F.explode(F.array_distinct(F.transform("p.items", lambda x: x["id"]))).alias("id")).filter("id RLIKE '^[0-9]+$'")
    details = items.select(F.col("url").alias("page_url"), F.concat(F.lit(detail), "id").alias("url"), F.lit("detail").alias("kind"), (F.col("depth") + 1).alias("depth"))
    more = read.filter(F.col("p.page") < F.least(F.col("p.total_pages"), F.lit(MOST_PAGES)))
    return details.union(more.select("url", F.concat(F.lit(listing), F.col("p.page") + 1), F.lit("listing"), "depth"))


def detail_documents(pages: DataFrame, formats: tuple[str, ...] = ("pdf", "xlsx")) -> DataFrame:
    """(page_url, field, url, reason) of the files that a detail names; reason says why one is passed over."""
    from lapidary.functions.urls import format_of_path

    read = pages.withColumn("p", F.from_json("body", DETAIL)).filter("p.files IS NOT NULL")
    rows = read.select(F.col("url").alias("page_url"), F.explode("p.files").alias("field", "url"))
    kind = format_of_path(F.col("url"))
    reason = F.when(F.col("url").isNull() | (F.trim("url") == ""), "empty").when(kind.isNull(), "no extension").when(~kind.isin(*formats), "format")
    return rows.withColumn("reason", reason)
