"""Which documents and rows speak of the same thing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions.text import project_key


def key_id(*parts: Column) -> Column:
    """A deterministic id: the same parts give the same id in every run."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def unordered_pairs(rows: DataFrame, group: Sequence[str], member: str, kind: Column) -> DataFrame:
    """Each pair of different members of a group once, lower id first.

    The pairs are the result here.  Groups are documents of one project, and small.
    """
    rows = rows.select(*group, member).distinct()
    a, b = rows.withColumnRenamed(member, "low_id"), rows.withColumnRenamed(member, "high_id")
    return a.join(b, list(group)).filter("low_id < high_id").withColumn("relationship", kind)


def linked_items(facts: DataFrame, identifier: Column, scope: str, order: Column) -> DataFrame:
    """Work items by normalised identifier, with the first spelling and how sure the match is."""
    keyed = facts.withColumn("item_key", identifier).filter("item_key <> ''")
    spelled = keyed.groupBy(scope, "item_key").agg(
        F.min_by("literal", order).alias("first_spelling"),
        F.count_distinct("literal").alias("n_spellings"),
        F.count(F.lit(1)).alias("n_facts"),
    )
    return spelled.withColumn("match", F.when(F.col("n_spellings") == 1, "exact_identifier").otherwise("normalised_identifier"))


def supersession(edges: DataFrame) -> DataFrame:
    """(document_id, version_state) from (superseding_id, superseded_id) edges.

    A superseded document is so, unless the other one is superseded by it in turn: then
    neither is known to be current.  An edge to itself says nothing.
    """
    edges = edges.filter("superseding_id <> superseded_id").distinct()
    back = edges.select(F.col("superseding_id").alias("superseded_id"), F.col("superseded_id").alias("superseding_id"), F.lit(True).alias("mutual"))
    known = edges.join(back, ["superseding_id", "superseded_id"], "left")
    old = known.select(F.col("superseded_id").alias("document_id"), F.when(F.col("mutual"), 2).otherwise(1).alias("rank"))
    new = known.select(F.col("superseding_id").alias("document_id"), F.when(F.col("mutual"), 2).otherwise(0).alias("rank"))
    state = F.element_at(F.array(F.lit("active"), F.lit("superseded"), F.lit("unknown")), F.max("rank") + 1)
    return old.union(new).groupBy("document_id").agg(state.alias("version_state"))


def row_anchors(facts: DataFrame, identifiers: DataFrame) -> DataFrame:
    """facts with the item that their document's row names; rows without a number name none."""
    newest = identifiers.filter("sheet_row IS NOT NULL").groupBy("document_id", "sheet_row").agg(F.max_by("literal", F.struct("extractor_version", "fact_id")).alias("item"))
    return facts.join(newest, ["document_id", "sheet_row"], "left")


#: Facts that name a project, the strongest first, and what documents are to each other that share one.
PROJECT_KEYS = {"nit_number": "same_tender", "project_reference": "same_contract"}


def projects(facts: DataFrame, origins: DataFrame, retractions: DataFrame) -> DataFrame:
    """(document_id, source_id, external_ref, keyed_by, relationship): documents in the project that their strongest identifier names.

    Sources are kept apart, withdrawn identifiers group nothing.  Of one rank the first fact by
    id counts; a document without an identifier has no row.
    """
    ranks = F.create_map(*(F.lit(x) for i, k in enumerate(PROJECT_KEYS) for x in (k, i)))
    named = facts.filter(F.col("fact_type").isin(*PROJECT_KEYS)).join(retractions.select("fact_id"), "fact_id", "left_anti")
    best = named.groupBy("document_id").agg(F.min(F.struct(F.element_at(ranks, F.col("fact_type")).alias("rank"), "fact_id", "fact_type", "literal")).alias("best"))
    placed = best.join(origins.groupBy("document_id").agg(F.min("source_id").alias("source_id")), "document_id")
    placed = placed.select("document_id", "source_id", project_key(F.col("best.literal")).alias("external_ref"), "best.fact_type")
    first = placed.groupBy("source_id", "external_ref").agg(F.min_by("fact_type", "document_id").alias("keyed_by"))
    kinds = F.create_map(*(F.lit(x) for pair in PROJECT_KEYS.items() for x in pair))
    return placed.drop("fact_type").join(first, ["source_id", "external_ref"]).withColumn("relationship", F.element_at(kinds, F.col("keyed_by")))


def sole_origin(origins: DataFrame) -> DataFrame:
    """(document_id, source_id, ambiguous): the origin of each document that has one only; several are never chosen from."""
    one = F.min("source_id") == F.max("source_id")
    return origins.groupBy("document_id").agg(F.when(one, F.min("source_id")).alias("source_id"), F.coalesce(~one, F.lit(False)).alias("ambiguous"))
