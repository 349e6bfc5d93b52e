"""Selection of facts that refuses to choose between claims that contradict each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.operators.latest import newest


def identity(value: str = "numeric_value", unit: str = "unit", currency: str = "currency", literal: str = "literal") -> Column:
    """What makes two claims the same: the value with its unit and currency, or the literal where there is no value.

    A struct, so that nulls within it count as values.
    """
    return F.struct(F.col(value), F.col(unit), F.col(currency), F.when(F.col(value).isNull(), F.col(literal)))


def judged_sources(facts: DataFrame, documents: DataFrame, retractions: DataFrame) -> DataFrame:
    """facts with ``excluded``: why a fact may not be used, or null."""
    gone = retractions.select("fact_id").distinct().withColumn("_gone", F.lit(True))
    states = documents.select("document_id", "version_state")
    joined = facts.join(gone, "fact_id", "left").join(states, "document_id", "left")
    why = (
        F.when(F.col("_gone"), "retracted")
        .when(F.col("version_state").isNull(), "unknown document")
        .when(F.col("version_state") != "active", "superseded")
    )
    return joined.withColumn("excluded", why).drop("_gone", "version_state")


def select_facts(facts: DataFrame, documents: DataFrame, retractions: DataFrame, subject: Sequence[str]) -> DataFrame:
    """One row for each subject and fact type: resolved, conflicting or unresolved.

    Of each document's row only the newest reading counts.  Equal claims resolve to the
    first of them; different claims are a conflict, and none is selected.  Excluded readings
    sort behind all others, so that one pass over the facts is enough.
    """
    keys = [*subject, "fact_type"]
    judged = judged_sources(facts, documents, retractions)
    usable = F.col("excluded").isNull()
    reading = Window.partitionBy(*keys, "document_id", "sheet_row").orderBy(usable.desc(), F.col("extractor_version").desc_nulls_last(), "fact_id")
    counts = usable & (F.col("_place") == 1)
    claim = F.when(counts, identity())
    first = F.min_by(F.when(counts, F.struct("fact_id", "numeric_value", "unit")), F.when(counts, F.struct("document_id", "sheet_row", "fact_id")))
    # The least and the greatest claim are equal if all are: no shuffle for distinct claims.
    chosen = judged.withColumn("_place", F.row_number().over(reading)).groupBy(*keys).agg(
        F.count_if(counts).alias("n_considered"), F.count_if(~usable).alias("n_excluded"), (F.min(claim) == F.max(claim)).alias("agreed"), first.alias("first")
    )
    resolved = F.coalesce("agreed", F.lit(False))
    return chosen.select(
        *keys,
        F.when(resolved, "resolved").when(F.col("n_considered") > 0, "conflicting").otherwise("unresolved").alias("status"),
        *(F.when(resolved, F.col(f"first.{c}")).alias(c) for c in ("fact_id", "numeric_value", "unit")),
        "n_considered",
        "n_excluded",
    )


#: Kinds of facts that have a magnitude; only these can agree or disagree.
COMPARED_KINDS = ("money", "quantity", "percentage", "duration")


def agreement(facts: DataFrame, retractions: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per fact type: pass if the documents that state it agree in number, fail if not, inconclusive if it cannot be compared.

    Facts of work items and withdrawn facts are left out, and of each document only the
    newest reading counts.  A type is compared if two documents state it, all as numbers.
    """
    own = facts.filter("work_item_id IS NULL").join(retractions.select("fact_id"), "fact_id", "left_anti")
    current = newest(own, [*group, "fact_type", "document_id"], [F.col("extractor_version")], [F.col("fact_id")])
    comparable = (F.count(F.lit(1)) > 1) & F.every(F.col("kind").isin(*COMPARED_KINDS) & F.col("numeric_value").isNotNull())
    agreed = F.min("numeric_value") == F.max("numeric_value")
    return current.groupBy(*group, "fact_type").agg(F.when(~comparable, "inconclusive").when(agreed, "pass").otherwise("fail").alias("outcome"))


def overall(agreements: DataFrame, group: Sequence[str]) -> DataFrame:
    """Any disagreement fails the group; with nothing comparable it is inconclusive."""
    counts = agreements.groupBy(*group).agg(F.count_if(F.col("outcome") == "fail").alias("n_fail"), F.count_if(F.col("outcome") == "pass").alias("n_pass"))
    return counts.withColumn("outcome", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_pass") > 0, "pass").otherwise("inconclusive"))
