"""Findings as they are shown: evidence flattened, decimals as text, and traced to their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope(project_id: Column, work_item_id: Column) -> Column:
    return F.when(work_item_id.isNotNull(), "work_item").when(project_id.isNotNull(), "project").otherwise("document")


def evidence_resolved(links: DataFrame, facts: DataFrame, derived: DataFrame, provisions: DataFrame) -> DataFrame:
    """(finding_id, role, kind, id, value, document_id): each link with the one of three kinds that it names."""
    parts = []
    for kind, rows, key in (("fact", facts, "fact_id"), ("derived", derived, "derived_fact_id"), ("provision", provisions, "provision_id")):
        own = links.filter(F.col(key).isNotNull()).select("finding_id", "role", key)
        parts.append(own.join(rows, key, "left").select("finding_id", "role", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("value").cast("string").alias("value"), "document_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def breaks(resolved: DataFrame, documents: DataFrame, origins: DataFrame) -> DataFrame:
    """Links whose chain ends before a document with an origin, with where it ends; :func:`trail_breaks` follows derived values too."""
    known = documents.select("document_id", F.lit(True).alias("_document"))
    placed = origins.select("document_id").distinct().withColumn("_origin", F.lit(True))
    joined = resolved.filter("kind <> 'derived'").join(known, "document_id", "left").join(placed, "document_id", "left")
    why = F.when(F.col("document_id").isNull(), "no fact").when(F.col("_document").isNull(), "no document").when(F.col("_origin").isNull(), "no provenance")
    return joined.withColumn("break_kind", why).filter("break_kind IS NOT NULL").drop("_document", "_origin")


#: Outcomes that assert something, so that their evidence must hold.
CONCLUSIVE = ("pass", "fail", "review")


def trail_breaks(
    findings: DataFrame, links: DataFrame, derived: DataFrame, inputs: DataFrame, facts: DataFrame, provisions: DataFrame, documents: DataFrame, origins: DataFrame, sound: DataFrame
) -> DataFrame:
    """(finding_id, break_kind, trail, fatal): where the way from a finding to the bytes of a document ends early, each place once.

    findings: finding_id, outcome.  links: finding_id and one of fact_id, derived_fact_id and
    provision_id (of several, a provision counts before a fact, that before a derived value).
    derived: derived_fact_id.  inputs: derived_fact_id and a fact_id or provision_id.  facts:
    fact_id, document_id, retracted.  provisions: provision_id, document_id.  documents,
    origins, sound: document_id, of those that are known, that came from somewhere, whose bytes are in the store.

    A fact or a provision is judged once, however many findings rest on it; the ids that they are
    met by are unique on that side.  A break is fatal where the finding asserts something.
    """
    flag = lambda rows, name: rows.select("document_id").filter("document_id IS NOT NULL").distinct().withColumn(name, F.lit(True))
    states = flag(documents, "_known").join(flag(origins, "_placed"), "document_id", "left").join(flag(sound, "_sound"), "document_id", "left")
    lost = F.when(F.col("_known").isNull(), "no document")
    torn = F.col("_sound").isNull()
    each_fact = facts.groupBy("fact_id").agg(F.min("document_id").alias("document_id"), F.bool_or("retracted").alias("retracted"))
    why_fact = F.when(F.col("retracted"), "retracted fact").otherwise(F.coalesce(lost, F.when(F.col("_placed").isNull(), "no provenance").when(torn, "no artifact")))
    each_provision = provisions.groupBy("provision_id").agg(F.min("document_id").alias("document_id"))
    judged = {
        "fact": each_fact.join(states, "document_id", "left").select("fact_id", "document_id", why_fact.alias("why"), F.lit(True).alias("_there")),
        "provision": each_provision.join(states, "document_id", "left").select("provision_id", "document_id", F.coalesce(lost, F.when(torn, "no artifact")).alias("why"), F.lit(True).alias("_there")),
    }
    step = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    cited = links.join(findings.select("finding_id"), "finding_id", "left_semi").select("finding_id", "fact_id", "derived_fact_id", "provision_id").distinct()
    through = cited.filter("derived_fact_id IS NOT NULL AND fact_id IS NULL AND provision_id IS NULL").select("finding_id", "derived_fact_id")
    values = derived.select("derived_fact_id").filter("derived_fact_id IS NOT NULL").distinct()
    used = inputs.filter("fact_id IS NOT NULL OR provision_id IS NOT NULL").select("derived_fact_id", "fact_id", "provision_id").distinct()
    there = through.join(values, "derived_fact_id", "left_semi")
    named = lambda rows, kind, trail: rows.select("finding_id", F.lit(kind).alias("break_kind"), trail.alias("trail"))
    of_value = step("derived", "derived_fact_id")
    found = [
        named(findings.join(links, "finding_id", "left_anti"), "no evidence", F.lit("")),
        named(cited.filter("fact_id IS NULL AND derived_fact_id IS NULL AND provision_id IS NULL"), "cites nothing", F.lit("")),
        named(through.join(values, "derived_fact_id", "left_anti"), "missing derived value", of_value),
        named(there.join(used, "derived_fact_id", "left_anti"), "no inputs", of_value),
    ]
    inner = there.join(used, "derived_fact_id").select("finding_id", F.concat(of_value, F.lit(">")).alias("head"), "fact_id", "provision_id")
    direct = cited.select("finding_id", F.lit("").alias("head"), F.when(F.col("provision_id").isNull(), F.col("fact_id")).alias("fact_id"), "provision_id")
    leaves = direct.unionByName(inner)
    for kind, rows in judged.items():
        key = f"{kind}_id"
        met = leaves.filter(F.col(key).isNotNull()).select("finding_id", "head", key).join(rows, key, "left")
        why = F.when(F.col("_there").isNull(), f"missing {kind}").otherwise(F.col("why"))
        document = F.when(F.col("document_id").isNotNull() & ~F.coalesce(F.col("why") == "retracted fact", F.lit(False)), F.concat(F.lit(">"), step("document", "document_id"))).otherwise("")
        found.append(met.select("finding_id", why.alias("break_kind"), F.concat("head", step(kind, key), document).alias("trail")).filter("break_kind IS NOT NULL"))
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    return every.distinct().join(findings.select("finding_id", F.coalesce(F.col("outcome").isin(*CONCLUSIVE), F.lit(False)).alias("fatal")), "finding_id")


def untraced(findings: DataFrame, links: DataFrame) -> DataFrame:
    """Verdicts without any evidence; only an inconclusive one may stand alone."""
    return findings.filter("outcome <> 'inconclusive'").join(links.select("finding_id"), "finding_id", "left_anti")


def serialised(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """(finding_id, json): a finding with its scope and its evidence in order; absent values are shown as such."""
    shown = resolved.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("role", "kind", "id", "value", "document_id"))).alias("evidence"))
    joined = findings.join(shown, "finding_id", "left")
    body = F.struct("finding_id", "rule_id", "outcome", scope(F.col("project_id"), F.col("work_item_id")).alias("scope"), F.coalesce("evidence", F.array()).alias("evidence"))
    return joined.select("finding_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def project_facts(members: DataFrame, documents: DataFrame, facts: DataFrame, retractions: DataFrame) -> DataFrame:
    """(project_id, ...): the facts of every project's documents, withdrawn ones left out; a document that is in several projects counts in each."""
    own = members.select("project_id", "document_id").distinct()
    kept = facts.drop("project_id").join(retractions.select("fact_id"), "fact_id", "left_anti")
    return kept.join(documents, "document_id").join(own, "document_id")


def share_consistency(shares: DataFrame) -> DataFrame:
    """Per project: fewer than two shares are inconclusive, equal ones pass, others fail."""
    counts = shares.groupBy("project_id").agg(F.count("share").alias("n"), F.count_distinct("share").alias("n_shares"))
    return counts.select("project_id", F.when(F.col("n") < 2, "inconclusive").when(F.col("n_shares") == 1, "pass").otherwise("fail").alias("outcome"))


def against_estimate(total: Column, estimate: Column) -> Column:
    """What a bill differs from its estimate by; no verdict, as an estimate binds nobody.  The percentage is for show: four places, and null unless the estimate is above zero."""
    gap = total - estimate
    percent = F.when(estimate > 0, F.round(F.try_divide(gap * 100, estimate), 4))
    return F.struct(F.lit("inconclusive").alias("outcome"), gap.alias("difference"), percent.alias("percent"))
