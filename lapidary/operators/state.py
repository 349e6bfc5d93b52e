"""Changes as appends: new versions, withdrawals and reviews are rows, and nothing is overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.operators import calc

#: The states that may follow each state of a document.
TRANSITIONS = {
    "discovered": ["downloading", "failed"],
    "downloading": ["downloaded", "failed", "quarantined"],
    "downloaded": ["validated", "failed", "quarantined"],
    "validated": ["processing", "failed"],
    "processing": ["processed", "failed", "quarantined"],
    "processed": [],
    "failed": ["downloading", "processing"],
    "quarantined": [],
}


def new_rows(rows: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key is not known yet, each key once."""
    return rows.dropDuplicates([*key]).join(known.select(*key), [*key], "left_anti")


def upserted(known: DataFrame, incoming: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Known and incoming rows by key; an incoming row replaces a known one, the last by order wins."""
    both = known.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), order.desc()))
    return both.withColumn("_place", place).filter("_place = 1").drop("_place", "_new")


def allowed_transition(old: Column, new: Column) -> Column:
    """May a document go from one state to the other?"""
    pairs = [f"{a}>{b}" for a, nexts in TRANSITIONS.items() for b in nexts]
    return F.concat(old, F.lit(">"), new).isin(pairs)


def advanced(old: Column, target: Column) -> Column:
    """The state after an advance: what is satisfied already stays, and null is a step that must not be made."""
    through = (old == "downloaded") & (target == "processing")  # validation happened on the way in
    return F.when((old == target) | (old == "processed"), old).when(allowed_transition(old, target) | through, target)


def after_failure(old: Column) -> Column:
    """failed where that is a legal step, else what was: a failed second reading keeps the first."""
    return F.when(allowed_transition(old, F.lit("failed")), "failed").otherwise(old)


def conclusion_fingerprint(rule: Sequence[Column], verdict: Sequence[Column], detail: Column, evidence: Column) -> Column:
    """Digest of what a reviewer sees: rule and version, outcome with what was expected and observed, the rule's numbers and its evidence.

    Canonical JSON: keys in order, nothing between tokens, absent values as null.  detail is
    a map of strings; evidence an array of arrays of strings, in the order of the caller.
    """
    text = lambda columns: F.array(*(c.cast("string") for c in columns))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(detail)))
    body = F.struct(ordered.alias("detail"), evidence.alias("evidence"), text(rule).alias("rule"), text(verdict).alias("verdict"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}).cast("binary"), 256)


def inputs_fingerprint(inputs: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, fingerprint): digest of which facts and provisions fed a calculation, and in which role; inputs: role, fact_id, provision_id."""
    part = F.when(F.col("fact_id").isNotNull(), F.struct(F.lit(0).alias("k"), "role", F.concat("role", F.lit("="), "fact_id").alias("shown")))
    part = part.otherwise(F.struct(F.lit(1).alias("k"), "role", F.concat(F.lit("provision:"), "role", F.lit("="), "provision_id").alias("shown")))
    listed = inputs.groupBy(*key).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return listed.select(*key, F.sha2(F.array_join(F.transform("parts", lambda x: x["shown"]), "|").cast("binary"), 256).alias("fingerprint"))


def withdrawn(facts: DataFrame, retractions: DataFrame, suppressed: DataFrame, reason: str, version: str) -> DataFrame:
    """New rows (fact_id, reason, version) for facts of documents, of any version, whose type is suppressed now and that are not withdrawn yet."""
    own = facts.filter("sheet_row IS NULL").join(suppressed.select("document_id", "fact_type").distinct(), ["document_id", "fact_type"], "left_semi")
    return own.join(retractions.select("fact_id"), "fact_id", "left_anti").select("fact_id", F.lit(reason).alias("reason"), F.lit(version).alias("version"))


#: What a finding is about: a document, a project, or a work item of a project.
FINDING_KEY = ("scope", "scope_id", "rule_id", "rule_version")


def stored_findings(known: DataFrame, incoming: DataFrame, order: Column) -> DataFrame:
    """Findings after a run: one for each scope, rule and version, the incoming one in place of the known one."""
    return upserted(known, incoming, FINDING_KEY, order)


def rebuilt_evidence(known: DataFrame, incoming: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence after a run: what the run's findings cite, and what other findings cited before; all have FINDING_KEY."""
    return known.join(findings.select(*FINDING_KEY).distinct(), [*FINDING_KEY], "left_anti").unionByName(incoming.join(findings.select(*FINDING_KEY).distinct(), [*FINDING_KEY], "left_semi"))


def recorded_reviews(findings: DataFrame, asked: DataFrame) -> DataFrame:
    """New review rows: each captures the conclusion as it stands; asked: finding_id, decision, note, reviewer, asked_at.

    ``refused`` says why one is not recorded: no such finding, or a blank note or reviewer.
    """
    seen = findings.select("finding_id", F.col("fingerprint").alias("reviewed_fingerprint"), F.col("outcome").alias("reviewed_outcome"), F.col("rule_version").alias("reviewed_rule_version"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = F.when(F.col("reviewed_fingerprint").isNull(), "no finding").when(blank("note"), "no note").when(blank("reviewer"), "no reviewer")
    return asked.join(seen, "finding_id", "left").withColumns({"refused": why, "reviewer": F.trim("reviewer")})


def confirmed_types(documents: DataFrame, confirmations: DataFrame) -> DataFrame:
    """documents with the type that a named person confirmed last; what was suggested stays as it was."""
    named = confirmations.filter(F.coalesce(F.trim("confirmed_by"), F.lit("")) != "")
    last = named.groupBy("document_id").agg(F.max_by("document_type", F.struct("confirmed_at", "document_type")).alias("confirmed"))
    joined = documents.join(last, "document_id", "left")
    return joined.withColumns({"document_type": F.coalesce("confirmed", "document_type"), "type_authority": F.when(F.col("confirmed").isNotNull(), "human_confirmed").otherwise(F.col("type_authority"))}).drop("confirmed")


def current_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """findings with the newest review of the conclusion as it stands now; older conclusions' reviews are stale."""
    fit = reviews.join(findings.select("finding_id", "fingerprint", "outcome", "rule_version"), "finding_id")
    fit = fit.filter("reviewed_fingerprint = fingerprint AND reviewed_outcome = outcome AND reviewed_rule_version = rule_version")
    last = fit.groupBy("finding_id").agg(F.max_by(F.struct("decision", "reviewer"), F.struct("reviewed_at", "review_id")).alias("review"), F.count(F.lit(1)).alias("n_current"))
    joined = findings.join(last, "finding_id", "left")
    open_ = F.col("outcome").isin("fail", "review") & F.col("review").isNull()
    return joined.select(*findings.columns, F.col("review.decision").alias("decision"), F.coalesce("n_current", F.lit(0)).alias("n_current"), open_.alias("reviewable"))


#: What a stored value is of: a fact by its row, a value derived for a document or a project, a clause of a reference document.
FACT_KEY = ("document_id", "fact_type", "extractor_version", "sheet_row")
DERIVED_KEY = ("document_id", "project_id", "fact_type", "calculation_version")
PROVISION_KEY = ("document_id", "provision_type", "clause", "extractor_version")


def derived_rows(calculated: DataFrame) -> DataFrame:
    """Calculated values as they are stored, by DERIVED_KEY; ``refused`` says why one is not.

    calculated: document_id, project_id (exactly one), work_item, fact_type, calculation_version,
    numeric_value, and inputs, an array of struct(role, fact_id, provision_id).  The type of a
    value of a work item begins with the item, so that items of one project do not meet.  Values
    have ten places.  Inputs stand in their row, facts before provisions and by role, so that a
    value never stands beside another run's inputs; a null array is an empty one.
    """
    ranked = F.transform(F.coalesce("inputs", F.array().cast(calculated.schema["inputs"].dataType)), lambda x: F.struct(x["fact_id"].isNull().alias("p"), x["role"].alias("role"), input_shown(x).alias("shown"), x.alias("input")))
    both = F.col("document_id").isNotNull() == F.col("project_id").isNotNull()
    rows = calculated.withColumns({
        "fact_type": F.concat(F.coalesce(F.concat("work_item", F.lit(":")), F.lit("")), "fact_type"),
        "numeric_value": calc.stored(F.col("numeric_value")),
        "inputs": F.transform(F.array_sort(ranked), lambda x: x["input"]),
        "refused": F.when(both, "exactly one of a document or a project"),
    })
    return rows.withColumn("inputs_fingerprint", listed_fingerprint("inputs")).drop("work_item")


def input_shown(x: Column) -> Column:
    """An input with its role, as a fingerprint has it."""
    role = F.when(x["fact_id"].isNull(), F.concat(F.lit("provision:"), x["role"])).otherwise(x["role"])
    return F.concat(role, F.lit("="), F.coalesce(x["fact_id"], x["provision_id"]))


def listed_fingerprint(inputs: str) -> Column:
    """The fingerprint of a row's inputs in the order of :func:`derived_rows`, so a store of these need not hold it."""
    return F.sha2(F.array_join(F.transform(inputs, input_shown), "|").cast("binary"), 256)
