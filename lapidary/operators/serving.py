"""What clients are shown: findings with their evidence and review, attempts as JSON, ids of contents, and stamped methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions import net

#: The texts of a piece of evidence; what an origin does not have is null.
EVIDENCE = ("role", "origin", "id", "fact_type", "literal", "page", "snippet", "value", "expression", "document_id", "cell", "clause", "authority", "band")


def column_letters(column: Column) -> Column:
    """1 is A, 26 Z, 27 AA; null for numbers that three letters do not reach."""
    n = column.cast("int") - 1
    letter = lambda x: F.char(F.lit(65) + x)
    one, two, three = letter(n % 26), letter(F.floor((n - 26) / 26) % 26), letter(F.floor((n - 702) / 676))
    return F.when((n >= 0) & (n < 26), one).when((n >= 26) & (n < 702), F.concat(two, one)).when((n >= 702) & (n < 18278), F.concat(three, letter(F.floor((n - 702) / 26) % 26), one))


def cell(sheet: Column, row: Column, column: Column) -> Column:
    """Sheet!B7; null for what was not read from a cell of a named sheet."""
    return F.concat(sheet, F.lit("!"), column_letters(column), row.cast("string"))


def band(low: Column, high: Column) -> Column:
    """The range of a provision in words, for amounts of two places."""
    shown = lambda c: F.format_number(c, 2)
    both = F.concat(shown(low), F.lit(" to "), shown(high))
    return F.coalesce(both, F.concat(F.lit("up to "), shown(high)), F.concat(F.lit("above "), shown(low)), F.lit("all values"))


def evidence(links: DataFrame, facts: DataFrame, derived: DataFrame, provisions: DataFrame) -> DataFrame:
    """(finding_id, piece): what each link cites, as EVIDENCE; a link to what is not there gives none.

    A link counts by the first of fact_id, derived_fact_id and provision_id that it has.  The ids
    of facts, derived values and provisions are unique.
    """
    first = F.when(F.col("fact_id").isNotNull(), "fact").when(F.col("derived_fact_id").isNotNull(), "derived").when(F.col("provision_id").isNotNull(), "provision")
    kinds = links.withColumn("_kind", first)

    def pieces(kind: str, key: str, rows: DataFrame, origin: str, **shown: Column) -> DataFrame:
        cited = kinds.filter(F.col("_kind") == kind).select("finding_id", "role", key)
        known = rows.filter(F.col(key).isNotNull()).select(key, *(c.cast("string").alias(f"_{name}") for name, c in shown.items()))
        has = {"role": F.col("role"), "origin": F.lit(origin), "id": F.col(key)} | {name: F.col(f"_{name}") for name in shown}
        piece = F.struct(*(has.get(name, F.lit(None)).cast("string").alias(name) for name in EVIDENCE))
        return cited.join(known, key).select("finding_id", piece.alias("piece"))

    c = F.col
    place = {"page": c("page"), "snippet": c("snippet"), "document_id": c("document_id")}
    of_facts = pieces("fact", "fact_id", facts, "extracted", fact_type=c("fact_type"), literal=c("literal"), value=c("numeric_value"), cell=cell(c("sheet_name"), c("sheet_row"), c("sheet_column")), **place)
    made = F.concat("calculation", F.lit(" v"), "calculation_version")
    of_values = pieces("derived", "derived_fact_id", derived, "derived", fact_type=c("fact_type"), literal=made, value=c("numeric_value"), expression=c("expression"))
    clause = F.concat(F.lit("clause "), "clause")
    of_clauses = pieces(
        "provision", "provision_id", provisions, "policy", fact_type=c("provision_type"), literal=clause, value=c("share"), clause=c("clause"), authority=c("authority"), band=band(c("applies_from"), c("applies_to_max")), **place
    )
    return of_facts.unionByName(of_values).unionByName(of_clauses)


def served(findings: DataFrame, pieces: DataFrame, reviewed: DataFrame) -> DataFrame:
    """findings with scope, evidence by role (then by the other texts), review_state and needs_human_review.

    findings: finding_id, document_id, project_id, work_item_id and more.  reviewed: finding_id, and
    decision of the newest review of the conclusion as it stands.  A finding cites what its rule
    names, so its evidence fits a row.
    """
    listed = pieces.groupBy("finding_id").agg(F.array_sort(F.collect_list("piece")).alias("evidence"))
    joined = findings.join(listed, "finding_id", "left").join(reviewed.select("finding_id", F.col("decision").alias("_decision")), "finding_id", "left")
    about = F.when(F.col("work_item_id").isNotNull(), "work_item").when(F.col("document_id").isNotNull(), "document").otherwise("project")
    waits = F.coalesce(F.col("outcome").isin("fail", "review"), F.lit(False)) & F.col("_decision").isNull()
    none = F.array().cast(listed.schema["evidence"].dataType)
    return joined.select(*findings.columns, about.alias("scope"), F.coalesce("evidence", none).alias("evidence"), F.coalesce("_decision", F.lit("unreviewed")).alias("review_state"), waits.alias("needs_human_review"))


#: The members of an attempt, in order; bodies of responses are none of them.
ATTEMPT = ("attempt", "outcome", "duration_ms", "status_code", "error_type", "retry_after_seconds", "delay_before_next_seconds", "reason")


def attempts_json(attempts: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, attempts, attempt_count): the attempts of each fetch as JSON, by number; a fetch without a history counts one.

    Durations have three places.  A row whose attempt is null stands for a fetch without a history.
    A fetch tries a few times, so its attempts fit a row.
    """
    shown = attempts.withColumn("duration_ms", F.bround(F.col("duration_ms").cast("decimal(20,6)"), 3).cast("double"))
    made = shown.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("attempt").isNotNull(), F.struct(*ATTEMPT)))).alias("made"))
    body = F.when(F.size("made") > 0, F.to_json("made", {"ignoreNullFields": "false"})).otherwise("[]")
    return made.select(*key, body.alias("attempts"), F.greatest(F.size("made"), F.lit(1)).alias("attempt_count"))


def document_id(digest: Column) -> Column:
    """The name-based id (version 5) of a content, from its digest; null for what is no lower-case SHA-256 digest."""
    h = F.sha1(F.concat(F.unhex(F.lit(net.NAMESPACE.hex)), digest.cast("binary")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    made = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
    return F.when(digest.rlike("^[0-9a-f]{64}\\z"), made)


def stamped(method: Column, transcription: Column) -> Column:
    """The method of a value read by a transcription names that first; other methods stay as they are."""
    return F.when(transcription.isNull(), method).otherwise(F.concat(transcription, F.lit(" | "), method))
