"""Rules: each ends in pass, fail, review or inconclusive, and says what it expected and saw."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rules: tolerances in money, and in fractions of the whole.
MONEY_TOLERANCE = "1.00"
SHARE_TOLERANCE = "0.001"


def money(value: Column) -> Column:
    return value.cast("decimal(20,2)")


def within_tolerance(stated: Column, required: Column, tolerance: str, otherwise: str) -> Column:
    """pass or ``otherwise`` by distance; inconclusive where one of them is missing."""
    gap = F.abs(stated - required)
    return F.when(gap.isNull(), "inconclusive").when(gap <= F.lit(tolerance).cast("decimal(20,8)"), "pass").otherwise(otherwise)


def share_of_cost(stated_share: Column, required_share: Column) -> Column:
    return within_tolerance(stated_share, required_share, SHARE_TOLERANCE, "fail")


def stated_security(stated: Column, required: Column) -> Column:
    return within_tolerance(stated, required, MONEY_TOLERANCE, "fail")


def bill_total(total: Column, stated: Column, refused_rows: Column) -> Column:
    return F.when(refused_rows > 0, "inconclusive").otherwise(within_tolerance(total, stated, MONEY_TOLERANCE, "review"))


def unambiguous(n_conflicting: Column, n_resolved: Column) -> Column:
    return F.when(n_conflicting > 0, "review").when(n_resolved > 0, "pass").otherwise("inconclusive")


def judged(disputed: Column, gap: Column, fine: Column) -> Column:
    """review where the rule's own facts are in conflict, inconclusive where one is missing, else by the test."""
    return F.when(disputed, "review").when(gap.isNull(), "inconclusive").when(fine, "pass").otherwise("review")


def disputed(*types: str) -> Column:
    """Is one of these types in conflict?  Conflicts of other types are no concern of a rule."""
    return reduce(or_, (F.col(f"{t}_disputed") for t in types))


def claim_within_measured() -> Column:
    variance = F.col("quantity_variance")
    return judged(disputed("cumulative_claim", "measured_quantity"), variance, variance <= 0)


def rate_matches() -> Column:
    variance = F.col("rate_variance")
    return judged(disputed("claimed_rate", "contract_rate"), variance, variance == 0)


def not_below_previous() -> Column:
    gap = F.col("cumulative_claim") - F.col("previous_certified")
    return judged(disputed("cumulative_claim", "previous_certified"), gap, gap >= 0)


def against_estimate() -> Column:
    """An estimate binds nobody: the difference is shown and never judged."""
    return F.lit("inconclusive")


#: Rules by scope; each takes the scope's wide rows and gives an outcome.
DOCUMENT_RULES: dict[str, Callable[[], Column]] = {
    "bid_security_matches_reference_policy": lambda: stated_security(F.col("bid_security"), F.col("required_security")),
    "bid_security_share_of_estimated_cost": lambda: share_of_cost(F.col("bid_security_share"), F.col("prescribed_share")),
    "bill_items_reconcile_to_stated_total": lambda: bill_total(F.col("bill_total"), F.col("stated_total"), F.col("refused_rows")),
    "priced_bill_matches_advertised_estimate": against_estimate,
}
ITEM_RULES: dict[str, Callable[[], Column]] = {
    "claim_within_measured_quantity": claim_within_measured,
    "claimed_rate_matches_contract_rate": rate_matches,
    "cumulative_claim_not_below_previous_certified": not_below_previous,
    "work_item_evidence_unambiguous": lambda: unambiguous(F.col("n_conflicting"), F.col("n_resolved")),
}


def evaluate(rows: DataFrame, key: list[str], rules: dict[str, Callable[[], Column]]) -> DataFrame:
    """(key, rule_id, outcome): every rule over every row, in one pass, in the order of rule ids."""
    made = F.array(*(F.struct(F.lit(name).alias("rule_id"), rule().alias("outcome")) for name, rule in sorted(rules.items())))
    return rows.select(*key, F.explode(made).alias("r")).select(*key, "r.rule_id", "r.outcome")
