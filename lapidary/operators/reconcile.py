"""From selected facts of work items to variances and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.operators import calc, rules

QUANTITIES = ("contracted_quantity", "measured_quantity", "cumulative_claim", "previous_certified")
RATES = ("contract_rate", "claimed_rate")


def wide(selected: DataFrame, subject: Sequence[str]) -> DataFrame:
    """One row for each work item: value, unit and conflict of each type, and how many types resolved or conflict."""
    own = lambda t, c: F.max(F.when(F.col("fact_type") == t, F.col(c)))
    disputed = lambda t: F.coalesce(F.bool_or((F.col("fact_type") == t) & (F.col("status") == "conflicting")), F.lit(False))
    return selected.groupBy(*subject).agg(
        *(own(t, "numeric_value").alias(t) for t in QUANTITIES + RATES),
        *(own(t, "unit").alias(f"{t}_unit") for t in QUANTITIES),
        *(disputed(t).alias(f"{t}_disputed") for t in QUANTITIES + RATES),
        F.count_if(F.col("status") == "conflicting").alias("n_conflicting"),
        F.count_if(F.col("status") == "resolved").alias("n_resolved"),
    )


def calculated(items: DataFrame) -> DataFrame:
    """The derived values of each work item: quantities are only compared in one unit, rates are as they stand."""
    pair = lambda a, b: calc.difference(F.col(a), F.col(b), F.col(f"{a}_unit"), F.col(f"{b}_unit"))
    variance = pair("cumulative_claim", "measured_quantity")
    return items.select(
        "*",
        variance.alias("quantity_variance"),
        F.when(variance.isNotNull(), calc.either_unit(F.col("cumulative_claim_unit"), F.col("measured_quantity_unit"))).alias("variance_unit"),
        pair("contracted_quantity", "cumulative_claim").alias("remaining_contract_quantity"),
        calc.difference(F.col("claimed_rate"), F.col("contract_rate")).alias("rate_variance"),
        calc.exposure(variance, F.col("contract_rate")).alias("unsupported_amount"),
    )


def findings(items: DataFrame, subject: Sequence[str]) -> DataFrame:
    return rules.evaluate(calculated(items), [*subject], rules.ITEM_RULES)
