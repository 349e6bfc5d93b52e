"""Derived values in exact decimals: a missing or unusable input gives null, never a guess."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions import text as T

STORED = "decimal(28,10)"


def stored(value: Column) -> Column:
    """As derived values are kept: ten places, half to even."""
    return F.bround(value, 10).cast(STORED)


def share(part: Column, whole: Column) -> Column:
    """part / whole; null unless whole is above zero."""
    return F.when(whole > 0, F.try_divide(part.cast("decimal(20,2)"), whole.cast("decimal(20,2)")))


def required_amount(cost: Column, rate: Column, cap: Column) -> Column:
    """rate of cost, but no more than a cap if there is one."""
    plain = cost.cast("decimal(20,2)") * rate.cast("decimal(12,8)")
    return F.when(cap.isNotNull() & (plain > cap), cap).otherwise(plain)


def same_unit(left: Column, right: Column) -> Column:
    """Units agree, or one is not stated."""
    return F.coalesce(F.lower(F.trim(left)) == F.lower(F.trim(right)), F.lit(True))


def either_unit(left: Column, right: Column) -> Column:
    """The unit of a comparable pair, as the first document that states one wrote it."""
    return F.coalesce(left, right)


def difference(left: Column, right: Column, left_unit: Column | None = None, right_unit: Column | None = None) -> Column:
    """left - right; null where units are stated and differ."""
    value = left - right
    return value if left_unit is None or right_unit is None else F.when(same_unit(left_unit, right_unit), value)


def exposure(variance: Column, rate: Column) -> Column:
    """What a claim above the measured quantity costs; a claim below it costs nothing."""
    return F.when(variance.isNotNull(), F.greatest(variance, F.lit(0)) * rate)


def places(literal: Column) -> Column:
    """Decimal places as printed."""
    return F.length(F.regexp_extract(literal, r"\.([0-9]+)\)?$", 1))


def half_unit(literal: Column) -> Column:
    """Half of the last printed place; beyond nine places it is too small to matter."""
    return F.concat(F.lit("0."), F.repeat(F.lit("0"), F.least(places(literal), F.lit(9))), F.lit("5")).cast("decimal(12,10)")


def figure(literal: Column) -> Column:
    """struct(value, half): a printed figure, and half of its last printed place."""
    return F.struct(T.accounting_number(literal, "decimal(18,6)").alias("value"), half_unit(literal).alias("half"))


def consistency(quantity: Column, rate: Column, amount: Column) -> Column:
    """exact, consistent_with_display_rounding or review, from three figures.

    A rate and an amount stand for all values that print alike; the quantity is what it says.
    """
    q, r, a = quantity["value"].cast("decimal(16,4)"), rate["value"], amount["value"]
    ends = [q * (r + sign * rate["half"]).cast("decimal(20,10)") for sign in (-1, 1)]
    meets = (F.least(*ends) <= a + amount["half"]) & (F.greatest(*ends) >= a - amount["half"])
    return F.when(q * r == a, "exact").when(meets, "consistent_with_display_rounding").when(meets.isNotNull(), "review")


def implied_rate(quantity: Column, amount: Column) -> Column:
    """amount / quantity at ten places, half to even; null without a quantity."""
    q, a = T.accounting_number(quantity, "decimal(12,4)"), T.accounting_number(amount, "decimal(20,4)")
    return F.when(q != 0, F.bround(F.try_divide(a, q), 10).cast(STORED))


def row_arithmetic(frame: DataFrame, quantity: str, rate: str, amount: str) -> DataFrame:
    """frame with consistency and implied_rate of its printed rows (the columns are literals)."""
    names = ("_quantity", "_rate", "_amount")
    read = frame.withColumns({n: figure(F.col(c)) for n, c in zip(names, (quantity, rate, amount), strict=True)})
    read = read.withColumns({"consistency": consistency(*map(F.col, names)), "implied_rate": implied_rate(F.col(quantity), F.col(amount))})
    return read.drop(*names)


def line_sum(rows: DataFrame, key: Sequence[str], amount: Column, order: Sequence[Column], places_shown: int = 2) -> DataFrame:
    """Exact sum of the lines of each key with the sum written out in order."""
    shown = F.transform(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), amount.alias("v")))), lambda x: x["v"].cast(f"decimal(20,{places_shown})").cast("string"))
    return rows.groupBy(*key).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n_lines"), F.array_join(shown, " + ").alias("expression"))
