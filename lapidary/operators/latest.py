"""Newest row for each key, with ties settled by a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: Sequence[str], version: Sequence[Column], tie: Sequence[Column]) -> DataFrame:
    """The row of each key with the highest version; of equals, the first in the order of ``tie``.

    A null key is a key of its own.
    """
    order = [*(c.desc_nulls_last() for c in version), *tie]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def newest_value(rows: DataFrame, keys: Sequence[str], value: Column, order: Column, name: str) -> DataFrame:
    """One aggregate instead of a window where a single value is wanted: order must be total."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def latest_with_ties(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Every row whose time is the latest of its key, with the number of rows of the key; equal times stay together."""
    last = rows.groupBy(key).agg(F.max(at).alias(at), F.count(F.lit(1)).alias("n_rows"))
    return rows.join(last, [key, at])


def best_ranked(rows: DataFrame, key: str, rank: Column, tie: Sequence[Column]) -> DataFrame:
    """The row of each key whose rank is the lowest."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank.asc(), *tie))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def carried_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to and including the row."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], starts: Column, name: str) -> DataFrame:
    """Numbers the blocks that begin where ``starts`` holds; rows before the first are in block 0."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(upto))


def strict_sequence(rows: DataFrame, keys: Sequence[str], order: Column, number: str) -> DataFrame:
    """Per key, how far the numbers go 1, 2, 3, ... when those that do not come next are passed over.

    Numbers of a key are folded in order; a number is accepted only if it is the next one.
    """
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(number).alias("n")))).alias("_seen"))
    fold = F.aggregate("_seen", F.lit(0).cast("long"), lambda last, x: F.when(x["n"] == last + 1, last + 1).otherwise(last))
    return listed.select(*keys, F.size("_seen").cast("long").alias("n_rows"), fold.alias("accepted"))
