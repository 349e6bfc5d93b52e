"""Joins by containment in bands whose open ends are null and whose bounds are both inclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(value: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))


#: Bands that may be sent to every task.
SENT_BANDS = 10_000
#: Parts of the range of bounds in which many bands are looked for.
PARTS = 64


def band_join(rows: DataFrame, value: str, bands: DataFrame, low: str, high: str, on: Sequence[str] = (), sent: int = SENT_BANDS) -> DataFrame:
    """Every pair of a row and a band that holds its value; rows without a band keep nulls.

    Few bands are broadcast after a count.  Else each value falls in one part of the range of
    bounds and each band in all parts that it meets, and they meet there, and on the keys; the
    bands are then shuffled, however small the files are that they come from.
    """
    few = bands.limit(sent + 1).count() <= sent
    if few:
        side, own, parts = F.broadcast(bands), rows, []
    else:
        bounds = bands.select(F.explode(F.array(F.col(low).cast("double"), F.col(high).cast("double"))).alias("b")).filter("b IS NOT NULL")
        found = bounds.approxQuantile("b", [i / PARTS for i in range(1, PARTS)], 1 / PARTS / 4)
        edges = F.array(*(F.lit(x).cast("double") for x in sorted(set(found))))
        part = lambda c, none: F.when(c.isNull(), none).otherwise(F.size(F.filter(edges, lambda e: e <= c.cast("double"))))
        first, last = part(F.col(low), F.lit(0)), part(F.col(high), F.size(edges))
        side = bands.withColumn("_part", F.explode(F.sequence(first, F.greatest(first, last)))).hint("merge")
        own, parts = rows.withColumn("_part", part(F.col(value), F.lit(0))), ["_part"]
    match = within(own[value], side[low], side[high])
    for key in [*on, *parts]:
        match = match & (own[key] == side[key])
    return own.join(side, match, "left").drop(*(side[key] for key in on), *parts)


def applicable(rows: DataFrame, key: Sequence[str], value: str, bands: DataFrame, low: str, high: str, band: str, on: Sequence[str] = ()) -> DataFrame:
    """One row for each key: how many bands hold its value, and which one if exactly one does."""
    joined = band_join(rows, value, bands, low, high, on).groupBy(*key).agg(F.count(band).alias("n_bands"), F.min(band).alias("_band"))
    verdict = F.when(F.col("n_bands") == 1, "applicable").when(F.col("n_bands") == 0, "no provision").otherwise("ambiguous")
    return joined.select(*key, "n_bands", F.when(F.col("n_bands") == 1, F.col("_band")).alias("band"), verdict.alias("verdict"))
