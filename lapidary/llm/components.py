"""Connected components of a graph of edges, by spreading the least label and halving paths.

Nothing is collected: each round is a join and an aggregation, and its labels are written
to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import dealt_join, hot_keys, written

MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the least vertex of its component.

    Vertices with a large share of the edges are sent to them instead of meeting them in one
    task.  Paths halve in each round; more than MOST_ROUNDS rounds are an error.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    degrees = both.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    hot = written(hot_keys(degrees, "v", "n"), "hubs")
    out = both.select("a", F.col("b").alias("v"))
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(MOST_ROUNDS):
        near = dealt_join(out, labels, "v", hot).groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "v", "left").select("v", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        spread = written(spread, "spread")
        above = labels.select(F.col("v").alias("root"), F.col("root").alias("above"))
        jumped = dealt_join(spread, above, "root", hot.withColumnRenamed("v", "root"), "left").select("v", "was", F.least("root", "above").alias("root"))
        labels = written(jumped, "labels")
        if not labels.filter("root < was").limit(1).count():
            return labels.select("v", "root")
        labels = labels.select("v", "root")
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
