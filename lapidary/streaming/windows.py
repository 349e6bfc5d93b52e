"""Event streams: windows behind a watermark, sessions, and duplicates by id; the same code runs on tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and exact sums of each window and type; events later than the watermark are left out of closed windows."""
    kept = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = kept.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,2)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events closer than the gap belong together."""
    kept = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = kept.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once, however often it arrives within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(spark: SparkSession, source: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str, path: str) -> DataFrame:
    """Runs a streaming plan over all that has arrived and returns what it holds then.

    A second run with the same path goes on from the checkpoint.  In complete mode the last
    batch is the result, else all batches are.
    """

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n:012d}")

    started = plan(source).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    if mode == "complete":
        out = out.join(out.agg(F.max("batch").alias("batch")), "batch")
    return out.drop("batch")
