"""Counters of crawl jobs as a stream: what was read, stored, held before, failed or set aside, and whether a job is at its limits.

The counters are the stream's state, so a job goes on from its checkpoint wherever it was
stopped.  Sums are made in part before they are shuffled, so a job with most of the outcomes
sends a row from each task and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "job_id bigint, outcome string, at timestamp"
#: Outcomes, and the counters that they add to.
COUNTERS = {"page": "pages_read", "stored": "documents_stored", "duplicate": "documents_duplicate", "failed": "documents_failed", "quarantined": "documents_quarantined"}


def counted(outcomes: DataFrame) -> DataFrame:
    """(job_id, counters, started_at, last_at); the same on a table and on a stream.  Other outcomes count nowhere; rows without a job are one job."""
    tallies = (F.count_if(F.col("outcome") == kind).alias(name) for kind, name in COUNTERS.items())
    return outcomes.groupBy("job_id").agg(*tallies, F.min("at").alias("started_at"), F.max("at").alias("last_at"))


def resumed(spark: SparkSession, folder: str, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Counts what is new in the folder (Parquet files of :data:`OUTCOME`) since the last run with this path, and returns the counters.

    A batch writes the jobs that it changed under its own number: done again, it writes the same.
    Before anything has come there are no jobs.
    """
    counted(spark.createDataFrame([], OUTCOME)).write.mode("overwrite").parquet(f"{path}/changed/batch=none")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changed/batch=b{n:012d}")

    found = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    writer = counted(found).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return current(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The counters of every job; they only grow, so the largest are the last."""
    changed = spark.read.parquet(f"{path}/changed")
    return changed.groupBy("job_id").agg(*(F.max(c).alias(c) for c in COUNTERS.values()), F.min("started_at").alias("started_at"), F.max("last_at").alias("last_at"))


def stop_reason(max_seconds: Column, max_documents: Column, max_pages: Column) -> Column:
    """Why a job may not go on, by its counters over all runs: time first, then documents tried, then pages; a limit that is null never holds."""
    tried = sum((F.col(c) for c in COUNTERS.values() if c != "pages_read"), F.lit(0))
    elapsed = F.unix_seconds("last_at") - F.unix_seconds("started_at")
    return F.when(elapsed >= max_seconds, "time limit").when(tried >= max_documents, "document limit").when(F.col("pages_read") >= max_pages, "page limit")
