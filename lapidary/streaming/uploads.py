"""Uploads as a stream into a log of events, and the documents that follow from it.

Each upload becomes one event, also one that is refused, with the reason.  The log is a file
sink with its own checkpoint, so an event is there once however often the stream is stopped
and started.  Documents are never written by the stream: they are what the log says.  A
content is one document; when a later upload declares another type, that is a second
event and the document's type is the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions import text as T
from lapidary.sources import objects

UPLOAD = "upload_id bigint, project string, filename string, content binary, declared_type string, uploaded_at timestamp"


def judged(uploads: DataFrame, source: str) -> DataFrame:
    """uploads (:data:`UPLOAD`) without their contents, with digest, key, size, format, a type suggested by the name, and why one is refused."""
    files = uploads.select(F.struct("upload_id", "project", "filename", "declared_type", "uploaded_at").alias("upload"), F.col("filename").alias("path"), F.octet_length("content").cast("bigint").alias("length"), "content")
    kept = objects.judged(files, source)
    suggested: Column = T.file_type(F.col("upload.filename"))["type"]
    return kept.select("upload.*", "sha256", "key", "length", "file_format", suggested.alias("suggested_type"), "refused")


def ingest(spark: SparkSession, folder: str, log: str, checkpoint: str, source: str = "upload") -> DataFrame:
    """Reads what is new in the folder (Parquet files of :data:`UPLOAD`) into the log, and returns the log."""
    uploads = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1000).parquet(folder)
    query = judged(uploads, source).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(log)


def documents(events: DataFrame) -> DataFrame:
    """(sha256, key, document_type, n_events, n_types, first_upload): one row for each content that was accepted.

    The last declared type counts; without any, the last that a name suggested.
    """
    accepted = events.filter("refused IS NULL")
    when = F.struct("uploaded_at", "upload_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), when))
    return accepted.groupBy("sha256").agg(
        F.min("key").alias("key"), F.coalesce(last("declared_type"), last("suggested_type"), F.lit("unclassified")).alias("document_type"),
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("declared_type").alias("n_types"), F.min_by("upload_id", when).alias("first_upload"),
    )


def memberships(events: DataFrame) -> DataFrame:
    """(project, sha256): every project that a document was uploaded to."""
    return events.filter("refused IS NULL AND project IS NOT NULL").select("project", "sha256").distinct()
