"""Content-addressed documents: files in, one row for each different content, write-once keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions import urls


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def raw_key(source: Column, digest: Column, extension: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), source, F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(digest, extension))


def derived_key(kind: Column, digest: Column, name: Column) -> Column:
    """Never under the raw tier."""
    return F.when(kind != "raw", F.concat_ws("/", F.lit("derived"), kind, digest, name))


def judged(found: DataFrame, source: str, most_bytes: int = 256 << 20) -> DataFrame:
    """found (path, length, content, ...) with digest, key, format (declared by the name, or sniffed) and why it is refused, if it is."""
    declared, sniffed = urls.format_of_path(F.col("path")), urls.sniffed(F.col("content"))
    refused = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large")
        .when(declared.isNull() & sniffed.isNull(), "unknown format").when(~urls.compatible(declared, sniffed), "contradiction")
    )
    kind = F.coalesce(declared, sniffed)
    read = found.withColumns({"sha256": F.sha2("content", 256), "file_format": kind, "refused": refused})
    return read.withColumn("key", raw_key(F.lit(source), F.col("sha256"), F.concat(F.lit("."), F.col("file_format"))))


def ingested(found: DataFrame, source: str, most_bytes: int = 256 << 20) -> DataFrame:
    """One row for each file: digest, key, declared and sniffed format, and why it is refused, if it is."""
    return judged(found, source, most_bytes).select("path", "length", "sha256", "file_format", "key", "refused")


def new_documents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Accepted contents that are not stored yet, each once, by its first path."""
    first = rows.filter("refused IS NULL").groupBy("sha256").agg(F.min("path").alias("path"), F.min_by("key", "path").alias("key"), F.min("length").alias("length"), F.min_by("file_format", "path").alias("file_format"))
    return first.join(known.select("sha256"), "sha256", "left_anti")


def conflicts(retrievals: DataFrame, documents: DataFrame) -> DataFrame:
    """Retrievals whose size or format contradicts the document with the same digest."""
    d = documents.select("sha256", F.col("length").alias("known_length"), F.col("file_format").alias("known_format"))
    return retrievals.join(d, "sha256").filter("length <> known_length OR NOT (file_format <=> known_format)")
