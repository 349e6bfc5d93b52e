"""The registry of sources: definitions in files, all that is wrong with them at once, and what may be collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "id string, retrieval string, base_url string, allow_insecure_transport boolean, robots_policy string, access string, enabled boolean, verification_status string, crawler string, requests_per_minute int, min_delay_seconds double"
#: Fixed value: the retrieval that needs neither an address nor a crawler.
MANUAL = "manual_upload"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, position, source...) of every definition in the YAML files of a folder; a file that is none has a null source and its error."""

    def parsed(batches):
        import json

        import pandas as pd
        import yaml

        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["value"], strict=True):
                try:
                    found = yaml.safe_load(text)["sources"]
                    rows += [(file, i, json.dumps(x, default=str), None) for i, x in enumerate(found)]
                except (yaml.YAMLError, TypeError, KeyError) as error:
                    rows.append((file, 0, None, f"{type(error).__name__}: no list of sources"))
            yield pd.DataFrame(rows, columns=["file", "position", "body", "error"])

    files = spark.read.text([f"{folder}/*.yaml", f"{folder}/*.yml"], wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return files.mapInPandas(parsed, "file string, position int, body string, error string").withColumn("s", F.from_json("body", SOURCE)).select("file", "position", "error", "s.*")


def problems(sources: DataFrame, crawlers: list[str] | None = None) -> DataFrame:
    """(file, id, problem): everything that is wrong, one row each.  A later definition of an id is a repetition of the first by file and position."""
    on, fetched = F.coalesce("enabled", F.lit(False)), F.col("retrieval") != MANUAL
    insecure, plain = F.coalesce("allow_insecure_transport", F.lit(False)), F.coalesce(F.col("base_url").startswith("http://"), F.lit(False))
    checks = {
        "base_url is required": fetched & F.col("base_url").isNull(),
        "plain HTTP is not acknowledged": plain & ~insecure,
        "insecure transport is allowed for nothing": ~plain & insecure,
        "robots are not respected": (F.col("retrieval") == "http_crawl") & (F.coalesce("robots_policy", F.lit("")) != "respect"),
        "restricted access is enabled": on & fetched & (F.col("access") == "restricted"),
        "enabled without approval": on & (F.coalesce("verification_status", F.lit("")) != "approved"),
        "enabled without a crawler": on & fetched & F.col("crawler").isNull(),
        "requests_per_minute cannot be reached with the delay": (F.col("min_delay_seconds") > 0) & (F.col("requests_per_minute") > 60 / F.col("min_delay_seconds")),
    }
    if crawlers is not None:
        checks["enabled with an unknown crawler"] = on & F.col("crawler").isNotNull() & ~F.col("crawler").isin(*crawlers)
    own = F.array_compact(F.array(F.col("error"), *(F.when(wrong, F.lit(name)) for name, wrong in checks.items())))
    found = sources.select("file", "id", F.explode(own).alias("problem"))
    first = sources.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("file", "position")).alias("first"))
    again = sources.join(first, "id").filter(F.struct("file", "position") != F.col("first"))
    return found.unionByName(again.select("file", "id", F.concat(F.lit("repeats an id of "), F.col("first.file")).alias("problem")))


def collectable(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled AND verification_status = 'approved'")
