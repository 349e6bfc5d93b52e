"""Exact deduplication by a stream with keyed state on disk.

Texts are equal when they are identical after every run of ASCII white space becomes one
space.  A Structured Streaming aggregation keeps, for each digest and without expiry, the
smallest document id, how many rows had the digest and where the kept text is to be
found.  Its state lives in RocksDB, so it is bounded by disk and not by memory, and its
checkpoint lets a restarted stream go on with the state it had.  The map side of the
aggregation folds copies before they are shuffled, so that a text which a third of all
rows share reaches its state as one row for each task.

A digest only nominates.  Every row of a group of several is a hit: the kept text is fetched
from where the state says it is, and the row is compared with it byte by byte.  Rows whose
bytes differ (texts that collide) are grouped by their texts.  Groups with a large share of
all rows are dealt out over tasks before their texts are shuffled.

Nulls and ties: a null text counts as empty.  A null id is never kept if any equal text
has an id; a group without ids keeps a null.  Rows that repeat the kept id all count as
kept in the decisions; of these, :func:`kept_documents` lets one row stay.  Other columns
are carried along, whatever their names; columns named keep_id, group_size or kept give way
where these are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.llm.common import HOT_SHARE, dealt_join, hot_keys, shared_path, text_or_empty, written

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of new rows that a micro-batch takes in; state, not this, limits what a stream can hold.
TRIGGER_BYTES = 8 << 30
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Each of many small stores would else reserve megabytes that it never fills.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_ledger(arrivals: DataFrame) -> DataFrame:
    """For each digest of a stream or table of (digest, doc_id, locator): who stays, and how many came."""
    return arrivals.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )


def run_ledger_stream(spark: SparkSession, arrivals_path: str, schema, state_path: str) -> DataFrame:
    """Feeds the files under arrivals_path to the stateful ledger and returns its last state."""
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    ledger_path = f"{state_path}/ledger"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{ledger_path}/batch={batch}")

    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", TRIGGER_BYTES).parquet(arrivals_path)
        query = (
            digest_ledger(stream)
            .writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{state_path}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    fields = digest_ledger(spark.createDataFrame([], schema)).schema
    if query.lastProgress is None or not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], fields)
    # A digest that changed in several micro-batches has a row for each: the largest count is the last.
    states = spark.read.parquet(ledger_path)
    return states.groupBy("digest").agg(F.max_by("first", "group_size").alias("first"), F.max("group_size").alias("group_size"))


def decisions(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """(digest, doc_id, keep_id, group_size, kept) for every row of docs.

    digest maps a normalised text to the key of the state; another one than SHA-256 only
    changes how many texts have to be told apart by their bytes.
    """
    arrivals, ledger = _ledger(docs, digest)
    if _collisions(docs, ledger, digest):
        marked = _rows(docs.select("doc_id", "text"), digest).join(_by_text(docs, digest), ["digest", "norm"], "left").withColumn("doc_id", F.col("row.doc_id"))
    else:
        marked = dealt_join(arrivals, ledger, "digest", hot_keys(ledger, "digest", "size"))
    return marked.select("digest", "doc_id", *_verdict(F.col("doc_id")))


def deduplicate(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """docs with keep_id, group_size and kept, for every row; columns of docs with these names give way."""
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("keep_id", "group_size", "kept")]
    parts = [part.select(*own, *_verdict(F.col("row.doc_id"))) for part in _marked(docs, digest)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def kept_documents(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """One row of docs for each different text, with the columns of docs: the first of those with the kept id."""
    parts = []
    for marked in _marked(docs, digest):
        kept = marked.filter(_among("keep", F.col("row.doc_id")))  # the rows stay partitioned by digest
        keys = [c for c in ("digest", "norm") if c in marked.columns]
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
        parts.append(kept.withColumn("nth", first).filter("nth = 1").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _marked(docs: DataFrame, digest) -> list[DataFrame]:
    """(row, digest, keep, size) of every row of docs, those of hot groups apart from the others."""
    _, ledger = _ledger(docs, digest)
    rows = _rows(docs, digest)
    if _collisions(docs, ledger, digest):
        return [rows.join(_by_text(docs, digest), ["digest", "norm"], "left")]
    hot = F.broadcast(hot_keys(ledger, "digest", "size"))
    slim = rows.drop("norm")
    return [slim.join(F.broadcast(ledger.join(hot, "digest", "left_semi")), "digest"), slim.join(hot, "digest", "left_anti").join(ledger, "digest")]


def _rows(docs: DataFrame, digest) -> DataFrame:
    """(row, norm, digest): each row as a struct, so that its columns may have any names."""
    norm = normalised(text_or_empty())
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), norm.alias("norm"), digest(norm).alias("digest"))


def _verdict(doc_id: Column) -> list[Column]:
    return [F.col("keep").alias("keep_id"), F.col("size").cast("long").alias("group_size"), doc_id.eqNullSafe(F.col("keep")).alias("kept")]


def _among(known: str, value: Column) -> Column:
    """value is the known one, or both are null; not an equality that a join would take for a key and shuffle by."""
    return F.coalesce(F.array_contains(F.array(known), value), value.isNull() & F.col(known).isNull())


def _ledger(docs: DataFrame, digest) -> tuple[DataFrame, DataFrame]:
    """((digest, doc_id) of every row, (digest, keep, place, size) of every group)."""
    spark = docs.sparkSession
    slim = docs.select(digest(normalised(text_or_empty())).alias("digest"), "doc_id", F.input_file_name().alias("locator"))
    path = shared_path(spark, "arrivals")
    slim.write.parquet(path)
    ledger = run_ledger_stream(spark, path, slim.schema, shared_path(spark, "dedup-stream"))
    ledger = ledger.select("digest", F.col("first.doc_id").alias("keep"), F.col("first.locator").alias("place"), F.col("group_size").alias("size"))
    return spark.read.schema(slim.schema).parquet(path).select("digest", "doc_id"), written(ledger, "ledger")


def _by_text(docs: DataFrame, digest) -> DataFrame:
    """The exact way for keys that different texts share: groups by what the texts say."""
    return _rows(docs.select("doc_id", "text"), digest).groupBy("digest", "norm").agg(F.min("row.doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))


def _collisions(docs: DataFrame, ledger: DataFrame, digest) -> bool:
    """Does any row that hits a kept text differ from it in its bytes?

    Each row of a hot group goes to one of the group's parts, by its id and its file, and the
    kept text to all of them.
    """
    total = ledger.agg(F.sum("size")).first()[0] or 0
    shared = ledger.filter("size > 1").withColumn("parts", F.ceil(F.col("size") * HOT_SHARE / max(1, total)).cast("int"))
    hot = F.broadcast(shared.filter("parts > 1").select("digest", "parts"))
    norm = normalised(text_or_empty())
    texts = docs.select("doc_id", F.input_file_name().alias("file"), norm.alias("norm"), digest(norm).alias("digest"))
    texts = texts.join(hot, "digest", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "file"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    asked = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hits = texts.join(asked, ["digest", "part"])
    # Both uses of the texts share one shuffle.
    at_place = _among("place", F.col("file")) & _among("keep", F.col("doc_id"))
    kept = hits.filter(at_place).groupBy("digest", "parts").agg(F.min("norm").alias("kept"))
    kept = kept.select("digest", "kept", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    compared = hits.join(kept, ["digest", "part"], "left").filter(~F.col("norm").eqNullSafe(F.col("kept")))
    # The first row that differs, and not a count: both uses of the texts then read the same columns.
    return compared.agg(F.min(F.struct("file", "doc_id")).alias("x")).collect()[0].x is not None
