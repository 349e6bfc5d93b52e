"""A content store: each content once, under the key that its digest makes, and never changed.

Writing is a Spark data source: tasks put contents into a folder of their own attempt and report
what they wrote; the commit moves each content to its key, and an abort removes the folders.
A key that is there already is left alone if its bytes are the same, and is an error if they
are not.  Tasks stage only what is not stored yet, so a second run leaves nothing to move.  So a task that runs twice, a second run and two writers of the same content end alike.
What the driver moves in a commit is names: contents never pass it.

The store is a folder that driver and tasks can open as files.  :func:`audited` reads every
object back as a table and compares its digest with its key.
"""

from __future__ import annotations

import filecmp
import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lapidary.sources import objects

STAGED = "_staged"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    keys: list[str]


def placed(staged: str, final: str) -> bool:
    """Moves a staged object to its key; False where the same bytes are there already."""
    os.makedirs(os.path.dirname(final), exist_ok=True)
    try:
        os.link(staged, final)  # fails if the key exists, whoever made it
        return True
    except FileExistsError:
        if not filecmp.cmp(staged, final, shallow=False):
            raise ValueError(f"another content is stored under {final}") from None
        return False


def is_stored(content: bytes, final: str) -> bool:
    """Whether the key has these bytes already; other bytes under it are an error."""
    try:
        with open(final, "rb") as file:
            same = file.read(len(content) + 1) == content
    except FileNotFoundError:
        return False
    if not same:
        raise ValueError(f"another content is stored under {final}")
    return True


class StoreWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root.removeprefix("file://")
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        folder = os.path.join(self.root, STAGED, self.run, f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}")
        os.makedirs(folder)
        keys = []
        for row in rows:
            content = bytes(row["content"])
            if hashlib.sha256(content).hexdigest() != row["key"].rsplit("/", 1)[-1].split(".")[0]:
                raise ValueError(f"content does not have the digest of {row['key']}")
            if is_stored(content, os.path.join(self.root, row["key"])):
                continue
            path = os.path.join(folder, str(len(keys)))
            with open(path, "wb") as file:
                file.write(content)
                file.flush()
                os.fsync(file.fileno())
            keys.append(row["key"])
        return Written(folder, keys)

    def commit(self, messages: list[Written | None]) -> None:
        try:
            for message in filter(None, messages):
                for i, key in enumerate(message.keys):
                    placed(os.path.join(message.folder, str(i)), os.path.join(self.root, key))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(os.path.join(self.root, STAGED, self.run), ignore_errors=True)


class StoreSource(DataSource):
    """``df.write.format("content_store").mode("append").save(root)`` of (key, content)."""

    @classmethod
    def name(cls) -> str:
        return "content_store"

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        if overwrite:
            raise ValueError("stored contents are never overwritten")
        return StoreWriter(self.options["path"])


def stored(found: DataFrame, root: str) -> None:
    """Puts the contents of found (key, content) into the store, each key once."""
    spark = found.sparkSession
    spark.dataSource.register(StoreSource)
    found.select("key", "content").dropDuplicates(["key"]).write.format("content_store").mode("append").save(root)


def audited(spark: SparkSession, root: str) -> DataFrame:
    """(key, length, sha256, sound) of every object in the store: is its digest the one that its key names?"""
    found = objects.files(spark, root).filter(~F.col("path").contains(f"/{STAGED}/"))
    digest = F.sha2("content", 256)
    key = F.substring_index(F.col("path"), "/", -5)
    return found.select(key.alias("key"), "length", digest.alias("sha256"), (digest == F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1)).alias("sound"))
