"""A table with one row for each key, in buckets of keys; a merge rewrites the buckets whose rows change, and no others.

A bucket is a folder of files, one for each of its parts, as Spark's bucketed tables have them, so stored rows meet incoming ones
without a shuffle.  A merge has four steps.  It puts what comes in beside the table in the same parts, which is the only shuffle,
compares it with the stored rows of the buckets that it falls into, writes the changed buckets whole beside the table, and then
moves their folders to the place of the old ones, so a changed bucket is written once.  A run that ends after the third
step has lost nothing: whoever opens the table next moves the folders that are left.  A merge of
rows that are stored already rewrites nothing.

There is one writer at a time, and a reader must not run during the last step.  Null is a key like others.  Of incoming rows with one key the
greatest by ``order`` stays, then by the remaining columns.  Columns must be of types that can
be grouped by (no maps).  What the driver gathers is numbers of buckets, at most ``buckets``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PLACES = ("buckets", "bucket")
#: Parts, and so files, of each bucket: a task compares or rewrites one.
PARTS = 4
#: So many incoming rows to a key are reduced in each task before they are shuffled.
REPEATED = 1.5


@dataclass
class Keyed:
    """The table under root.  ``near`` names the columns of the key that share a bucket (all of it if none is named); one that holds a constant is better left out."""

    spark: SparkSession
    root: str
    schema: StructType
    key: tuple[str, ...]
    buckets: int = 64
    near: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        clash = {*PLACES, "_new"} & {f.name.lower() for f in self.schema}
        if clash:
            raise ValueError(f"{sorted(clash)} are names of the table's own columns")
        if not {*self.near} <= {*self.key}:
            raise ValueError("rows of one key must share a bucket")
        self.schema = self.schema.toNullable()

    @property
    def table(self) -> str:
        return f"{self.root}/rows"

    @property
    def pending(self) -> str:
        return f"{self.root}/pending"

    @property
    def incoming(self) -> str:
        return f"{self.root}/incoming"

    def rows(self) -> DataFrame:
        """What is stored, without the columns of its layout."""
        return self.placed().drop(*PLACES)

    def placed(self) -> DataFrame:
        """What is stored, with the bucket of each row; a merge that did not end is ended first."""
        self.redo()
        return self._read(self.table)

    def redo(self) -> None:
        """Puts the changed buckets of a merge that did not end in their place."""
        if self._exists(f"{self.pending}/_SUCCESS"):
            self._swap()

    def merge(self, incoming: DataFrame, order: Sequence[str | Column] = ()) -> list[int]:
        """Incoming rows replace stored ones with their key; the numbers of the buckets that were rewritten.  What order computes is not shuffled or stored."""
        self.redo()
        rows = self._one_of_each(incoming, order)
        if not self._exists(self.table):
            self._write(rows, self.pending)
            return self._swap()
        if not self.placed().filter(F.col("buckets") != self.buckets).isEmpty():  # decided by the names of folders
            raise ValueError(f"the table was not made with {self.buckets} buckets")
        self._write(rows, self.incoming)  # worked out once, whatever it came from
        with self._opened(self.table) as known, self._opened(self.incoming) as new:
            changed = self._merge(known, new)
        self._delete(self.incoming)
        return changed

    def _merge(self, known: DataFrame, new: DataFrame) -> list[int]:
        rest = [f.name for f in self.schema if f.name not in self.key]
        side = lambda rows, n: rows.toDF(*rows.columns).withColumn("_new", F.lit(n))  # noqa: E731  # names of their own: else the sides are not seen to be dealt alike
        both = side(known, 0).unionByName(side(new, 1))
        of = F.struct("_new", *rest)

        def by_key(buckets: list[int], *more: Column) -> DataFrame:
            return both.filter(F.col("bucket").isin(buckets)).groupBy(*self.key).agg(F.max(of).alias("_best"), *more)  # only these folders are read

        best, least = F.col("_best"), F.col("_least")
        unlike = reduce(lambda a, b: a | b, (~best[c].eqNullSafe(least[c]) for c in rest), least["_new"] == 1)
        met = by_key(self._numbers(new), F.min(of).alias("_least")).filter((best["_new"] == 1) & unlike)
        changed = self._numbers(self._bucketed(met))
        if not changed:
            return []
        self._write(by_key(changed).select(*self._picked()), self.pending)
        return self._swap()

    def _one_of_each(self, incoming: DataFrame, order: Sequence[str | Column]) -> DataFrame:
        """Rows are shuffled once, by what deals them; where keys repeat, so also where one has very many rows, they are reduced before that."""
        typed = incoming.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        rest = [f.name for f in self.schema if f.name not in self.key]
        first = [F.col(c) if isinstance(c, str) else c for c in order]
        ranked = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(first)), F.struct(*rest).alias("row")) if rest else None

        def best(rows: DataFrame) -> DataFrame:
            return rows.groupBy(*self.key).agg(F.max(ranked)["row"].alias("_best")).select(*self._picked()) if rest else rows.distinct()

        n = typed.agg(F.count(F.lit(1)).alias("all"), F.approx_count_distinct(F.xxhash64(*self.key)).alias("keys")).first()
        return best((best(typed) if n["all"] > REPEATED * n["keys"] else typed).repartition(*self._dealt_by))

    def _picked(self) -> list[Column]:
        return [F.col(f.name) if f.name in self.key else F.col("_best")[f.name].alias(f.name) for f in self.schema]

    @property
    def _dealt_by(self) -> tuple[str, ...]:
        return self.near or self.key

    @property
    def _parts(self) -> int:
        return self.buckets * PARTS

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """Parts are dealt by the hash that Spark deals them by, so that each lies in one bucket."""
        place = F.pmod(F.hash(*self._dealt_by), F.lit(self.buckets))
        return rows.withColumns({"buckets": F.lit(self.buckets), "bucket": place})

    def _numbers(self, rows: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())

    def _write(self, rows: DataFrame, path: str) -> None:
        """A file for each part of a bucket; rows are shuffled by key into as many parts, which adaptive execution puts together by their sizes."""
        self._delete(path)
        name, conf, shuffled = self._name(), self.spark.conf, "spark.sql.shuffle.partitions"
        before = conf.get(shuffled)
        conf.set(shuffled, str(self._parts))
        try:
            placed = self._bucketed(rows).write.format("parquet").option("compression", "zstd").partitionBy(*PLACES)
            placed.bucketBy(self._parts, *self._dealt_by).sortBy(*self._dealt_by).option("path", self._whole(path)).saveAsTable(name)
        finally:
            conf.set(shuffled, before)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    @contextmanager
    def _opened(self, path: str) -> Iterator[DataFrame]:
        """What is at a path as a bucketed table, which must have a name for that; its files stay when the name goes."""
        name, columns = self._name(), ", ".join(f"`{c}`" for c in self._dealt_by)
        schema, place = self.spark._jsparkSession.parseDataType(self._placed_schema.json()).toDDL(), self._whole(path).replace("'", "\\'")
        try:
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY ({', '.join(PLACES)}) CLUSTERED BY ({columns}) INTO {self._parts} BUCKETS LOCATION '{place}'")
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
            yield self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _name(self) -> str:
        return f"keyed_{uuid.uuid4().hex}"

    def _whole(self, path: str) -> str:
        files, found = self._path(path)
        return files.makeQualified(found).toString()

    def _swap(self) -> list[int]:
        files, made = self._path(f"{self.pending}/buckets={self.buckets}")
        _, place = self._path(f"{self.table}/buckets={self.buckets}")
        files.mkdirs(place)
        folders = [x.getPath() for x in files.listStatus(made)] if files.exists(made) else []
        Path, numbers = self.spark._jvm.org.apache.hadoop.fs.Path, []
        for folder in folders:
            old = Path(place, folder.getName())
            files.delete(old, True)
            if not files.rename(folder, old):
                raise OSError(f"{folder} was not moved")
            numbers.append(int(folder.getName().split("=")[1]))
        self._delete(self.pending)
        return sorted(numbers)

    @property
    def _placed_schema(self) -> StructType:
        return StructType([*self.schema.fields]).add("buckets", "integer").add("bucket", "integer")

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self._placed_schema).parquet(path)

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), found

    def _exists(self, path: str) -> bool:
        files, found = self._path(path)
        return files.exists(found)

    def _delete(self, path: str) -> None:
        files, found = self._path(path)
        files.delete(found, True)

