"""What the corpus operators share: tables in the shared folder, and UTF-8 columns as numpy bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; its arrays take some forty times as much.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one serves only a session that runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with no lineage to repeat."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it has more than one in so many of the rows; there are at most so many hot keys.
HOT_SHARE = 10_000


def hot_keys(counts: DataFrame, key: str, number: str) -> DataFrame:
    """The keys of counts (one row each) with more than 1 / HOT_SHARE of all rows: at most HOT_SHARE of them, whatever the input."""
    total = counts.agg(F.sum(number)).first()[0] or 0
    return counts.filter(F.col(number) * HOT_SHARE > F.lit(total)).select(key)


def dealt_join(rows: DataFrame, other: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to other, which has each key at most once: hot keys are sent to the rows, where these are, and the rest is shuffled.

    So no task gets more rows of one key than a share of 1 / HOT_SHARE.  how: inner or left.
    """
    sent = F.broadcast(hot)
    apart = rows.join(F.broadcast(other.join(sent, key, "left_semi")), key)
    return apart.unionByName(rows.join(sent, key, "left_anti").join(other, key, how))


def free_name(wanted: str, columns: list[str]) -> str:
    """A column name that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc_bucket(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; rows without an id count as bucket 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows with at most ``most`` bytes in the column, or a single row."""
    ends = offsets(batch.column(column))
    row, rows = 0, batch.num_rows
    while row < rows:
        stop = int(np.searchsorted(ends, ends[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield batch.slice(row, stop - row)
        row = stop


def offsets(array: pa.Array) -> np.ndarray:
    """Where each value begins in the column's bytes, and where the last one ends."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32) if array.buffers()[1] else np.zeros(1, np.int32)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): the values of a string column without nulls, end to end."""
    bounds = offsets(array)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[bounds[0] : bounds[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking 64-bit number for each byte, and an odd multiplier with its inverse modulo 2**64.
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 1024)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            part = min(done, size - done)
            factor = np.uint64(pow(base, done, 1 << 64))
            have[done : done + part] = have[:part] * factor
            done += part
        _powers[base] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = BASE**i times a polynomial hash of data[i:j], all modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, whatever stands before it."""
    inverse = powers(BASE_INVERSE, len(sums))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: For each length up to 8, the bits of so many bytes.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), np.dtype("<u8"), padded, 0, (1,)) if len(data) else np.zeros(0, np.uint64)


def chunked(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, number within the span, first of each span) of the pieces of eight bytes of each span, which has a byte at least."""
    count = (lengths + 7) >> 3
    first = np.cumsum(count) - count
    nth = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(first, count)
    return np.repeat(starts, count) + 8 * nth, np.minimum(np.repeat(lengths, count) - 8 * nth, 8), nth, first


def mixed_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span that has any, in which each piece of eight bytes is mixed with its place before they are added."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place, size, nth, first = chunked(starts, ends - starts)
    piece = eights(data)[place] & MASKS[size]
    sums = np.add.reduceat(mixed(piece + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), first)
    return mixed(sums + (ends - starts).astype(np.uint64))


def same_bytes(one: np.ndarray, starts: np.ndarray, two: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Does each span of one (start, length) hold the same bytes as that of two?  Spans have a byte at least."""
    if not len(starts):
        return np.zeros(0, bool)
    place, size, _, first = chunked(starts, lengths)
    shift = np.repeat(others - starts, (lengths + 7) >> 3)
    return np.logical_and.reduceat((eights(one)[place] ^ eights(two)[place + shift]) & MASKS[size] == 0, first)


def exact_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each span that spans with the same bytes share and no others: by hash, and the bytes are compared."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, model = ends - starts, first[number]
    fits = (lengths == lengths[model]) & (lengths > 0)
    fits[fits] = same_bytes(data, starts[fits], data, starts[model[fits]], lengths[fits])
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(~fits).tolist():  # spans that only share a hash
        number[i] = seen.setdefault(data[starts[i] : ends[i]].tobytes(), len(first) + len(seen))
    return number
