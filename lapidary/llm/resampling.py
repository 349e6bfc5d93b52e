"""Importance resampling towards a target distribution.

Features are all runs of one and two consecutive words (as in :mod:`decontaminate`), hashed to
:data:`BUCKETS` buckets by the CRC-32 of their bytes.  A bucket's gain is the floored thousandth
log-ratio of its smoothed shares in the target and in the corpus; a document's weight is the
floored mean of the gains of its features, read from one array.  Gumbel noise from the id is
added, and the documents with the highest scores are drawn: a sample without replacement in
proportion to the weights.

1. Tasks count buckets in an array of :data:`BUCKETS` numbers and Spark adds the arrays up.
2. A second pass weighs and scores the documents; ids and numbers are written, no texts.
3. The cutoff is found by selection and not by a sort of everything.  Each task takes the
   median of its keys that are still open and how many these are; the median of the medians,
   weighted by these sizes, is the pivot.  At least a quarter of what is open lies on either
   side of it.  The next pass counts what the pivot beats and takes the medians on both sides of it, so a
   round is one pass.  Open keys are written anew whenever they fell to an eighth, so all
   rounds together read some three times the keys of one pass.  It ends at the exact key.
4. Only the winners are sorted, by ranges of keys, and numbered by the sizes of the ranges
   before each one.

A key is (score, then the smaller id, then fewer features, then the row's own number), so no
two keys are equal, and a table in which a third of the rows share an id is cut as exactly as
any other.

The driver holds the buckets' gains and one median for each task of a pass.

Nulls and ties: a null text has no features and weight 0; a missing id draws the noise of the
empty text and comes after all others of its score.  Repeated rows are documents of their own.
Empty tables give empty tables.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import ranges, steps, text_or_empty, utf8, written
from lapidary.llm.decontaminate import LOWER, words_of

BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
#: Words of more bytes are handed to zlib one by one, and so are the bigrams that end in them.
TABLED = 64
#: Open keys are written anew when they fell to this share.
REWRITE = 8

KEY = ("score", "doc_id", "n_features", "row")
NO_ID = np.iinfo(np.int64).max


@cache
def crc_table() -> np.ndarray:
    """What each byte does to a CRC-32 register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


@cache
def shift_tables() -> np.ndarray:
    """[n, i, b]: byte i of a checksum, of value b, once n zero bytes were read; a checksum's bytes are added by xor."""
    table = crc_table()
    out = np.empty((TABLED + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(TABLED):
        out[n + 1] = table[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each checksum after n zero bytes: with the checksum of n bytes added by xor it is that of both together."""
    tables = shift_tables()
    out = np.zeros(len(crc), np.uint32)
    for i in range(4):
        out ^= tables[n, i, (crc >> np.uint32(8 * i)) & 255]
    return out


def span_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of the bytes of each span."""
    table = crc_table()
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    order = order[int((lengths > TABLED).sum()) :]
    at, left = starts[order], -lengths[order]
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(TABLED):
        live = int(np.searchsorted(left, -i))  # spans in order of their lengths: these are longer than i
        if not live:
            break
        register[:live] = table[(register[:live] ^ data[at[:live] + i]) & 255] ^ (register[:live] >> np.uint32(8))
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > TABLED).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def feature_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all words, buckets of all pairs of neighbours, bounds of each row's words, whether a pair follows each word)."""
    data, bounds = utf8(texts)
    starts, ends, _, at = words_of(data, bounds)
    low = LOWER[data]
    words = span_checksums(low, starts, ends)
    follows = np.ones(len(starts), bool)
    follows[at[1:][np.diff(at) > 0] - 1] = False
    first = np.flatnonzero(follows)
    size = (ends - starts)[first + 1]
    spaced = shifted(words[first], np.ones(len(first), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    pairs = shifted(spaced, np.minimum(size, TABLED)) ^ words[first + 1]
    for i in np.flatnonzero(size > TABLED).tolist():
        pairs[i] = zlib.crc32(low[starts[first[i] + 1] : ends[first[i] + 1]].tobytes(), int(spaced[i]))
    return words % np.uint32(buckets), pairs % np.uint32(buckets), at, follows


def bucket_counts(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, n): a task's features by bucket, from rows of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in steps(batch, "text"):
                words, pairs, _, _ = feature_buckets(part.column("text"), buckets)
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def counted(texts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(bucket_counts(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n_words, n_features, weight) of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = sent.value
        for batch in batches:
            for part in steps(batch, "text"):
                words, pairs, at, follows = feature_buckets(part.column("text"), len(gains))
                gain = gains[words]
                gain[follows] += gains[pairs]
                sums = np.concatenate([[0], np.cumsum(gain)])
                n_words = np.diff(at)
                n_features = n_words + np.maximum(n_words - 1, 0)
                weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n_features, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(seed: int) -> Column:
    """The floored thousandths of a Gumbel variate that the id and the seed decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def better(than: tuple[int, int, int, int]) -> Column:
    """Is a row's key better than this one?"""
    out = F.lit(False)
    for name, value in reversed(list(zip(KEY, than, strict=True))):
        column = F.coalesce(F.col(name), F.lit(NO_ID))
        ahead = column > value if name == "score" else column < value
        out = ahead | ((column == value) & out)
    return out


def in_order(keys: list[np.ndarray]) -> np.ndarray:
    return np.lexsort((keys[3], keys[2], keys[1], -keys[0]))


def task_medians(pivot: tuple[int, int, int, int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each side of the pivot, better (0) or worse (1): the median of a task's keys there and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(b.column(n).fill_null(NO_ID)) for n in KEY] for b in batches if b.num_rows]
        sides, sizes, medians = [], [], []
        if held:
            keys = [np.concatenate(x) for x in zip(*held, strict=True)]
            keys = [k[in_order(keys)] for k in keys]
            cut, after = 0, 0
            if pivot:
                cut = after = int(np.count_nonzero(ahead_of(keys, pivot)))
                after += cut < len(keys[0]) and tuple(int(k[cut]) for k in keys) == pivot
            for side, low, high in ((0, 0, cut), (1, after, len(keys[0]))):
                if low < high:
                    sides.append(side)
                    sizes.append(high - low)
                    medians.append([int(k[(low + high - 1) // 2]) for k in keys])
        columns = [pa.array(sides, pa.int32()), pa.array(sizes, pa.int64()), *(pa.array([m[i] for m in medians], pa.int64()) for i in range(4))]
        yield pa.RecordBatch.from_arrays(columns, ["side", "size", *KEY])

    return run


def ahead_of(keys: list[np.ndarray], pivot: tuple[int, int, int, int]) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    for i in (3, 2, 1, 0):
        out = (keys[i] > pivot[i] if i == 0 else keys[i] < pivot[i]) | ((keys[i] == pivot[i]) & out)
    return out


def weighted_median(rows: list) -> tuple[int, int, int, int]:
    """The first median, from the best on, by which half of the weight is reached."""
    rows = sorted(rows, key=lambda r: (-r.score, r.doc_id, r.n_features, r.row))
    half, seen = sum(r.size for r in rows) / 2, 0
    for r in rows:
        seen += r.size
        if seen >= half:
            break
    return r.score, r.doc_id, r.n_features, r.row


def still_open(table: DataFrame, best: tuple | None, worst: tuple | None) -> DataFrame:
    if best:
        table = table.filter(~better(best) & (F.col("row") != best[3]))
    return table.filter(better(worst)) if worst else table


def cutoff_key(keys: DataFrame, nth: int) -> tuple[int, int, int, int] | None:
    """The nth best key, from 1, of a written table of different keys; None if there are fewer."""
    kinds = "side int, size bigint, score bigint, doc_id bigint, n_features bigint, row bigint"
    best = worst = pivot = written_size = None  # what is open is worse than best and better than worst
    table = keys.select(*KEY)
    while True:
        found = still_open(table, best, worst).mapInArrow(task_medians(pivot), kinds).collect()
        ahead, behind = ([r for r in found if r.side == s] for s in (0, 1))
        n_ahead = sum(r.size for r in ahead)
        if pivot is None:
            if nth > sum(r.size for r in behind):
                return None
            side = behind
        elif nth == n_ahead + 1:
            return pivot
        elif nth <= n_ahead:
            side, worst = ahead, pivot
        else:
            side, best = behind, pivot
            nth -= n_ahead + 1
        size = sum(r.size for r in side)
        written_size = written_size or size
        if size * REWRITE <= written_size:
            table, written_size = written(still_open(table, best, worst), "open"), size
        pivot = weighted_median(side)


def numbered(winners: DataFrame, tag: str = "winners") -> DataFrame:
    """winners in the order of their keys, with their rank from 1."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    placed = winners.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, tag)
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).count().collect()  # one for each range
    before, seen = [], 0
    for row in sorted(sizes):
        before.append((row.part, seen))
        seen += row["count"]
    starts = winners.sparkSession.createDataFrame(before, "part bigint, before bigint")
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part", "left")
    return ranked.withColumn("rank", F.col("before") + F.col("place") - F.shiftleft("part", 33) + 1).drop("part", "before", "place")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs (doc_id, text); target has (text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    gains = gains_of(counted(texts.select("text"), buckets), counted(target.select(text_or_empty().alias("text")), buckets))
    kinds = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    rows = texts.mapInArrow(weighed(spark.sparkContext.broadcast(gains)), kinds)
    rows = rows.withColumn("score", F.col("weight") + gumbel(seed)).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "scored")
    able = rows.filter(F.col("n_words") >= least_words)
    n_drawn = percent * able.count() // 100
    last = cutoff_key(able, n_drawn) if n_drawn else None
    shown = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    won = (F.col("n_words") >= least_words) & (better(last) | (F.col("row") == last[3]))
    drawn = numbered(rows.filter(won)).select(*shown, "rank")
    return drawn.unionByName(rows.filter(~won).select(*shown, F.lit(None).cast("long").alias("rank")))
