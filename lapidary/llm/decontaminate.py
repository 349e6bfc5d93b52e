"""Benchmark decontamination with an FM-index over each shard of the training text.

Words are runs of the bytes that :data:`WORD_BYTES` marks, after A-Z became a-z.  Each batch
of documents that a task reads is a shard.  Its words are numbered by the vocabulary of
the benchmark; words that no item has cannot be part of an occurrence, so each maximal run
of known words is kept and the rest becomes one separator, which loses no occurrence.
Over that text the shard builds a suffix array, its Burrows-Wheeler transform and a
wavelet matrix of it.  All test windows are searched backwards at once through ranks of
the wavelet matrix; their occurrences are found by walking to sampled suffix positions.
Spans of hit words are merged, and can be cut out of the text.

The benchmark is the stated query set.  It is read in blocks of at most
:data:`BLOCK_BYTES` of text or one item.  The driver holds one block at a time, and a pass
over the documents takes :data:`SENT_BLOCKS` blocks at most; a longer benchmark means more
passes, with what was found so far written in between.  Documents are never shuffled.
Words are found by hash, and their bytes are compared.

Nulls and ties: a null text has no words.  An item without words has no window.  Items
without an id mark words as hit and are not listed.  Items that repeat an id count once.
Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.common import exact_numbers, free_name, mixed_hashes, offsets, ranges, same_bytes, steps, text_or_empty, utf8, written

WINDOW = 10
BLOCK_BYTES = 2 << 20
#: Blocks that are sent to all tasks of one pass.
SENT_BLOCKS = 4
#: Bytes of documents that one index covers, or one longer text.
SHARD_BYTES = 4 << 20
#: Every so many positions of a shard's text keep their place in it.
SAMPLE = 8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True

FOUND = "n_words bigint, n_hit bigint, items array<string>, words array<struct<start:int,end:int>>, bytes array<struct<start:int,end:int>>, clean string"
NOTHING = f"CAST(NULL AS STRUCT<{FOUND.replace(' bigint', ':bigint').replace(' array', ':array').replace('clean string', 'clean:string')}>)"


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, bounds of each row's words) of the words of texts that stand end to end."""
    low = LOWER[data]
    inside = WORD_BYTES[low]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    before[bounds] = after[bounds] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, mixed_hashes(low, starts, ends), np.searchsorted(starts, bounds)


@dataclass
class Block:
    """Windows of some benchmark items, over a vocabulary in order of word hashes."""

    vocabulary: np.ndarray  # a word's number is its place here, plus 1; words that share a hash stand side by side
    letters: np.ndarray  # the words' bytes, end to end
    starts: np.ndarray  # where each word begins in them
    lengths: np.ndarray
    windows: dict[int, np.ndarray]  # by length: one row of word numbers for each different window
    items: dict[int, list[list[str]]]  # by length: the ids of the items that have the window

    def numbers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or 0 for one that no item has."""
        out = np.zeros(len(hashes), np.int64)
        at, lengths = np.searchsorted(self.vocabulary, hashes), ends - starts
        open_ = np.flatnonzero(at < len(self.vocabulary))
        while len(open_ := open_[self.vocabulary[at[open_]] == hashes[open_]]):
            fits = self.lengths[at[open_]] == lengths[open_]
            own = open_[fits]
            fits[fits] = same_bytes(low, starts[own], self.letters, self.starts[at[own]], lengths[own])
            out[open_[fits]] = at[open_[fits]] + 1
            open_ = open_[~fits]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.vocabulary)]
        return out


def block_of(rows: list[tuple[str | None, str]]) -> Block:
    data, row_bounds = utf8(pa.array([t for _, t in rows], pa.string()))
    starts, ends, hashes, bounds = words_of(data, row_bounds)
    low = LOWER[data]
    same = exact_numbers(low, starts, ends, hashes)
    _, model, same = np.unique(same, return_index=True, return_inverse=True)
    order = np.argsort(hashes[model], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    numbers = place[same] + 1
    model = model[order]
    lengths = ends[model] - starts[model]
    seen: dict[tuple[int, ...], set[str]] = {}
    for (item, _), a, b in zip(rows, bounds, bounds[1:], strict=False):
        own = numbers[a:b].tolist()
        for i in range(max(1, len(own) - WINDOW + 1) if own else 0):
            seen.setdefault(tuple(own[i : i + WINDOW]), set()).update([] if item is None else [item])
    windows, items = {}, {}
    for size in {len(w) for w in seen}:
        these = [w for w in seen if len(w) == size]
        windows[size], items[size] = np.array(these, np.int64), [sorted(seen[w]) for w in these]
    return Block(hashes[model], low[ranges(starts[model], lengths)], np.cumsum(lengths) - lengths, lengths, windows, items)


class ShardIndex:
    """FM-index of a sequence of numbers from 0 up.  Inside, they are one more, and a single 0 ends the text."""

    def __init__(self, numbers: np.ndarray) -> None:
        text = np.append(numbers + 1, 0)
        self.n = len(text)
        suffixes = suffix_order(text)
        self.last = text[suffixes - 1]
        counts = np.bincount(text, minlength=2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.bits = max(1, int(text.max()).bit_length())
        level, self.zeros = self.last, []
        for bit in range(self.bits - 1, -1, -1):
            off = (level >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(off)]))
            level = np.concatenate([level[off], level[~off]])
        self.sampled = suffixes % SAMPLE == 0
        self.place = np.where(self.sampled, suffixes, -1)[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1

    def rank(self, symbols: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position in the transform."""
        at, start = stop, np.zeros_like(stop)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            on = (symbols >> bit) & 1 == 1
            at = np.where(on, zeros[-1] + at - zeros[at], zeros[at])
            start = np.where(on, zeros[-1] + start - zeros[start], zeros[start])
        return at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) in suffix order of the suffixes that begin with each row of patterns."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for symbols in patterns.T[::-1] + 1:
            known = symbols < len(self.before) - 1
            safe = np.where(known, symbols, 0)
            low, high = (self.before[safe] + self.rank(safe, x) for x in (low, high))
            high = np.where(known, high, low)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each place in suffix order."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        while len(open_ := np.flatnonzero(~self.sampled[rows])):
            at = rows[open_]
            symbols = self.last[at]
            rows[open_] = self.before[symbols] + self.rank(symbols, at)
            walked[open_] += 1
        return self.place[self.nth[rows]] + walked


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n, size = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, size = new, size * 2
        if rank[order[-1]] == n - 1:
            return order


def hits_in(block: Block, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list[set[str]]]:
    """(starts, ends, bounds of each row's words, hits as (word, length), items of each row) of a shard."""
    data, row_bounds = utf8(texts)
    starts, ends, hashes, bounds = words_of(data, row_bounds)
    least = min(block.windows, default=None)
    items: list[set[str]] = [set() for _ in range(len(texts))]
    hits: list[tuple[np.ndarray, int]] = []
    if not least or not len(hashes):
        return starts, ends, bounds, hits, items
    number = block.numbers(LOWER[data], starts, ends, hashes)
    breaks = np.zeros(len(number) + 1, bool)
    breaks[bounds] = breaks[0] = breaks[-1] = True
    known = number > 0
    breaks[:-1] |= ~known
    breaks[1:] |= ~known
    edges = np.flatnonzero(breaks)
    lengths = np.diff(edges)
    keep = (lengths >= least) & known[edges[:-1]]
    run, length = edges[:-1][keep], lengths[keep]
    if not len(run):
        return starts, ends, bounds, hits, items
    # each run, then one separator
    place = ranges(run, length + 1)
    values = number[np.minimum(place, len(number) - 1)]
    values[np.cumsum(length + 1) - 1] = 0
    index = ShardIndex(values)
    for size, windows in block.windows.items():
        low, high = index.search(windows)
        which = np.repeat(np.arange(len(windows)), high - low)
        word = place[index.locate(ranges(low, high - low))]
        hits.append((word, size))
        row = np.searchsorted(bounds, word, side="right") - 1
        for r, w in np.unique(np.stack([row, which], 1), axis=0).tolist() if len(row) else []:
            items[r].update(block.items[size][w])
    return starts, ends, bounds, hits, items


def search_block(block: Block, texts: pa.Array, earlier: list, cut: bool) -> pa.Array:
    """What the block finds in each text, together with what earlier blocks found there, shard by shard."""
    found, done = [], 0
    for part in steps(pa.RecordBatch.from_arrays([texts], ["t"]), "t", SHARD_BYTES):
        found.append(search_shard(block, part.column(0), earlier[done : done + part.num_rows], cut))
        done += part.num_rows
    return pa.concat_arrays(found) if found else search_shard(block, texts, [], cut)


def search_shard(block: Block, texts: pa.Array, earlier: list, cut: bool) -> pa.Array:
    starts, ends, bounds, hits, items = hits_in(block, texts)
    change = np.zeros(len(starts) + 1, np.int64)
    for word, length in hits:
        np.add.at(change, word, 1)
        np.add.at(change, word + length, -1)
    base = offsets(texts) - offsets(texts)[0]
    for r, known in enumerate(earlier):
        for span in known["words"] if known else ():
            change[bounds[r] + span["start"]] += 1
            change[bounds[r] + span["end"]] -= 1
        items[r].update(known["items"] if known else ())
    hit = np.cumsum(change)[:-1] > 0
    edge = np.zeros(len(hit) + 1, bool)
    edge[bounds] = edge[0] = edge[-1] = True
    edge[1:-1] |= hit[1:] != hit[:-1]
    edges = np.flatnonzero(edge)
    on = hit[edges[:-1]] if len(hit) else np.zeros(0, bool)
    a, b = edges[:-1][on], edges[1:][on]
    per_row = np.searchsorted(a, bounds)
    row = np.searchsorted(bounds, a, side="right") - 1
    spans = lambda x, y: pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], ["start", "end"]))
    in_row = spans(a - bounds[row], b - bounds[row])
    in_bytes = spans(starts[a] - base[row], ends[b - 1] - base[row])
    clean: list[str | None] = [None] * len(texts)
    if cut:
        for r in np.unique(row).tolist():
            raw, out, at = texts[r].as_py().encode(), [], 0
            for span in in_bytes[r].as_py():
                out.append(raw[at : span["start"]])
                at = span["end"]
            clean[r] = b"".join([*out, raw[at:]]).decode()
    n_hit = np.zeros(len(texts), np.int64)
    np.add.at(n_hit, row, b - a)
    columns = [pa.array(np.diff(bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(sorted, items), pa.list_(pa.string())), in_row, in_bytes, pa.array(clean, pa.string())]
    return pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "items", "words", "bytes", "clean"])


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks, one after the other: each with an item at least and else with at most block_bytes of text.

    Items are dealt by running sums of their sizes within parts that a hash makes, so that
    equal rows are spread as well.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_or_empty().alias("text")).distinct()
    items = items.withColumn("size", F.octet_length("text"))
    total = items.agg(F.sum("size")).first()[0] or 0
    n = -(-total // block_bytes)
    if n <= 1:
        yield block_of([(r.item, r.text) for r in items.collect()])
        return
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    before = F.sum("size").over(Window.partitionBy("part").orderBy("item", "text")) - F.col("size")
    dealt = written(dealt.withColumn("nth", F.floor(before / block_bytes)), "benchmark")
    for part, nth in sorted(tuple(r) for r in dealt.select("part", "nth").distinct().collect()):
        yield block_of([(r.item, r.text) for r in dealt.filter((F.col("part") == part) & (F.col("nth") == nth)).collect()])


def searcher(block: Broadcast, cut: bool) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(FOUND)
    def udf(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        return search_block(block.value, texts, earlier.to_pylist(), cut)

    return udf


def search(docs: DataFrame, benchmark: DataFrame, cut: bool = False, block_bytes: int = BLOCK_BYTES, name: str = "found") -> DataFrame:
    """docs with a struct (``found``, or by another name): words, hit words, items, merged spans (in words and in bytes) and, on request, the text without them."""
    spark = docs.sparkSession
    found: Column = F.expr(NOTHING)
    out, sent = docs.withColumn(name, found), 0
    for block in blocks_of(benchmark, block_bytes):
        if sent == SENT_BLOCKS:
            out, sent = written(out, "found"), 0
        out = out.withColumn(name, searcher(spark.sparkContext.broadcast(block), cut)(text_or_empty(), F.col(name)))
        sent += 1
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: its words, its hit words and the items that hit it."""
    return search(docs.select("doc_id", "text"), benchmark, block_bytes=block_bytes).select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("found.items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with hit words cut out of the text, and n_chars to match; other rows as they are."""
    name = free_name("found", docs.columns)
    found = search(docs, benchmark, cut=True, block_bytes=block_bytes, name=name)
    hit = F.col(f"{name}.n_hit") > 0
    out = {c: F.col(c) for c in docs.columns} | {"text": F.when(hit, F.col(f"{name}.clean")).otherwise(F.col("text"))}
    if "n_chars" in out:
        out["n_chars"] = F.when(hit, F.char_length(f"{name}.clean").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*(c.alias(k) for k, c in out.items()))
