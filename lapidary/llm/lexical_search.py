"""Ranked lexical search over bags of words, each different bag scored once.

Terms are the words of :mod:`decontaminate`: runs of ASCII letters and digits and of all bytes from 0x80 on, A-Z as a-z.  An
item's terms count once each.  With N documents that have a term, L terms in all of them and
df documents that hold a term, the term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))).  A
document of n terms has m = 10 + (90 n N) div L, and scores the sum over the item's terms of
w * ((10^9 tf) div (1000 tf + 8 m)), all in whole numbers.

1. One pass over the documents keeps of each text only the terms that some item has: a bag of
   (term, tf), with n.  Words are found by hash and their bytes are compared.
2. The bags give N, L and df by sums.
3. Rows with the same bag and the same m score alike for every item.  They meet by a hash of
   both, and the bytes behind the hash are part of the grouping key.  Only the :data:`TOP` least
   ids of a class can be in any list, as its members tie; each task drops the others before
   the shuffle, so that a class that has a third of all rows sends no more than that.
4. Each class is scored once against all items.  A task keeps the best of each item, as
   (score, id), with the classes' members in ascending order; these are ranked in the end.

The items are the stated query set.  They are read in blocks of at most :data:`BLOCK_BYTES` of
text or one item, one on the driver at a time, and each takes a pass over the documents.

Nulls and ties: a null text has no terms and is in no list; a null or repeated item id names
its own row's list; of equal scores the least id is first, and rows without an id come last.
Repeated rows are documents of their own.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.common import exact_numbers, ranges, steps, text_or_empty, utf8, written
from lapidary.llm.decontaminate import LOWER, Block, words_of

TOP = 10
BLOCK_BYTES = 2 << 20
#: Scores, and pairs of a bag's term and an item, that one step works on.
STEP_SCORES = 1 << 20

#: Stands for a missing id, and is after all others.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Items:
    """A block of items: its different terms, and the items that have each."""

    ids: list  # one for each item, as given
    terms: Block
    first: np.ndarray  # term t is in holders[first[t] : first[t + 1]]
    holders: np.ndarray

    @property
    def n_terms(self) -> int:
        return len(self.terms.vocabulary)


def items_of(rows: list[tuple[object, str]]) -> Items:
    data, row_bounds = utf8(pa.array([t for _, t in rows], pa.string()))
    starts, ends, hashes, bounds = words_of(data, row_bounds)
    low = LOWER[data]
    _, model, same = np.unique(exact_numbers(low, starts, ends, hashes), return_index=True, return_inverse=True)
    order = np.argsort(hashes[model], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(rows)), np.diff(bounds))
    pair = np.unique(place[same] * len(rows) + row)
    model = model[order]
    lengths = ends[model] - starts[model]
    terms = Block(hashes[model], low[ranges(starts[model], lengths)], np.cumsum(lengths) - lengths, lengths, {}, {})
    return Items([i for i, _ in rows], terms, np.searchsorted(pair // len(rows), np.arange(len(model) + 1)), pair % len(rows))


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of at most so many bytes of text, or one item; the driver holds one."""
    rows, size = [], 0
    for row in items.select("item_id", text_or_empty().alias("text")).toLocalIterator():
        own = len(row.text.encode())
        if rows and size + own > most:
            yield items_of(rows)
            rows, size = [], 0
        rows.append((row.item_id, row.text))
        size += own
    if rows:
        yield items_of(rows)


def bagged(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n, bag) of each row of (doc_id, text); a bag is term numbers in order, then how often each stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            for part in steps(batch, "text"):
                data, row_bounds = utf8(part.column("text"))
                starts, ends, hashes, bounds = words_of(data, row_bounds)
                number = items.terms.numbers(LOWER[data], starts, ends, hashes) - 1
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                known = number >= 0
                wide = max(1, items.n_terms)
                pair, tf = np.unique(row[known] * wide + number[known], return_counts=True)
                at = np.searchsorted(pair // wide, np.arange(part.num_rows + 1)).tolist()
                term, tf = (pair % wide).astype("<i4"), tf.astype("<i4")
                bags = [term[a:b].tobytes() + tf[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    return run


def bag_columns(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the entries of bags."""
    held = [np.frombuffer(b, "<i4") for b in bags.to_pylist()]
    half = [len(b) // 2 for b in held]
    row = np.repeat(np.arange(len(held)), half)
    if not held:
        return row, row, row
    term = np.concatenate([b[:h] for b, h in zip(held, half, strict=True)]).astype(np.int64)
    return row, term, np.concatenate([b[h:] for b, h in zip(held, half, strict=True)]).astype(np.int64)


def holders_counted(n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, df): how many of a task's bags have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for part in steps(batch, "bag"):
                total += np.bincount(bag_columns(part.column("bag"))[1], minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return run


@dataclass
class Best:
    """The best (score, id) of each item so far."""

    top: int
    item: np.ndarray
    score: np.ndarray
    doc: np.ndarray
    least: np.ndarray  # what an item's next entry must reach

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        keep = nth < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = self.item[nth[keep] == self.top - 1]
        self.least[full] = self.score[nth[keep] == self.top - 1]


def scored(sent, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, score, doc_id) of the best documents of each item in a task's classes (m, bag, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        n_items = len(items.ids)
        none = np.zeros(0, np.int64)
        best = Best(top, none, none, none, np.ones(n_items, np.int64))
        rows = max(1, STEP_SCORES // max(1, n_items))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = part.column("m").to_numpy()
                members = part.column("ids")
                first = np.asarray(members.offsets)
                ids = np.asarray(members.values.fill_null(NO_ID))
                row, term, tf = bag_columns(part.column("bag"))
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                total = np.zeros(part.num_rows * n_items, np.int64)
                n_holders = items.first[term + 1] - items.first[term]
                upto = np.cumsum(n_holders)
                low = 0
                while low < len(term):  # so many entries that their items are at most STEP_SCORES, or one
                    high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + STEP_SCORES, side="right")))
                    own = n_holders[low:high]
                    key = np.repeat(row[low:high] * n_items, own) + items.holders[ranges(items.first[term[low:high]], own)]
                    np.add.at(total, key, np.repeat(value[low:high], own))
                    low = high
                total = total.reshape(part.num_rows, n_items)
                hit, item = np.nonzero(total >= best.least[None, :])
                own = first[hit + 1] - first[hit]
                best.add(np.repeat(item, own), np.repeat(total[hit, item], own), ids[ranges(first[hit], own)])
        missing = best.doc == NO_ID
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.score), pa.array(best.doc, mask=missing)], ["item", "score", "doc_id"])

    return run


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def classes_of(bags: DataFrame, n_docs: int, n_all: int, top: int) -> DataFrame:
    """(h, m, bag, ids): each different (m, bag) of (doc_id, n, bag) that has a term, and its ``top`` least ids in order."""
    known = bags.filter(F.octet_length("bag") > 0)
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {max(1, n_all)}L")
    known = known.select("doc_id", m.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    within = Window.partitionBy("h", "m", "bag").orderBy(F.asc_nulls_last("doc_id"))
    first = known.withColumn("nth", F.row_number().over(within)).filter(F.col("nth") <= top)
    listed = F.sort_array(F.collect_list(F.struct("nth", "doc_id")))
    return first.groupBy("h", "m", "bag").agg(listed.getField("doc_id").alias("ids"))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of docs (doc_id, text) for each row of items (item_id, text)."""
    spark = docs.sparkSession
    id_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {id_kind}, rank int, doc_id bigint, score bigint"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = []
    for block in item_blocks(items, block_bytes):
        bags = written(texts.mapInArrow(bagged(spark.sparkContext.broadcast(block)), "doc_id bigint, n bigint, bag binary"), "bags")
        n_docs, n_all = bags.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(block.n_terms, np.int64)
        for row in bags.select("bag").mapInArrow(holders_counted(len(df)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row.term] = row.df
        sent = spark.sparkContext.broadcast((block, term_weights(n_docs, df)))
        best = classes_of(bags, n_docs, n_all, top).select("m", "bag", "ids").mapInArrow(scored(sent, top), "item bigint, score bigint, doc_id bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item bigint, item_id {id_kind}")  # as many as a block has items
        parts.append(written(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
