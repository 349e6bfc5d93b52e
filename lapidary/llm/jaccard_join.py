"""N-gram Jaccard similarity join by MinHash banding.

The n-grams of a text are its runs of :data:`NGRAM` words (runs of the bytes of
:data:`decontaminate.WORD_BYTES`, A-Z as a-z); a shorter text has one n-gram, of all its
words.  Two texts are linked when the Jaccard similarity of their sets of n-grams is at
least the threshold.

1. Texts with the same words in the same order are folded into one, by a 128-bit digest of
   their words, with map-side aggregation.
2. Bands and rows are chosen for a target recall at the threshold.  Band hashes of the folded
   texts are shuffled; those that several have tie each member to the least one, which gives
   candidate clusters as connected components, in a number of rows that follows the number
   of texts and not of pairs.
3. Clusters of more than :data:`BLOCK` texts or :data:`BLOCK_BYTES` are cut into blocks of texts
   that have the same least neighbour.  A task gets two blocks, and of these only the texts
   that share a band hash with one of the other block: a text is copied once for each block
   in which it has candidates, so that a long chain of texts is not copied all to all.  Each
   candidate pair meets in one pair of blocks.  There words are numbered by their bytes and
   n-grams by their words, and full sets are compared.  A task returns a number of links and
   one local label for each text, never a row for each pair.
4. Labels from all pairs of blocks are joined into the final classes.

A key that a large share of the rows has is sent to these rows and not shuffled.

Nulls and ties: a text without words (or null) links to nothing and is its own class.  Rows
without an id are compared like all others; a class of which no row has an id has a null
class id.  Of equal rows one stands for all.  The class id is the least id in the class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import dealt_join, exact_numbers, free_name, hot_keys, mixed, ranges, steps, text_or_empty, utf8, written
from lapidary.llm.components import components
from lapidary.llm.decontaminate import LOWER, words_of

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.99999
MOST_HASHES = 160
#: Texts, and bytes of text, in a block; a text that is longer is a block of its own.
BLOCK = 256
BLOCK_BYTES = 2 << 20


def bands_and_rows(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most selective (bands, rows) that find a pair at the threshold with the wanted probability."""
    rows = 1
    best = (1, 1)
    while rows < most:
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
        rows += 1
    return best


def gram_places(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, row) of each n-gram of rows whose words are bounded by at."""
    count = np.diff(at)
    own = np.minimum(count, size)
    number = count - own + (count > 0)
    row = np.repeat(np.arange(len(count)), number)
    return ranges(at[:-1], number), own[row], row


def gram_hashes(word: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): a hash of each n-gram of each row, repeated ones too."""
    first, own, row = gram_places(at, size)
    gram = np.zeros(len(first), np.uint64)
    for i in range(size):
        on = np.flatnonzero(i < own)
        gram[on] = mixed(gram[on] * np.uint64(0x100000001B3) + word[first[on] + i].astype(np.uint64) + np.uint64(1))
    return gram, np.searchsorted(row, np.arange(len(at)))


def gram_sets(number: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, bounds): the different n-grams of each row, sorted, end to end.  number has a number for each different word.

    An n-gram's number is the place of the first one with the same words: found by hash, and
    the words are compared.
    """
    first, own, row = gram_places(at, size)
    gram, _ = gram_hashes(number, at, size)
    _, model, found = np.unique(gram, return_index=True, return_inverse=True)
    differs = own != own[model[found]]
    for i in range(size):
        on = np.flatnonzero((i < own) & ~differs)
        differs[on] = number[first[on] + i] != number[first[model[found[on]]] + i]
    seen: dict[tuple[int, ...], int] = {}
    for i in np.flatnonzero(differs).tolist():  # n-grams that only share a hash
        found[i] = seen.setdefault(tuple(number[first[i] : first[i] + own[i]].tolist()), len(model) + len(seen))
    wide = np.int64(len(model) + len(seen) + 1)
    key = np.unique(row * wide + found)
    return key % wide, np.searchsorted(key // wide, np.arange(len(at)))


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits for each row, from all its words in order."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = LOWER[data[np.cumsum(inside[:-1], dtype=np.int8) > 0]].tobytes()
    lengths = (ends - starts).astype("<u4")
    ends_of = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[at].tolist()
    sizes, places = lengths.tobytes(), at.tolist()
    return [
        hashlib.blake2b(letters[a:b], digest_size=16, key=hashlib.blake2b(sizes[4 * i : 4 * j], digest_size=32).digest()).digest()
        for a, b, i, j in zip(ends_of, ends_of[1:], places, places[1:], strict=False)
    ]


def min_hashes(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each row and band, over ``rows`` minima each; rows without n-grams have zeros."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    base = mixed(grams + np.uint64(1))
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for band in range(bands):
        key = np.full(len(some), band + 1, np.uint64)
        for factor in factors[band * rows : (band + 1) * rows]:
            # A product's high bits decide the order, and they depend on all bits of the gram.
            key = mixed(key * np.uint64(0x100000001B3) + np.minimum.reduceat(base * factor, bounds[some])) if len(some) else key
        out[some, band] = key
    return out.view(np.int64)


def signature_udf(size: int, bands: int, rows: int) -> Callable[[Column], Column]:
    kind = pa.struct([("k", pa.binary()), ("v", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("k binary, v bigint, n int, bands array<bigint>")
    def udf(texts: pa.Array) -> pa.Array:
        parts = []
        for part in steps(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            data, bounds = utf8(part.column(0))
            starts, ends, word, at = words_of(data, bounds)
            grams, of = gram_hashes(word, at, size)
            hashes = min_hashes(grams, of, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * bands, pa.int32()), pa.array(hashes.ravel()))
            keys = word_digests(data, starts, ends, at)
            short = np.frombuffer(b"".join(x[:8] for x in keys), "<i8")
            parts.append(pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(short), pa.array(np.diff(at), pa.int32()), lists], ["k", "v", "n", "bands"]))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return udf


def similar_in(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], candidate: np.ndarray, threshold: float) -> np.ndarray:
    """Which candidate pairs (a matrix) of two lists of sets have the similarity."""
    (g1, b1), (g2, b2) = one, two
    both = np.intersect1d(g1, g2)
    shared = np.zeros(candidate.shape, np.float32)
    row1, row2 = np.repeat(np.arange(len(b1) - 1), np.diff(b1)), np.repeat(np.arange(len(b2) - 1), np.diff(b2))
    at1, at2 = np.searchsorted(both, g1), np.searchsorted(both, g2)
    on1 = at1 < len(both)
    on1[on1] = both[at1[on1]] == g1[on1]
    on2 = at2 < len(both)
    on2[on2] = both[at2[on2]] == g2[on2]
    row1, at1, row2, at2 = row1[on1], at1[on1], row2[on2], at2[on2]
    order1, order2 = np.argsort(at1, kind="stable"), np.argsort(at2, kind="stable")
    row1, at1, row2, at2 = row1[order1], at1[order1], row2[order2], at2[order2]
    width = max(1, (8 << 20) // max(1, len(b1) + len(b2)))
    for low in range(0, len(both), width):
        high = min(low + width, len(both))
        x, y = np.zeros((len(b1) - 1, high - low), np.float32), np.zeros((len(b2) - 1, high - low), np.float32)
        i, j = np.searchsorted(at1, [low, high]), np.searchsorted(at2, [low, high])
        x[row1[i[0] : i[1]], at1[i[0] : i[1]] - low] = 1
        y[row2[j[0] : j[1]], at2[j[0] : j[1]] - low] = 1
        shared += x @ y.T
    union = np.diff(b1)[:, None] + np.diff(b2)[None, :] - shared
    # shared / union >= threshold, with whole numbers of up to 24 bits on both sides
    return candidate & (shared.astype(np.float64) >= threshold * union.astype(np.float64) - 1e-9)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component in a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare_blocks(size: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by group: (k, near, links) of each text in each pair of blocks that it is in."""

    def compared(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        if not t.num_rows:
            return table([], [], [])
        k = t.column("k").chunk(0)
        side, weight = t.column("side").to_numpy(), t.column("n_docs").to_numpy()
        bands = np.stack(t.column("bands").to_numpy())
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(two)
        if within:
            two = one
        candidate = np.zeros((len(one), len(two)), bool)
        for band in range(bands.shape[1]):
            candidate |= bands[one, band][:, None] == bands[two, band][None, :]
        if within:
            np.fill_diagonal(candidate, False)
        if not candidate.any():
            return table([], [], [])
        data, bounds = utf8(t.column("text").chunk(0))
        starts, ends, word, at = words_of(data, bounds)
        grams, of = gram_sets(exact_numbers(LOWER[data], starts, ends, word), at, size)

        def sets(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            start, n = of[which], of[which + 1] - of[which]
            return grams[ranges(start, n)], np.concatenate([[0], np.cumsum(n)])

        linked = similar_in(sets(one), sets(two), candidate, threshold)
        if within:
            return table(k.take(pa.array(one)), k.take(pa.array(one[local_roots(linked)])), linked @ weight[one])
        n1 = len(one)
        square = np.zeros((n1 + len(two),) * 2, bool)
        square[:n1, n1:], square[n1:, :n1] = linked, linked.T
        both = np.concatenate([one, two])
        return table(k.take(pa.array(both)), k.take(pa.array(both[local_roots(square)])), np.concatenate([linked @ weight[two], linked.T @ weight[one]]))

    def table(k, near, links) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(near, pa.binary()), pa.array(np.asarray(links, np.int64))], ["k", "near", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column("g")[0].as_py() != group[a]:
                    yield compared(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield compared(held)

    return run


def candidate_blocks(sets: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(v, g, side): the pairs of blocks (g) that each text is compared in.  sets: v, n_bytes, bands.

    v is 64 bits of a text's digest: texts that share them would only be looked at together.
    """
    banded = sets.select("v", F.explode("bands").alias("h"))
    least = banded.groupBy("h").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    least = written(least.select("h", "least", "n"), "buckets")
    # Each text meets the least members of its bands.  One edge leads to the least of these; the
    # others among them are tied to it once, however many texts share them.
    met = dealt_join(banded, least.select("h", "least"), "h", hot_keys(least, "h", "n")).groupBy("v").agg(F.collect_set("least").alias("met"))
    met = written(met.select("v", F.array_min("met").alias("hub"), "met"), "met")
    edges = met.select(F.col("v").alias("a"), F.col("hub").alias("b")).union(met.select(F.explode("met").alias("a"), F.col("hub").alias("b")))
    clusters = components(edges.filter("a <> b").distinct())
    members = clusters.join(sets.groupBy("v").agg(F.sum("n_bytes").alias("n_bytes")), "v").join(met.select("v", "hub"), "v")
    members = written(members, "members")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n_bytes") / block_bytes)).cast("int").alias("parts")
    sized = written(members.groupBy("root").agg(parts, F.count(F.lit(1)).alias("n")), "sized")
    large_roots = hot_keys(sized, "root", "n")
    known = dealt_join(members, sized.select("root", "parts"), "root", large_roots)
    alone = known.filter("parts = 1").select("v", F.xxhash64("root").alias("g"), F.lit(0).alias("side"))
    # Large clusters: texts with one hub are together, as far as they fit.
    large = written(known.filter("parts > 1"), "large")
    hubs = large.groupBy("hub").agg(parts.alias("cuts"), F.count(F.lit(1)).alias("n"))
    placed = dealt_join(large, hubs.select("hub", "cuts"), "hub", hot_keys(hubs, "hub", "n"))
    cut = F.pmod(F.xxhash64("v", F.lit(1)), F.col("cuts"))
    placed = written(placed.select("v", "root", F.pmod(F.xxhash64("hub", cut), F.col("parts")).cast("int").alias("part")), "placed")
    shared = placed.join(sets.select("v", "bands"), "v").select("v", "root", "part", F.explode("bands").alias("h"))
    present = shared.groupBy("h").agg(F.collect_set("part").alias("there"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    present = written(present, "present")
    around = dealt_join(shared, present.select("h", "there"), "h", hot_keys(present, "h", "n")).groupBy("v", "root", "part").agg(F.collect_set("there").alias("there"))
    pairs = around.select("v", "root", "part", F.explode(F.array_distinct(F.flatten("there"))).alias("other"))
    g = F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other"))
    return alone.unionByName(pairs.select("v", g.alias("g"), (F.col("part") > F.col("other")).cast("int").alias("side")))


def linked_sets(docs: DataFrame, threshold: float, size: int, recall: float, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): (doc_id, t, n, k) of every row of docs, t a hash of its text, n its words and k its set; (k, rep, t, n_docs, root, links) of every set with words."""
    bands, rows = bands_and_rows(threshold, recall)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    same = F.xxhash64("text")
    signed = texts.select("doc_id", same.alias("t"), F.octet_length("text").cast("long").alias("n_bytes"), signature_udf(size, bands, rows)(F.col("text")).alias("s"))
    signed = written(signed.select("doc_id", "t", "n_bytes", "s.*"), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "n_bytes")).alias("first")
    sets = signed.filter("n > 0").groupBy("k", "v").agg(first, F.count(F.lit(1)).alias("n_docs"), F.min("bands").alias("bands"))
    sets = written(sets.select("k", "v", F.col("first.doc_id").alias("rep"), F.col("first.t").alias("t"), F.col("first.n_bytes").alias("n_bytes"), "n_docs", "bands"), "sets")
    groups = written(candidate_blocks(sets, block, block_bytes), "groups")
    wanted = groups.select("v").distinct().join(sets, "v").select("k", "rep", F.col("t").alias("of"))
    # One row for each text, also where a table repeats rows; then its copies for the pairs of blocks.
    own = (F.col("t") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    chosen = texts.withColumn("t", same).join(wanted, own).groupBy("k").agg(F.first("text").alias("text"))
    placed = groups.join(sets.select("v", "k", "n_docs", "bands"), "v").drop("v")
    dealt = placed.join(chosen, "k").select("g", "side", "k", "n_docs", "bands", "text")
    compared = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(compare_blocks(size, threshold), "k binary, near binary, links bigint")
    compared = written(compared, "compared")
    linked = components(compared.filter("k <> near").select(F.col("k").alias("a"), F.col("near").alias("b"))).withColumnRenamed("v", "k")
    links = compared.groupBy("k").agg(F.sum("links").alias("links"))
    known = sets.select("k", "rep", "t", "n_docs").join(linked, "k", "left").join(links, "k", "left")
    known = written(known.select("k", "rep", "t", "n_docs", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    return signed.select("doc_id", "t", "n", "k"), known


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = NGRAM, recall: float = RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, class_id, n_links, class_size) of every row of docs.

    n_links counts the other rows whose text has the similarity, copies of the own text
    among them.
    """
    rows, known = linked_sets(docs, threshold, size, recall, block, block_bytes)
    classes = written(known.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n_docs").alias("class_size"), F.count(F.lit(1)).alias("n")), "classes")
    own = dealt_join(known, classes.select("root", "class_id", "class_size"), "root", hot_keys(classes, "root", "n"))
    own = own.select("k", "class_id", "class_size", (F.col("links") + F.col("n_docs") - 1).alias("links"))
    empty = F.col("n") == 0
    slim = rows.select("doc_id", "n", "k")
    return dealt_join(slim, own, "k", hot_keys(known.select("k", "n_docs"), "k", "n_docs"), "left").select(
        "doc_id",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.when(empty, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of docs: that of the least id, rows without an id last, and of equal ids that with the least hash of its text.

    Rows go, not ids: another row with the id of one that goes is judged by its own text.  Of
    rows that are equal in id and text one stays.  Rows without words all stay.
    """
    rows, known = linked_sets(docs.select("doc_id", "text"), THRESHOLD, NGRAM, RECALL, BLOCK, BLOCK_BYTES)
    first = F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "t")).alias("first")
    classes = known.groupBy("root").agg(first, F.sum("n_docs").alias("size"), F.count(F.lit(1)).alias("n")).filter("size > 1")
    classes = written(classes.select("root", F.col("first.rep").alias("kept_id"), F.col("first.t").alias("kept_t"), "n"), "classes")
    own = dealt_join(known.select("k", "n_docs", "root"), classes.drop("n"), "root", hot_keys(classes, "root", "n"))
    own = written(own.drop("root"), "own")
    met = dealt_join(rows.filter("n > 0").select("doc_id", "t", "k"), own.drop("n_docs"), "k", hot_keys(own, "k", "n_docs"))
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("t") == F.col("kept_t"))
    met = written(met.groupBy("doc_id", "t", stays.alias("stays")).agg(F.count(F.lit(1)).alias("n")), "met")
    id_, t = (free_name(x, docs.columns) for x in ("key", "t"))
    key = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty()) == F.col(t))
    named = lambda found: found.select(F.col("doc_id").alias(id_), F.col("t").alias(t))
    left = docs.join(named(met.filter("NOT stays")), key, "left_anti")
    repeated = met.filter("stays AND n > 1")
    if repeated.isEmpty():
        return left
    several = left.join(named(repeated), key, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(named(repeated), key, "left_anti").unionByName(several)
