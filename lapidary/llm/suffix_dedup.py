"""Removal of long byte strings that the corpus repeats, by suffix arrays of what may match.

A string of :data:`LENGTH` bytes is repeated when it also starts at another place, in the
same text or another.  Whole texts are compared, never across their ends.

1. Every window of LENGTH bytes is named by its least :data:`ANCHOR`-byte piece (by hash,
   leftmost of equals).  Equal windows have the same piece at the same place, so they can
   only meet at that anchor.  One row goes out for each stretch of windows with one anchor:
   some hundredth of the bytes.  Within a batch, equal stretches are folded first.
2. Rows meet by anchor.  An anchor that stands once ends there.  Stretches with equal
   neighbourhoods (by 128 bits of BLAKE2b) are repeated as a whole.  Anchors with different
   neighbourhoods go on, one row for each different one.
3. Only these fetch their bytes, at most 2 * LENGTH each.  Tasks sort the suffixes of their
   stretches by prefix doubling up to LENGTH bytes and fill the array of longest previous
   factors: in suffix order, the nearest suffixes before and behind that stand at smaller
   positions hold the longest earlier match, and its length is read from the doubling's
   ranks.  A window whose previous factor has LENGTH bytes is a later copy.  With positions
   counted backwards the same array finds later matches.
4. Anchors with more different neighbourhoods than a task should hold (:data:`HOT_ROWS`) are
   dealt out again by the digest of each window, which splits them without loss.  Anchors that
   a sample of the texts shows to be that common are dealt out before they meet in one task.
   Which way an anchor takes has no influence on what is found.

``keep="first"`` removes windows that an earlier place has (in order of doc_id, digest,
position), so that the first copy stays; ``keep="none"`` removes every copy.

Nulls and ties: a null text is empty.  Rows that repeat id and text are copies of each other
under "none", and one text under "first".  Texts shorter than LENGTH stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import BASE_INVERSE, HOT_SHARE, mixed, powers, prefix_hashes, steps, text_or_empty, utf8, written

LENGTH = 200
ANCHOR = 48
#: Rows of one anchor that a task looks at together.
HOT_ROWS = 20_000
#: One text in so many is looked at to find anchors that have more rows than a task should hold.
SAMPLED = 64
COMMON_ROWS = HOT_ROWS // SAMPLED
#: Bytes of text whose anchors a task looks for together.
SCAN_BYTES = 512 << 10
#: Bytes whose suffixes a task sorts together, unless one anchor has more.
SORT_BYTES = 1 << 20


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each span, as two numbers."""
    blake2b, view = hashlib.blake2b, memoryview(raw)
    both = np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u8")
    return both[::2], both[1::2]


def anchored(data: np.ndarray, bounds: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, left, h, g, g2) of each stretch of windows with one anchor.

    lo and hi bound the stretch in its text, left is where the anchor stands in it, h
    names the anchor, g and g2 the whole stretch with its anchor.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    if len(data) < length:
        return none
    sums = prefix_hashes(data)
    n = len(data) - anchor + 1
    piece = mixed((sums[anchor:] - sums[:n]) * powers(BASE_INVERSE, n))
    least = (piece & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width, span = length - anchor + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    windows = len(data) - length + 1
    rest = width - span
    least = np.minimum(least[:windows], least[rest : rest + windows])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:windows]
    valid = bounds[row + 1] - np.arange(windows) >= length
    edge = np.ones(windows, bool)
    edge[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], windows) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    lo, hi, left = first, last + length, at[first] - first
    g, g2 = digests(data.tobytes(), lo, hi)
    g = g ^ mixed(left.astype(np.uint64) + np.uint64(1))
    start = bounds[row[first]]
    return row[first], lo - start, hi - start, left, piece[at[first]], g, g2


#: kind: 0 a stretch, 2 a stretch that stands for several, 1 a span that is known to be repeated.  at: where it begins, and ends.
ANCHORS = "kind tinyint, h bigint, g bigint, g2 bigint, doc_id {id}, d bigint, at bigint"
SPANS = "doc_id {id}, d bigint, at bigint"


def placed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo.astype(np.int64) << 32 | hi.astype(np.int64)


def place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 32, at & 0xFFFFFFFF


def anchor_rows(length: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (doc_id, d, text): stretches, of equal ones in a batch the first by (doc_id, d, place), and the spans of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, parts = 0, []
            for part in steps(batch, "text", SCAN_BYTES):
                found = anchored(*utf8(part.column("text")), length, anchor)
                parts.append((found[0] + done, *found[1:]))
                done += part.num_rows
            if not parts:
                continue
            row, lo, hi, _, h, g, g2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(row):
                continue
            ids = pa.table({"doc_id": batch.column("doc_id"), "d": batch.column("d")})
            rank = np.empty(batch.num_rows, np.int64)
            rank[pc.sort_indices(ids, sort_keys=[("doc_id", "ascending"), ("d", "ascending")], null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
            order = np.lexsort((lo, rank[row], g2, g, h))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0) | (np.diff(g2[order]) != 0)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(order)))
            late, first = order[~new], order[first]
            r, a, b = merged(row[late], lo[late], hi[late])
            # known spans go along under any key
            away = mixed(np.arange(len(r), dtype=np.uint64) + g[:1])
            kinds = np.concatenate([np.where(count > 1, 2, 0), np.ones(len(r), np.int64)])
            keys = [np.concatenate([x[first], away]).view(np.int64) for x in (h, g, g2)]
            source = pa.array(np.concatenate([row[first], r]))
            at = placed(np.concatenate([lo[first], a]), np.concatenate([hi[first], b]))
            columns = [pa.array(kinds, pa.int8()), *map(pa.array, keys), batch.column("doc_id").take(source), batch.column("d").take(source), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "h", "g", "g2", "doc_id", "d", "at"])

    return run


def merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the spans of each row."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    wide = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + row * wide) - row * wide
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return row[first], lo[first], reach[np.append(first[1:], len(row)) - 1]


MET = "kind tinyint, h bigint, doc_id {id}, d bigint, at bigint, need boolean"


def meet(keep_first: bool, hot_rows: int = HOT_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by (h, g, g2, doc_id, d, at): kind 1 for repeated spans, kind 0 for stretches to compare, kind 2 for those of hot anchors.

    Rows marked as dealt belong to an anchor whose other stretches are elsewhere: a hot one.
    """

    def judge(t: pa.RecordBatch, hot: bool, before: tuple[int, int] | None) -> pa.RecordBatch:
        h, g, g2, kind, dealt = (t.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "g2", "kind", "dealt"))
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_g = new_h.copy()
        new_g[1:] |= (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])
        first = np.flatnonzero(new_g)
        run = np.cumsum(new_g) - 1
        total = np.add.reduceat(np.where(kind == 2, 2, 1), first)
        group = np.cumsum(new_h) - 1
        runs = np.bincount(group[first])
        again = ~new_g | ((g == before[0]) & (g2 == before[1]) if before is not None else False)
        covered = again if keep_first else (total[run] > 1) | again
        on = new_g & (hot | dealt | (runs[group] > 1))
        a, b = np.flatnonzero(covered), np.flatnonzero(on)
        rows = pa.array(np.concatenate([a, b]))
        kinds = np.concatenate([np.ones(len(a), np.int64), np.where(hot | dealt[b], 2, 0)])
        need = np.concatenate([np.zeros(len(a), bool), ~covered[b]])
        take = {c: t.column(c).take(rows) for c in ("h", "doc_id", "d", "at")}
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int8()), *take.values(), pa.array(need)], ["kind", *take, "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        hot: tuple[int, tuple[int, int]] | None = None  # the hot anchor being read, and the last stretch of it

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            known = batch.filter(pc.equal(batch.column("kind"), 1))
            if known.num_rows:
                take = {c: known.column(c) for c in ("kind", "h", "doc_id", "d", "at")}
                yield pa.RecordBatch.from_arrays([*take.values(), pa.array(np.zeros(known.num_rows, bool))], [*take, "need"])
                batch = batch.filter(pc.not_equal(batch.column("kind"), 1))
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            if hot and h[0] != hot[0]:
                if held:
                    yield judge(joined(), True, hot[1])
                    held = []
                hot = None
            last = int(np.searchsorted(-(h != h[-1]).astype(np.int8), 0))  # where the last anchor begins
            if last:
                held.append(batch.slice(0, last))
                yield judge(joined(), False, None) if not hot else from_hot(joined(), hot, judge)
                held, hot = [], None
            held.append(batch.slice(last))
            if sum(x.num_rows for x in held) >= hot_rows:
                # equal stretches stay together, unless there are none else
                t = joined()
                g, g2 = (t.column(c).to_numpy() for c in ("g", "g2"))
                cut = int(np.flatnonzero((g == g[-1]) & (g2 == g2[-1]))[0]) or t.num_rows
                yield judge(t.slice(0, cut), True, hot[1] if hot else None)
                hot, held = (int(h[-1]), (int(g[cut - 1]), int(g2[cut - 1]))), [t.slice(cut)] if cut < t.num_rows else []
        if held:
            yield judge(joined(), bool(hot), hot[1] if hot else None)

    return run


def from_hot(t: pa.RecordBatch, hot: tuple[int, tuple[int, int]], judge) -> pa.RecordBatch:
    """Rows that begin with the rest of a hot anchor."""
    n = int((t.column("h").to_numpy() == hot[0]).sum())
    return pa.Table.from_batches([judge(t.slice(0, n), True, hot[1]), *([judge(t.slice(n), False, None)] if n < t.num_rows else [])]).combine_chunks().to_batches()[0]


def dense(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the different ones."""
    order = np.argsort(values)
    ranks = np.empty(len(values), np.int64)
    sorted_ = values[order]
    ranks[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    return ranks


def ranks_by_length(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, ranks of all suffixes by their first ``size`` bytes), by doubling up to ``length``; what reaches past the end counts the end as zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = min(8, length)
    first = np.zeros(len(data), np.uint64)
    for i in range(size):
        first = first << np.uint64(8) | padded[i : i + len(data)].astype(np.uint64)
    levels = [(size, dense(first).astype(np.int32))]
    while size < length:
        rank = levels[-1][1].astype(np.int64)
        step = min(size, length - size)
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - step)] = rank[step:] + 1
        size += step
        levels.append((size, dense(rank * (len(rank) + 1) + after).astype(np.int32)))
    return levels


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    return ranks_by_length(data, length)[-1][1]


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place, the nearest place before it with a smaller value, or -1.

    All places jump at once: what stands between a place and its pointer is greater, so a
    pointer to a greater value may be replaced by that one's own pointer.
    """
    before = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(before >= 0)
    while len(open_ := open_[before[open_] >= 0]) and len(open_ := open_[values[before[open_]] > values[open_]]):
        before[open_] = before[before[open_]]
    return before


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, ``length`` at most, the suffixes at a and b share; both hold that many."""
    size, rank = levels[-1]
    out = np.where(rank[a] == rank[b], size, 0)
    open_ = np.flatnonzero(out < size)
    for size, rank in levels[-2::-1]:
        here = open_[out[open_] + size <= length]
        here = here[rank[a[here] + out[here]] == rank[b[here] + out[here]]]
        out[here] += size
    for _ in range(7):  # fewer bytes than the first ranks have
        here = open_[out[open_] < length]
        here = here[data[a[here] + out[here]] == data[b[here] + out[here]]]
        out[here] += 1
        open_ = here
    return out


def longest_previous(data: np.ndarray, levels: list[tuple[int, np.ndarray]], windows: np.ndarray, length: int, backwards: bool = False) -> np.ndarray:
    """For each window, the longest prefix, ``length`` at most, that a window at a smaller place shares (a greater one, if backwards)."""
    rank = levels[-1][1][windows]
    position = -windows if backwards else windows
    order = np.lexsort((position, rank))  # suffix order; equal prefixes by position
    inverse = position[order]
    longest = np.zeros(len(windows), np.int64)
    smaller = [previous_smaller(inverse), len(order) - 1 - previous_smaller(inverse[::-1])[::-1]]
    for near in smaller:
        some = np.flatnonzero((near >= 0) & (near < len(order)))
        own = order[some]
        longest[own] = np.maximum(longest[own], common_prefixes(data, levels, windows[own], windows[order[near[some]]], length))
    return longest


def matched(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, later: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, has an earlier match, has a later match) for every window within the stretches [start, end)."""
    windows = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(starts, ends, strict=True)]) if len(starts) else np.zeros(0, np.int64)
    levels = ranks_by_length(data, length)
    earlier = longest_previous(data, levels, windows, length) >= length
    return windows, earlier, longest_previous(data, levels, windows, length, True) >= length if later else np.zeros(len(windows), bool)


def compare(length: int, keep_first: bool, sort_bytes: int = SORT_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over stretches with their bytes, sorted by (h, doc_id, d, at): the repeated spans of those that need it."""

    def judge(t: pa.Table) -> pa.RecordBatch:
        # equal parts of a column are end to end already
        t = t.combine_chunks()
        region = t.column("region").chunk(0)
        data, bounds = utf8(region)
        need, lo = t.column("need").to_numpy(zero_copy_only=False), place(t.column("at").to_numpy())[0]
        windows, earlier, later = matched(data, bounds[:-1], bounds[1:], length, not keep_first)
        hit = windows[earlier if keep_first else earlier | later]
        row = np.searchsorted(bounds, hit, side="right") - 1
        hit, row = hit[need[row]], row[need[row]]
        start = hit - bounds[row] + lo[row]
        row, a, b = merged(row, start, start + length)
        rows = pa.array(row)
        return pa.RecordBatch.from_arrays([t.column("doc_id").chunk(0).take(rows), t.column("d").chunk(0).take(rows), pa.array(placed(a, b))], ["doc_id", "d", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in steps(batch, "region", sort_bytes):
                h = part.column("h").to_numpy()
                cut = int(np.searchsorted(-(h != h[-1]).astype(np.int8), 0))
                if size >= sort_bytes and (cut or (held and held[-1].column("h")[held[-1].num_rows - 1].as_py() != h[0])):
                    # everything before the last anchor is complete
                    if cut:
                        held.append(part.slice(0, cut))
                        part = part.slice(cut)
                    yield judge(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += len(utf8(part.column("region"))[0])
        if held:
            yield judge(pa.Table.from_batches(held))

    return run


def window_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row of kind 0 for each window of each stretch, under the digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "region", SORT_BYTES // 16):
                data, bounds = utf8(part.column("region"))
                count = np.diff(bounds) - length + 1
                row = np.repeat(np.arange(part.num_rows), count)
                start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + bounds[row]
                g, g2 = (pa.array(x.view(np.int64)) for x in digests(data.tobytes(), start, start + length))
                lo = start - bounds[row] + place(part.column("at").to_numpy())[0][row]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(row)), pa.int8()), g, g, g2, part.column("doc_id").take(rows), part.column("d").take(rows), pa.array(placed(lo, lo + length))], ["kind", "h", "g", "g2", "doc_id", "d", "at"])

    return run


def common_anchors(slim: DataFrame, length: int, anchor: int, kind: str, sampled: int = SAMPLED, common_rows: int = COMMON_ROWS) -> DataFrame:
    """Anchors that have many different neighbourhoods in a sample of the texts; at most HOT_SHARE of them."""
    few = slim.filter(F.pmod(F.xxhash64("doc_id", "d"), F.lit(sampled)) == 0).mapInArrow(anchor_rows(length, anchor), ANCHORS.format(id=kind))
    counts = few.filter("kind <> 1").groupBy("h").agg(F.count_distinct("g").alias("n"))
    counts = written(counts.filter(F.col("n") >= common_rows), "common")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") * HOT_SHARE > F.lit(total)).select("h")


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", hot_rows: int = HOT_ROWS, sort_bytes: int = SORT_BYTES, sampled: int = SAMPLED, common_rows: int = COMMON_ROWS) -> DataFrame:
    """(doc_id, d, spans): the byte spans to remove from each text that has any.  docs: doc_id, text (no nulls), d (of the text's digest)."""
    first = keep == "first"
    anchor = max(1, min(ANCHOR, length // 4))
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = ["h", "g", "g2", "doc_id", "d", "at"]
    slim = docs.select("doc_id", "d", "text")
    rows = slim.mapInArrow(anchor_rows(length, anchor), ANCHORS.format(id=kind))
    hot = common_anchors(slim, length, anchor, kind, sampled, common_rows).select("h", F.lit(True).alias("common"))
    rows = rows.join(F.broadcast(hot), "h", "left").withColumn("dealt", F.coalesce("common", F.lit(False))).drop("common")
    met = rows.repartition("h", F.when(F.col("dealt"), F.col("g"))).sortWithinPartitions(*order).mapInArrow(meet(first, hot_rows), MET.format(id=kind))
    met = written(met, "met")
    on = met.filter("kind <> 1")
    fetched = slim.alias("t").join(on.alias("m"), (F.col("t.d") == F.col("m.d")) & F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")))
    lo, hi = F.shiftright("m.at", 32), F.col("m.at").bitwiseAND(F.lit(0xFFFFFFFF))
    region = F.substring(F.col("t.text").cast("binary"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    fetched = fetched.select("m.kind", "m.h", "m.doc_id", "m.d", "m.at", "m.need", region.alias("region"))
    cold = fetched.filter("kind = 0").repartition("h").sortWithinPartitions("h", "doc_id", "d", "at")
    compared = cold.mapInArrow(compare(length, first, sort_bytes), SPANS.format(id=kind))
    hot = fetched.filter("kind = 2").select("doc_id", "d", "at", "region").mapInArrow(window_rows(length), ANCHORS.format(id=kind)).withColumn("dealt", F.lit(False))
    windows = hot.repartition("h").sortWithinPartitions(*order).mapInArrow(meet(first, hot_rows), MET.format(id=kind))
    spans = [x.filter("kind = 1").select("doc_id", "d", "at") for x in (met, windows)]
    found = compared.union(spans[0]).union(spans[1])
    return found.groupBy("doc_id", "d").agg(F.collect_list("at").alias("spans"))


CUT = "n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def cut_udf(with_text: bool) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(CUT)
    def udf(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, own in zip(texts, spans, strict=True):
            if not own.is_valid:
                rows.append((0, 0, None, None))
                continue
            raw = text.as_py().encode()
            lo, hi = place(np.asarray(own.values))
            _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
            kept = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
            # a cut within a character leaves bytes that are no text
            rows.append((int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["n_removed", "n_spans", "kept_sha256", "kept"])

    return udf


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", with_text: bool = True, **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept is the text that is left, on request."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    # 60 bits of the digest tell texts with one id apart; not null, so that both uses of the texts share a shuffle
    plain = docs.select("doc_id", text_or_empty().alias("text")).withColumn("d", F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint")).filter("d IS NOT NULL").select("doc_id", "d", "text")
    source = plain.dropDuplicates(["doc_id", "d"]) if keep == "first" else plain
    spans = repeated_spans(source, length, keep, **limits)
    joined = plain.alias("t").join(spans.alias("s"), (F.col("t.d") == F.col("s.d")) & F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    joined = joined.select("t.doc_id", "t.text", "s.spans")
    cut = cut_udf(with_text)(F.when(F.col("spans").isNotNull(), F.col("text")).otherwise(F.lit("")), F.col("spans"))
    joined = joined.withColumn("x", cut)
    return joined.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "x.n_removed",
        "x.n_spans",
        F.coalesce("x.kept_sha256", sha).alias("kept_sha256"),
        *([F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.col("x.kept")).alias("kept")] if with_text else []),
    )
