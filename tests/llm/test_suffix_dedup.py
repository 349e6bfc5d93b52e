import hashlib
import random

import numpy as np
import pytest

from lapidary.llm import suffix_dedup


def brute(rows, length, keep):
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, hashlib.sha256(texts[r]).digest()[:16]))
    seen, same = {}, {}
    if keep == "first":
        for r in order:
            same.setdefault((rows[r][0], texts[r]), r)
    for r in order:
        if keep == "first" and same[rows[r][0], texts[r]] != r:
            continue
        for i in range(len(texts[r]) - length + 1):
            seen.setdefault(texts[r][i : i + length], []).append((r, i))
    for r, raw in enumerate(texts):
        own = same.get((rows[r][0], raw), r)
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            there = seen[raw[i : i + length]]
            if (len(there) > 1) if keep == "none" else (there[0] != (own, i)):
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield rows[r][0], len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def made():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, twin = text(300), text(500)
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, twin), (6, twin), (None, text(260)), (7, "a" * 900), (8, "ab" * 300), (9, "x" + "ab" * 150)]
    for i in range(25):
        cut = rng.randrange(0, 60)
        rows.append((20 + i, text(rng.randrange(0, 300)) + passage[cut : cut + rng.choice([150, 199, 200, 240])] + text(rng.randrange(0, 300))))
    near = text(900)
    for i in range(8):
        edited = list(near)
        for _ in range(3):
            edited[rng.randrange(len(edited))] = "z"
        rows.append((60 + i, "".join(edited)))
    inside = text(220)
    rows += [(90, "".join(rng.choice("pqrs") for _ in range(suffix_dedup.SCAN_BYTES + 5000)) + passage)]  # longer than a step
    rows += [(80, inside + text(30) + inside), (81, text(40) + text(199)), (5, twin), (82, text(5000))]
    return rows


SMALL = {"hot_rows": 6, "sort_bytes": 5000}
DEALT = {"sampled": 1, "common_rows": 2}


@pytest.mark.parametrize(("keep", "length", "limits"), [("none", 200, {}), ("first", 200, SMALL), ("none", 40, SMALL), ("first", 40, SMALL), ("none", 200, {"hot_rows": 2}), ("none", 200, DEALT), ("first", 200, DEALT | SMALL)])
def test_against_brute_force(spark, keep, length, limits):
    rows = made()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lo int").repartition(3)
    got = suffix_dedup.without_repeats(frame, length, keep, with_text=False, **limits).collect()
    want = sorted(map(str, brute(rows, length, keep)))
    assert sorted(str(tuple(r)) for r in got) == want


def test_kept_text_and_empty_table(spark):
    rows = made()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(frame).collect()}
    assert got[5].kept == dict(rows)[5] and got[6].kept == ""
    assert suffix_dedup.without_repeats(frame.limit(0)).collect() == []


def test_longest_previous_factors():
    """Against the definition, for all places of texts with many repeats."""
    rng = np.random.default_rng(6)
    for n in (1, 9, 40, 300):
        data = rng.integers(97, 99, n).astype(np.uint8)
        raw = bytes(data)
        for length in (1, 7, 12, 20):
            windows = np.arange(max(0, n - length + 1))
            levels = suffix_dedup.ranks_by_length(data, length)

            def shared(i, j, length=length, raw=raw):
                return next((k for k in range(length) if raw[i + k] != raw[j + k]), length)

            for backwards in (False, True):
                got = suffix_dedup.longest_previous(data, levels, windows, length, backwards)
                want = [max((shared(i, j) for j in windows if (j > i if backwards else j < i)), default=0) for i in windows]
                assert got.tolist() == want
    values = rng.integers(0, 50, 200)
    assert suffix_dedup.previous_smaller(values).tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) if len(set(values.tolist())) == 200 else next((j for j in range(i - 1, -1, -1) if values[j] <= values[i]), -1) for i in range(200)]


def test_meet_over_many_batches():
    """The judgement does not depend on where batches end."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 6, 400))
    g = np.concatenate([np.sort(rng.integers(0, 9, (h == x).sum())) for x in range(6)])
    columns = {"kind": pa.array(rng.choice([0, 0, 0, 1, 2], 400).astype(np.int8)), "h": h, "g": g, "g2": g * 3, "doc_id": np.arange(400), "d": np.arange(400), "at": np.ones(400, np.int64), "dealt": np.zeros(400, bool)}
    full = pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))
    want = sorted(set(str(r) for b in suffix_dedup.meet(False)(iter([full])) for r in b.to_pylist()))
    for size in (1, 7, 50):
        parts = [full.slice(i, size) for i in range(0, 400, size)]
        assert sorted(set(str(r) for b in suffix_dedup.meet(False)(iter(parts)) for r in b.to_pylist())) == want
        # Hot anchors send every different stretch on; what they find to be repeated is so.
        hot = [r for b in suffix_dedup.meet(False, 20)(iter(parts)) for r in b.to_pylist()]
        assert {r["doc_id"] for r in hot if r["kind"] == 1} == {r["doc_id"] for b in suffix_dedup.meet(False)(iter([full])) for r in b.to_pylist() if r["kind"] == 1}
