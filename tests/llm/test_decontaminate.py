import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lapidary.llm import decontaminate
from tests.llm.test_jaccard_join import thue_morse

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = WORD.findall(lower(text))
        for i in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[i : i + 10]), set()).add(item)
    for doc, text in docs:
        own, hit, found = WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if (w := tuple(own[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in windows[w] if x is not None}
        yield doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def made():
    rng = random.Random(3)
    words = [f"w{i}é" if i % 3 else f"W{i}" for i in range(12)] + ["zz", "0x", "ß"]
    text = lambda n: rng.choice([" ", "--", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([11, 14, 25]))) for i in range(20)] + [(20, "one only"), (21, ""), (22, None), (None, text(12)), (3, text(13)), (23, "Zq")]
    docs = [(None, None), (1, ""), (2, "..."), (2, "...")]
    for i in range(60):
        parts = [text(rng.randint(0, 40)), rng.choice(items)[1] or "", text(3), rng.choice(items)[1] or ""]
        docs.append((i + 3, " , ".join(parts)))
    docs.append((100, "One, only! zq " + text(3000)))
    # long words that many hashes take for the same; one is an item, the other is clean
    docs += [(101, "a " + thue_morse("ab") + " b"), (102, "a " + thue_morse("ba") + " b"), (103, "W1 zz " * 40)]
    items += [(24, thue_morse("ab")), (25, " ".join(["w1", "zz"] * 6))]
    return docs, items


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(decontaminate, "mixed_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) & np.uint64(3))
    docs, items = made()
    found = decontaminate.search_block(decontaminate.block_of([(None if i is None else str(i), t or "") for i, t in items]), pa.array([t or "" for _, t in docs]), [None] * len(docs), False)
    for r, (_, n_words, n_hit, n_items, _, _) in zip(found.to_pylist(), brute(docs, items), strict=True):
        assert (r["n_words"], r["n_hit"], len(r["items"])) == (n_words, n_hit, n_items)


def test_against_brute_force(spark, monkeypatch):
    docs, items = made()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(map(str, brute(docs, items)))
    for block_bytes, sent in ((1 << 20, 4), (300, 4), (900, 1)):
        monkeypatch.setattr(decontaminate, "SENT_BLOCKS", sent)
        got = decontaminate.contamination(frame, bench, block_bytes)
        assert sorted(str(tuple(r)) for r in got.collect()) == expected
    assert decontaminate.contamination(frame.limit(0), bench).collect() == []
    assert {r.n_hit for r in decontaminate.contamination(frame, bench.limit(0)).collect()} == {0}


def test_cut(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Straße, {passage}! end", "en", 1, 9), (2, "clean text", None, 2, 10)], "doc_id long, text string, _found string, Found int, n_chars long")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = decontaminate.decontaminated(docs, bench).orderBy("doc_id").collect()
    assert got[0].text == "Straße, ! end" and got[0].n_chars == 13
    assert tuple(got[1]) == (2, "clean text", None, 2, 10)


def test_index_finds_all():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 4, 500), 0)
    index = decontaminate.ShardIndex(text)
    patterns = rng.integers(0, 5, (200, 4))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        there = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == there
