import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lapidary.llm import resampling
from tests.llm.test_decontaminate import WORD, lower


def features(text):
    own = WORD.findall(lower(text))
    return own, own + [f"{a} {b}" for a, b in zip(own, own[1:], strict=False)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, target, percent=25):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10000) / ((a + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for doc, text in docs:
        own, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(own) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def made(n=160):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(200)] + ["É", "été", "ZZ", "long" * 20, "x" * 64, "y" * 65, "z" * 63]
    text = lambda k: rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)]
    docs += [(3, text(40)), (3, text(41)), (None, text(30)), (None, text(35)), (None, None), (5, ""), (6, "one"), (9, "A " * 5000), (10, "q" * 3000)]
    docs += [(77, "the same words " * 10)] * 30
    return docs, [text(20) for _ in range(9)] + [None, "", "w1"]


def shown(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize(("partitions", "rewrite"), [(1, 8), (5, 1)])
def test_against_brute_force(spark, monkeypatch, partitions, rewrite):
    monkeypatch.setattr(resampling, "REWRITE", rewrite)
    docs, target = made()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, row int").repartition(partitions)
    wanted = spark.createDataFrame([(t, 2) for t in target], "text string, doc_id int")
    got = resampling.resampled(frame, wanted)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert shown(got.collect()) == shown(brute(docs, target))


def test_checksums_of_features():
    docs, _ = made()
    texts = [t or "" for _, t in docs]
    words, pairs, at, follows = resampling.feature_buckets(pa.array(texts), 10000)
    nth = np.cumsum(follows) - 1
    for i, text in enumerate(texts):
        own, found = features(text)
        assert words[at[i] : at[i + 1]].tolist() == [bucket(w) for w in own]
        assert [int(pairs[nth[j]]) for j in range(at[i], at[i + 1]) if follows[j]] == [bucket(f) for f in found[len(own) :]]


@pytest.mark.parametrize("nth", [1, 37, 200])
def test_cutoff_is_the_nth_key(spark, nth):
    rng = random.Random(nth)
    keys = [(rng.randint(0, 5), rng.choice([None, 1, 2, 3]), rng.randint(0, 1), i) for i in range(200)]
    table = spark.createDataFrame(keys, "score long, doc_id long, n_features long, row long").repartition(3)
    order = sorted((-s, resampling.NO_ID if d is None else d, f, r) for s, d, f, r in keys)
    s, d, f, r = order[nth - 1]
    assert resampling.cutoff_key(table, nth) == (-s, d, f, r)
    assert resampling.cutoff_key(table, 201) is None


def test_few_and_no_documents(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, target).collect() == []
    short = spark.createDataFrame([(1, "a b c"), (2, None)], none.schema)
    assert shown(resampling.resampled(short, target).collect()) == shown(brute([(1, "a b c"), (2, None)], ["a b"]))
    three = [(i, "word " * 30) for i in range(3)]  # a quarter of three is none
    assert shown(resampling.resampled(spark.createDataFrame(three, none.schema), target.limit(0)).collect()) == shown(brute(three, []))


def test_half_is_drawn_when_asked(spark):
    docs, target = made(40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = resampling.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=50)
    assert shown(got.collect()) == shown(brute(docs, target, 50))
