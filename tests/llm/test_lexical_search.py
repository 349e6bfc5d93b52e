import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lapidary.llm import decontaminate, lexical_search
from tests.llm.test_decontaminate import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, top=10):
    terms = [[lower(t) for t in TERM.findall(text or "")] for _, text in docs]
    n_docs, n_all = sum(map(bool, terms)), sum(map(len, terms))
    for item, text in items:
        own = {lower(t) for t in TERM.findall(text or "")}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for d in terms) + 1))) for t in own}
        found = []
        for (doc, _), d in zip(docs, terms, strict=True):
            if d:
                m = 100 - 90 + (90 * len(d) * n_docs) // n_all
                score = sum(weight[t] * (10**9 * d.count(t) // (1000 * d.count(t) + 8 * m)) for t in own if t in d)
                if score > 0:
                    found.append((-score, doc is None, doc or 0))
        for rank, (score, missing, doc) in enumerate(sorted(found)[:top], 1):
            yield item, rank, None if missing else doc, -score


def made():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)] + ["É", "été", "ZZ", "x-y", "_"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 25))) for i in range(120)]
    same = text(12)
    docs += [(1000 - i, same if i % 2 else same.upper() + " unknown"[: 0 if i % 3 else 8]) for i in range(40)]  # copies, and texts with the same bag
    docs += [(500, "W3 w3 w3"), (500, "W3 w3 w3"), (None, "w3 w3"), (None, None), (7, ""), (8, "..."), (9, "w1 " * 3000)]
    items = [(i, text(rng.choice([1, 3, 9, 20]))) for i in range(15)] + [(20, "unheard of"), (21, None), (22, ""), (None, "w3"), (3, "W3 w3"), (23, same)]
    return docs, items


def shown(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize(("partitions", "block_bytes"), [(1, 1 << 20), (4, 200)])
def test_against_brute_force(spark, block_bytes, partitions):
    docs, items = made()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, bag string, h int").repartition(partitions)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int")
    got = lexical_search.ranked(frame, asked, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert shown(got.collect()) == shown(brute(docs, items))


def test_terms_that_share_a_hash(spark, monkeypatch):
    for module in (decontaminate, lexical_search):
        monkeypatch.setattr(module, "words_of", with_few_hashes(decontaminate.words_of))
    docs, items = made()
    block = lexical_search.items_of([(i, t or "") for i, t in items])
    data = [t or "" for _, t in docs]
    class Sent:
        value = block

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array(data)], ["doc_id", "text"])
    names = [bytes(block.terms.letters[a : a + n]).decode() for a, n in zip(block.terms.starts, block.terms.lengths, strict=True)]
    rows = [r for b in lexical_search.bagged(Sent)(iter([batch])) for r in b.to_pylist()]
    for r, text in zip(rows, data, strict=True):
        found = np.frombuffer(r["bag"], "<i4")
        half = len(found) // 2
        own = [lower(t) for t in TERM.findall(text)]
        assert r["n"] == len(own)
        assert {names[t]: n for t, n in zip(found[:half], found[half:], strict=True)} == {t: own.count(t) for t in own if t in names}


def with_few_hashes(words_of):
    def few(data, bounds):
        starts, ends, hashes, at = words_of(data, bounds)
        return starts, ends, hashes & np.uint64(3), at

    return few


def test_equal_bags_are_one_class(spark):
    docs = [(i, "a b b" if i % 2 else "B b A") for i in range(50)] + [(60, "a b b c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    block = next(lexical_search.item_blocks(items))
    bags = frame.mapInArrow(lexical_search.bagged(spark.sparkContext.broadcast(block)), "doc_id bigint, n bigint, bag binary")
    found = sorted(r.ids for r in lexical_search.classes_of(bags, 51, 154, 10).collect())
    assert found == [list(range(10)), [60]]  # n and so m differ for the last one


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert lexical_search.ranked(none, items).collect() == []
    assert lexical_search.ranked(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lexical_search.ranked(docs, items).collect()] == [(1, 1, 1)]
