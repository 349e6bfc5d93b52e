import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lapidary.llm import common, jaccard_join
from lapidary.llm.components import components
from lapidary.llm.decontaminate import LOWER, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    near = [[i != j and bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in range(len(rows)) if near[i][j])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    for i, (doc, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        yield doc, min(own, default=None), sum(near[i]), label.count(label[i])


def made():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["é", "ßa", "日本"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(1, None), (2, ""), (3, "?!"), (4, "One two"), (5, "one, TWO"), (6, "one two three"), (7, " ".join(text(6000)))]
    passage = text(30)
    for i in range(25):
        base = text(rng.choice([8, 40, 90, 200]))
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy)))
        rows.append((len(rows) + 10, " ".join(passage + text(12))))
    chain = text(60)
    for i in range(30):  # each is near the next, the ends are not
        rows.append((1000 + i, " ".join(chain)))
        chain = chain[1:] + text(1)
    rows += [rows[20], rows[20], (None, rows[25][1]), (None, "only rows without an id say this"), (None, "only rows without an id say this")]
    rows += [(2000, "A b A b A b A b"), (2001, "a b a b a b a b a b"), (2002, "b a b a b a")]  # equal sets, other words
    return rows


def thue_morse(letters, n=1024):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize(("block", "block_bytes"), [(512, 1 << 20), (7, 1 << 20), (100, 900)])
def test_against_brute_force(spark, block, block_bytes):
    rows = made()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = jaccard_join.similarity_classes(frame, block=block, block_bytes=block_bytes).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(x) for x in brute(rows))


def test_words_are_told_apart_by_their_bytes():
    """Words that many hashes take for the same, and hashes that tell nothing apart."""
    one, two = thue_morse("ab"), thue_morse("ba")
    texts = pa.array([f"{one} x y z u", f"{two} x y z u", f"{one} x y z u", ""])
    data, bounds = common.utf8(texts)
    starts, ends, word, at = words_of(data, bounds)
    assert len(set(word.tolist())) == 6
    for hashes in (word, np.zeros(len(word), np.uint64), word & np.uint64(1)):
        number = common.exact_numbers(LOWER[data], starts, ends, hashes)
        assert number[0] == number[10] != number[5] and len(set(number.tolist())) == 6
        grams, of = jaccard_join.gram_sets(number, at, 5)
        assert [grams[a:b].tolist() for a, b in zip(of, of[1:], strict=False)] == [[grams[0]], [grams[1]], [grams[0]], []] and grams[0] != grams[1]


def test_grams_are_told_apart_by_their_words(monkeypatch):
    monkeypatch.setattr(jaccard_join, "gram_hashes", lambda word, at, size: (np.zeros(max(0, at[-1] - 4), np.uint64), None))
    rng = np.random.default_rng(5)
    number = rng.integers(0, 3, 60)
    grams, of = jaccard_join.gram_sets(number, np.array([0, 60]), 5)
    assert len(grams) == len({tuple(number[i : i + 5]) for i in range(56)}) and of.tolist() == [0, len(grams)]


def test_a_chain_is_not_copied_all_to_all(spark):
    """Each text is near its neighbours only: copies follow the number of texts and not its square."""
    rng = random.Random(2)
    words = [rng.choice(string.ascii_lowercase) + str(i) for i in range(60 + 900)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    size, counts = len(rows), []
    for block in (16, 1000):
        signed = frame.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), jaccard_join.signature_udf(5, *jaccard_join.bands_and_rows(0.8, 0.99999))(F.col("text")).alias("s")).select("n_bytes", "s.*")
        counts.append(jaccard_join.candidate_blocks(signed, block, 1 << 20).count())
    assert counts[1] == size and counts[0] < 15 * size  # some 56 blocks
    assert {r.class_id for r in jaccard_join.similarity_classes(frame, block=16).collect()} == {0}


def test_one_of_each(spark):
    rows = made()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = jaccard_join.one_of_each(frame)
    assert got.columns == frame.columns
    want = {d for d, c, _, _ in brute(rows) if d == c}
    assert {r.doc_id for r in got.collect()} - {None} == want - {None}
    assert jaccard_join.similarity_classes(frame.limit(0)).collect() == []


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.bands_and_rows(0.8, 0.99999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 and bands * rows <= jaccard_join.MOST_HASHES


def test_joins_of_hot_keys(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(200)] + [(None, 1)], "k long, v long")
    few = spark.createDataFrame([(7, "hot"), (1, "x"), (9, "none")], "k long, name string")
    hot = spark.createDataFrame([(7,), (50,)], "k long")
    for how in ("inner", "left"):
        got = common.dealt_join(rows, few, "k", hot, how).select("k", "v", "name").collect()
        assert sorted(map(str, got)) == sorted(map(str, rows.join(few, "k", how).select("k", "v", "name").collect()))
    counts = spark.createDataFrame([(i, 1) for i in range(30_000)] + [(30_000, 40)], "k long, n long")
    assert [r.k for r in common.hot_keys(counts, "k", "n").collect()] == [30_000]


def test_components_of_a_path(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102)]
    got = {r.v: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102}


def test_one_row_of_each_class_stays(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"
    b = "a text about something else entirely that nobody has ever copied from anywhere at all"
    c = b.replace("text", "note") + " so " + a[::-1]
    rows = [(1, a), (5, a + " extra"), (5, b), (None, a + " more"), (None, c), (None, c + " x"), (7, ""), (7, ""), (8, None), (9, "same id same text here"), (9, "same id same text here")]
    docs = spark.createDataFrame([(d, t, i, "y") for i, (d, t) in enumerate(rows)], "doc_id long, text string, t long, key string").repartition(3)
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (5, b), (7, ""), (7, ""), (8, None), (9, rows[9][1]), next(x for x in kept if x[0] is None)]))
    assert next(x for x in kept if x[0] is None)[1] in (c, c + " x")
    assert jaccard_join.one_of_each(docs.limit(0)).collect() == []
