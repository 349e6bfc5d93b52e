import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lapidary.llm import language_id

STEMS = {"aa": ["bera", "onti", "salu", "mire"], "bb": ["grzk", "vlost", "pšeni", "dobrý"], "cc": ["日本", "語の", "学校", "水曜"]}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 2))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(sentence(rng, lang, rng.randint(1, 60)), lang) for lang in STEMS for _ in range(120)] + [("noise", None), (None, "aa"), ("", "bb"), ("123", "cc")]
    return language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))


def test_held_out_accuracy(spark, model):
    rng = random.Random(2)
    rows = [(sentence(rng, lang, 4), lang, 1.0) for lang in STEMS for _ in range(60)]
    got = language_id.predicted(spark.createDataFrame(rows, "text string, lang string, score double"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark, model):
    rows = [(None,), ("",), ("12 !?",), ("\0\0",), ("bera " * 20_000,), ("bera",), ("bera",)]
    frame = spark.createDataFrame(rows, "text string")
    got = language_id.predicted(frame, model).collect()
    assert [r.lang_pred for r in got] == ["und"] * 4 + ["aa"] * 3
    assert [r.score for r in got[:4]] == [0.0] * 4 and got[5].score == got[6].score
    assert language_id.predicted(frame.limit(0), model).collect() == []
    assert language_id.fit(spark.createDataFrame([("x", None)], "text string, lang string")) is None
    assert {r.lang_pred for r in language_id.predicted(frame, None).collect()} == {"und"}


def kneser_ney(texts, vocabulary):
    """log P(character | three before it) by the definition, for one language."""
    grams = Counter(("\0\0\0" + t)[i : i + 4] for t in texts for i in range(len(t)))
    counts = {4: grams}
    for size in (3, 2, 1):
        counts[size] = Counter(g[-size:] for g in counts[size + 1])

    def discount(size):
        ones, twos = (sum(c == x for c in counts[size].values()) for x in (1, 2))
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5

    def p(context, char):
        size = len(context) + 1
        lower = 1 / vocabulary if size == 1 else p(context[1:], char)
        here = {g: c for g, c in counts[size].items() if g[:-1] == context}
        if not here:
            return lower
        total, d = sum(here.values()), discount(size)
        return max(here.get(context + char, 0) - d, 0) / total + d * len(here) / total * lower

    return p


def test_estimates_equal_the_definition(spark):
    texts = {"aa": ["abab abc", "abca", "cab abab"], "bb": ["bcd bcd", "dab"]}
    rows = [(t, lang) for lang, own in texts.items() for t in own]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    vocabulary = len({c for own in texts.values() for t in own for c in t}) + 1
    asked = "abcd dcba bab"
    codes, _ = language_id.characters(pa.array([asked]))
    assert model.blocks == 1
    got = model.block(0).log_probabilities(codes, np.arange(len(asked)))
    for i, lang in enumerate(sorted(texts)):
        p = kneser_ney(texts[lang], vocabulary)
        padded = "\0\0\0" + asked
        assert np.allclose(got[:, i], [np.log(p(padded[k : k + 3], padded[k + 3])) for k in range(len(asked))], atol=1e-4)
        seen = sorted({c for own in texts.values() for t in own for c in t})
        for context in ("aba", "\0\0\0", "zzz"):
            assert abs(sum(p(context, c) for c in seen) + p(context, "\1") - 1) < 1e-9


def test_many_languages_and_any_names(spark):
    names = [f"l{i:03}" for i in range(300)]
    rows = [(chr(0x4E00 + i) * 3 + " " + chr(0x4E00 + i) * 2, lang, "x", "X") for i, lang in enumerate(names)]
    frame = spark.createDataFrame(rows, "text string, lang string, _x string, x string").repartition(2)
    got = language_id.predicted(frame, language_id.fit(frame)).collect()
    assert all(r.lang_pred == r.lang and (r._x, r.x) == ("x", "X") for r in got)


def test_ties_go_to_the_language_that_sorts_first(spark):
    frame = spark.createDataFrame([("same words", lang) for lang in ("zz", "bb", "cc")], "text string, lang string")
    assert {r.lang_pred for r in language_id.predicted(frame, language_id.fit(frame)).collect()} == {"bb"}


def test_result_does_not_depend_on_batches(model):
    texts = [sentence(random.Random(i), "aa", 5) for i in range(20)] + ["", "1"]
    block = model.block(0)
    together, sizes = block.sums(pa.array(texts))
    alone = [block.sums(pa.array([t])) for t in texts]
    assert np.allclose(together, np.concatenate([x for x, _ in alone])) and sizes.tolist() == [n[0] for _, n in alone]


def test_result_does_not_depend_on_blocks(spark):
    """A model in many blocks, more than a pass takes, says what one block says; each row is in one block, but for orders 1 and 2."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, lang, rng.randint(1, 30)), lang) for lang in STEMS for i in range(40)] + [(0, None, None), (1, "", "aa"), (2, "7 7", "bb")]
    frame = spark.createDataFrame(rows, "k int, text string, lang string").repartition(3)
    one, many = language_id.fit(frame), language_id.fit(frame, block_bytes=10_000)
    assert one.blocks == 1 and many.blocks > language_id.SENT_BLOCKS
    blocks = [many.block(i) for i in range(many.blocks)]
    for i, (keys, _) in enumerate(one.block(0).grams[:2]):
        assert sorted(keys.tolist()) == sorted(k for x in blocks for k in x.grams[i][0].tolist())
    assert max(len(x.grams[0][0]) for x in blocks) < len(one.block(0).grams[0][0]) / 2
    a, b = (sorted(map(tuple, language_id.predicted(frame, m).select("k", "text", "lang_pred", "score", "bits_per_char").collect()), key=str) for m in (one, many))
    assert [x[:3] for x in a] == [x[:3] for x in b] and len(a) == len(rows)
    assert all(x[3] == pytest.approx(y[3], abs=1e-4) and (x[4] is y[4] or x[4] == pytest.approx(y[4], abs=1e-5)) for x, y in zip(a, b))


def test_every_gram_has_its_own_row(spark):
    """More different 4-grams than 2**20, each counted as itself."""
    chars = [chr(0x4E00 + i) for i in range(1100)]
    rows = [("".join(chars[i] + c for c in chars), "aa") for i in range(1100)]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    grams = {t[i : i + 4] for t, _ in rows for i in range(-3, len(t) - 3) if i >= 0}
    starts = {"\0" * (3 - k) + t[: k + 1] for t, _ in rows for k in range(3)}
    got = language_id.gram_counts(frame, ["aa"])
    assert len(grams | starts) > 1 << 20 and got.count() == len(grams | starts)
    assert got.agg({"n": "sum"}).first()[0] == sum(len(t) for t, _ in rows)
    block = language_id.model_of(got, ["aa"], block_bytes=1 << 30).block(0)
    assert [len(keys) for keys, _ in block.grams] == [len({g[-k:] for g in grams | starts}) for k in (4, 3, 2, 1)]
    # what no text has is not among the seen grams
    unseen = np.array([ord(c) for c in "一丁丂七"], np.int64)
    key = language_id.gram_hash(language_id.packed(unseen, np.array([2]), 3), unseen[3:])
    assert (block.indexed()[0].find(key) < 0).all() == ("一丁丂七" not in grams)
