import base64
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lapidary.llm import byte_bpe


@pytest.fixture(scope="module")
def pair():
    path, pattern = byte_bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return byte_bpe.encoder(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    yield from ["", " ", "a", "aaaa" * 50, "a" * 3001, " \n\t \n", "naïve café 日本語 🙂🙂", "<|endoftext|>", "don't we'LL I'm", "\x00\x7f ", "x" * 20_000]
    for _ in range(400):
        alphabet = rng.choice(["ab", "aeinorst ", "abcdefghijklmnopqrstuvwxyz ", "0123456789.,-", "éèßñ ü日本🙂a ", "\n\r\t ab"])
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120)))


def test_equals_the_library(pair):
    own, theirs = pair
    for text in texts():
        ids = own.encode(text)
        assert [int(x) for x in ids.split()] == theirs.encode_ordinary(text), text[:60]
        assert own.decode(ids) == text.encode()


def test_merges_on_random_bytes(pair):
    own, _ = pair
    rng = random.Random(6)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcd e\xc3\xa9\xff") for _ in range(rng.randint(1, 40)))
        assert own.tokens_of(piece) == own.merge(piece)


def test_frames(spark, pair):
    _, theirs = pair
    rows = [(1, "The cat sat", "x"), (None, None, "y"), (1, "The cat sat", "x"), (2, "", None), (3, "word " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = byte_bpe.token_digests(docs).collect()
    assert [r.doc_id for r in got] == [1, None, 1, 2, 3]
    assert [r.n_tokens for r in got] == [len(theirs.encode_ordinary(t or "")) for _, t, _ in rows]
    assert got[0].ids_sha256 == got[2].ids_sha256 and got[1].decoded_sha256 == got[3].decoded_sha256
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    from pyspark.sql import functions as F

    back = docs.filter("text is not null").select("text", byte_bpe.encoded(F.col("text"), path, pattern).alias("e"))
    back = back.select("text", byte_bpe.decoded(F.col("e.ids"), path, pattern).cast("string").alias("again"))
    assert all(r.text == r.again for r in back.collect())
    assert byte_bpe.token_digests(docs.limit(0)).collect() == []


def test_a_task_leaves_nothing_behind(pair):
    """A worker is used again by other steps, so what a task remembered does not stay in it."""
    own = pair[0]
    own.encode("left from before, unlikelyword")
    found = byte_bpe.digests(iter([pa.array(["unlikelyword otherword", ""]), pa.array(["thirdword"])]), own)
    assert next(found).to_pylist()[1]["n_tokens"] == 0 and own.pieces
    assert len(list(found)) == 1 and not own.pieces and not own.pairs
