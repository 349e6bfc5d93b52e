"""Properties that hold for all texts, on generated ones."""

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lapidary.llm import byte_bpe, common, decontaminate, pii, suffix_dedup, warc
from tests.llm.test_pii import plain

PATH, PATTERN = byte_bpe.public_vocabulary()
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_tokens_equal_the_library(text):
    own = byte_bpe.encoder(PATH, PATTERN)
    ids = own.encode(text)
    assert [int(x) for x in ids.split()] == THEIRS.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text("a1.@+-() 2%é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == list(plain(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_words(texts):
    import re

    starts, ends, hashes, bounds = decontaminate.words_of(*common.utf8(pa.array(texts)))
    low = [bytes(decontaminate.LOWER[np.frombuffer(t.encode(), np.uint8)]).decode() for t in texts]
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in low]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    raw = "".join(low).encode()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == [w for own in want for w in own]
    assert len({(h, w) for h, w in zip(hashes.tolist(), [w for own in want for w in own], strict=True)}) == len(set(hashes.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=6), st.integers(1, 20))
def test_prefix_ranks_order_suffixes(parts, length):
    data = np.frombuffer(b"".join(parts) + b"x", np.uint8)
    rank = suffix_dedup.prefix_ranks(data, length)
    raw = bytes(data)
    for i in range(len(raw) - length + 1):
        for j in range(i, len(raw) - length + 1):
            assert (rank[i] == rank[j]) == (raw[i : i + length] == raw[j : j + length])
            if raw[i : i + length] < raw[j : j + length]:
                assert rank[i] < rank[j]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=400))
def test_equal_windows_meet_at_one_anchor(text):
    length, raw = 12, text.encode()
    row, lo, hi, left, h, _, _ = suffix_dedup.anchored(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), length, 4)
    windows = {}
    for a, b, offset, key in zip(lo, hi, left, h, strict=True):
        for p in range(a, b - length + 1):
            windows[p] = (int(key), int(a + offset - p))
    assert sorted(windows) == list(range(max(0, len(raw) - length + 1)))
    names = {}
    for p, name in windows.items():
        assert names.setdefault(raw[p : p + length], name) == name


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=20))
def test_bundles_give_back_their_records(payloads):
    writer = warc.BundleWriter()
    for i, p in enumerate(payloads):
        writer.add(*warc.record(i, "u", p, warc.base32_sha1(p), None))
    out = writer.close()
    reader = warc.BundleReader(out["archive"])
    for i, p in enumerate(payloads):
        assert reader.record_at(out["frames"][i], out["offsets"][i])[1] == p
