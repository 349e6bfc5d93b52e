"""Byte-level BPE encoding and decoding with a given table of ranks.

Each match of the split pattern is encoded on its own.  Its UTF-8 bytes are read as
Latin-1, so that an Aho-Corasick automaton over characters searches bytes.  The encoder
takes the longest token at a position and keeps it if it can stand beside the token before
it; else it tries shorter ones, and with none left it steps back and closes that position,
so that no position is tried twice from the same state.  Whether two tokens can stand side
by side is worked out once for each pair: they can unless replaying the merges that made
them would at some time rather have merged across their border.  A sequence in which all
neighbours are compatible is the one that the merges in rank order give, so the result is
exact, in time linear in the bytes.

A null or empty text has no tokens and decodes to no bytes.  Each row is encoded alone:
ties, repeated rows and other columns make no difference.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import text_or_empty

#: Pieces whose tokens a worker remembers, and pairs whose compatibility it remembers; both start anew when full.
PIECES_KEPT = 300_000
PAIRS_KEPT = 1_000_000
NEVER = 1 << 60


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.rank = ranks
        self.split = regex.compile(pattern).findall
        self.token = dict(sorted((i, t) for t, i in ranks.items()))
        self.by_decimal = {str(i): t for i, t in self.token.items()}
        self.longest = max(map(len, ranks))
        #: The two tokens that a token was merged from; none for a single byte.
        self.parts: dict[int, tuple[int, int]] = {}
        self.search = ahocorasick.Automaton()
        for i, t in self.token.items():
            if len(t) > 1:
                parts = self.merge(t, i)
                if len(parts) != 2:
                    continue  # no sequence of merges makes it
                self.parts[i] = (parts[0], parts[1])
            self.search.add_word(t.decode("latin-1"), i)
        self.search.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def merge(self, text: bytes, below: int = NEVER) -> list[int]:
        """The tokens of a few bytes by merging in rank order, with the ranks under ``below`` only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that one edge (0 left, 1 right) of a token was, from a byte up to the token itself."""
        found = [token]
        while token in self.parts:
            token = self.parts[token][side]
            found.append(token)
        return found[::-1]

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges leave the border between the two tokens alone?"""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[left, right] = self.border_stays(self.edge(left, 1), self.edge(right, 0))
        return known

    def border_stays(self, left: list[int], right: list[int]) -> bool:
        """Replays both edges in rank order; a token's id is the rank of the merge that makes it."""
        i = j = 0
        while True:
            across = self.rank.get(self.token[left[i]] + self.token[right[j]], NEVER)
            grow_left = left[i + 1] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1] if j + 1 < len(right) else NEVER
            # Of merges of one rank, the one further left comes first.
            if across < grow_left and across <= grow_right and across != NEVER:
                return False
            if grow_left == grow_right == NEVER:
                return True
            i, j = i + (grow_left <= grow_right), j + (grow_right <= grow_left)

    def next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            t = self.token[token]
            found = (self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank)
            self.shorter[token] = next((x for x in found if len(self.token[x]) == 1 or x in self.parts), None)
        return self.shorter[token]

    def longest_at(self, text: str, at: int) -> int:
        """The longest token that starts there; there is one, as every byte is a token."""
        return next(self.search.iter_long(text[at : at + self.longest]))[1]

    def tokens_of(self, piece: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if piece in self.rank:
            return [self.rank[piece]]
        text, end = piece.decode("latin-1"), len(piece)
        closed = bytearray(end + 1)
        out: list[int] = []
        at, token = 0, self.longest_at(text, 0)
        while True:
            stop = at + len(self.token[token])
            if not closed[stop] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = stop
                if at == end:
                    return out
                token = self.longest_at(text, at)
                continue
            shorter = self.next_shorter(token)
            while shorter is None:
                closed[at] = 1
                last = out.pop()
                at -= len(self.token[last])
                shorter = self.next_shorter(last)
            token = shorter

    def encode(self, text: str) -> str:
        """The ids in decimal, with one space between them."""
        return " ".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.by_decimal.__getitem__, ids.split()))


class Pieces(dict):
    """The tokens of each piece met so far, in decimal."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> str:
        if len(self) >= PIECES_KEPT:
            self.clear()
        found = " ".join(map(str, self.encoder.tokens_of(piece.encode())))
        if len(piece) < 64:
            self[piece] = found
        return found


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def public_vocabulary() -> tuple[str, str]:
    """Path of the ranks and split pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(text: Column, path: str, pattern: str) -> Column:
    """struct(ids array<int>, n_tokens) of each text.  The path must exist on every executor."""

    @F.arrow_udf("ids array<int>, n_tokens bigint")
    def udf(texts: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        rows = [[int(x) for x in own.encode(t.as_py()).split()] for t in texts]
        return pa.StructArray.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(map(len, rows), pa.int64())], ["ids", "n_tokens"])

    return udf(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of each array of ids; null where the array is null."""

    @F.arrow_udf("binary")
    def udf(arrays: pa.Array) -> pa.Array:
        own = encoder(path, pattern).token
        return pa.array([None if a is None else b"".join(map(own.__getitem__, a)) for a in arrays.to_pylist()], pa.binary())

    return udf(ids)


def digested(text: Column, path: str, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): encodes each text, then decodes its ids, without returning either."""

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from digests(batches, encoder(path, pattern))

    return udf(text)


def digests(batches: Iterator[pa.Array], own: Encoder) -> Iterator[pa.Array]:
    """What :func:`digested` says of each batch of a task; what was remembered goes with the task, as its worker lives on for other steps."""
    try:
        for texts in batches:
            counts, ids_sha, back_sha = [], [], []
            for t in texts:
                ids = own.encode(t.as_py())
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
    finally:
        own.pieces.clear()
        own.pairs.clear()


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs."""
    own_path, own_pattern = public_vocabulary()
    found = docs.select("doc_id", digested(text_or_empty(), path or own_path, pattern or own_pattern).alias("_found"))
    return found.select("doc_id", "_found.*")
