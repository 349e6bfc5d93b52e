"""Secrets: an Aho-Corasick prefilter for keywords, anchored expressions at its hits, embedded checksums.

One automaton looks for all keywords at once in the text with A-Z as a-z.  An expression is
tried where a keyword begins and nowhere else, so a text without keywords costs one walk of
the automaton.  Runs of hexadecimal digits have no keyword: the text is mapped to classes of
characters and a second automaton looks for :data:`HEX_LEAST` digits in a row, whose first
hit in a run is where the run begins.

Base kinds are those of :data:`BASE`, leftmost and non-overlapping for each kind; what fails its
check is dropped, with no second try inside it.  Checked kinds (:data:`CHECKED`) are tokens that
carry their own checksum and are reported only if it is right: six base-62 digits of the
CRC-32 of what stands before them, or the six Bech32 symbols at the end.

Every row is judged by itself and nothing is shuffled or sent.  Nulls and ties: a null text is
empty and has no secret; repeated rows give repeated rows; other columns are kept by
:func:`scanned`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import text_or_empty

BASE = ("assign", "access", "hex")
CHECKED = ("github", "npm", "age")
KINDS = BASE + CHECKED
HEX_LEAST = 24

#: A kind's keywords, in lower case.  None contains another one of its kind, so hits come in the order of their starts.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "age": ("age-secret-key-1",),
}
ANCHORED = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]++"),
    "hex": re.compile(rb"[0-9a-f]++"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]++)"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]++)"),
    "age": re.compile(rb"AGE-SECRET-KEY-1([A-Z0-9]++)"),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: What each of the five leading bits adds to a Bech32 checksum (fixed values of the format).
BECH32_BITS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CLASSES = bytes(0x68 if b in b"0123456789abcdef" else 0x2E for b in range(256))


def crc_digits(body: bytes) -> str:
    """The CRC-32 of body as six base-62 digits."""
    rest, out = zlib.crc32(body), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        out = BASE62[digit] + out
    return out


def crc_holds(token: bytes) -> bool:
    """30 characters and the six digits of their CRC-32."""
    return len(token) == 36 and token[30:].decode() == crc_digits(token[:30])


def bech32_residue(values: list[int]) -> int:
    """The checksum of five-bit values; 1 where they end in their own checksum."""
    state = 1
    for value in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ value
        for bit, add in enumerate(BECH32_BITS):
            if top >> bit & 1:
                state ^= add
    return state


def bech32_holds(prefix: str, data: str) -> bool:
    if any(c not in BECH32 for c in data):
        return False
    spread = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    return bech32_residue(spread + [BECH32.index(c) for c in data]) == 1


ACCEPTS: dict[str, Callable[[re.Match[bytes]], bool]] = {
    "assign": lambda m: m.end(1) - m.start(1) >= 6,
    "access": lambda m: m.end() - m.start() >= 20,
    "hex": lambda m: m.end() - m.start() >= HEX_LEAST,
    "github": lambda m: crc_holds(m[1]),
    "npm": lambda m: crc_holds(m[1]),
    "age": lambda m: len(m[1]) == 58 and bech32_holds("age-secret-key-", m[1].decode().lower()),
}


@cache
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """(keywords over the lower-case text, a run of digits over the text of classes)."""
    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for word in keywords:
            words.add_word(word, (kind, len(word)))
    runs.add_word("h" * HEX_LEAST, ("hex", HEX_LEAST))
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def byte_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and then by kind as listed."""
    found = []
    free = dict.fromkeys(KINDS, 0)
    for automaton, mapping in zip(automata(), (LOWER, CLASSES), strict=True):
        for last, (kind, size) in automaton.iter(raw.translate(mapping).decode("latin-1")):
            start = last + 1 - size
            if start < free[kind]:
                continue
            match = ANCHORED[kind].match(raw, start)
            if match:
                free[kind] = match.end()
                if ACCEPTS[kind](match):
                    found.append((kind, start, match.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def secrets_in(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed."""
    raw = text.encode()
    found = byte_spans(raw)
    if not found or len(raw) == len(text):
        return found
    points, at, seen = {}, 0, 0
    for place in sorted({x for _, a, b in found for x in (a, b)}):
        seen += len(raw[at:place].decode())
        points[place], at = seen, place
    return [(kind, points[a], points[b]) for kind, a, b in found]


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = "n_assign bigint, n_access bigint, n_hex bigint, n_checked bigint, base_sha256 string, spans string, clean string"


def found_udf(clean: bool) -> Callable[[Column], Column]:
    @F.arrow_udf(FOUND)
    def udf(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            text = text.as_py()
            spans = secrets_in(text)
            count = Counter(kind for kind, _, _ in spans)
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE)
            rows.append((
                *(count[k] for k in BASE), sum(count[k] for k in CHECKED), hashlib.sha256(base.encode()).hexdigest(),
                ",".join(f"{k}:{a}:{b}" for k, a, b in spans), redacted_text(text, spans) if clean else None,
            ))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return udf


def scanned(docs: DataFrame, clean: bool = False, name: str = "found") -> DataFrame:
    """docs (text) with a struct: counts by kind, digest of the base spans, all spans and, on request, the text with secrets replaced."""
    return docs.withColumn(name, found_udf(clean)(text_or_empty()))


def found_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans) of every row of docs."""
    return scanned(docs.select("doc_id", "text")).select("doc_id", "found.*").drop("clean")
