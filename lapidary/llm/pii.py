"""Personal data: fixed kinds by their form, and terms by how strongly they give an entity away.

Base kinds are e-mail addresses, IP addresses, card numbers and phone numbers, found as the
leftmost non-overlapping matches of each kind; a match that fails its check is dropped.

Terms: every base match is an entity, known by its normalised value.  Every word of a text,
words in base matches not counted, co-occurs with every entity of the text, wherever both stand.  Over the whole corpus, and counting
documents and not places, pointwise mutual information log2(N * n(t,e) / (n(t) * n(e))) says
how much of the entity a term discloses.  It is set against the entity's information
-log2(n(e) / N): a term whose share reaches :data:`DISCLOSURE` is as good as naming the
entity.  Every pair is judged, also one that a single document has: a term that stands only
beside an entity that is seen once has all of its information, a common word has little.
Such terms are marked wherever they stand in a text with that entity; sanitising replaces base
matches by their kind and removes disclosing terms.

Tasks count all words of their batches and Spark adds the counts up.  A term in more than
N * (n(e) / N) ** share documents cannot disclose e, even if it stands in all of e's, so only
rarer words meet the entities of their texts; that leaves no pair out.  Pairs are sent to all
tasks while they are few (:data:`SENT_ROWS`), and joined beyond that.

Nulls and ties: a null text is empty.  Rows are judged one by one; copies, repeated rows and
other columns make no difference to a row's base spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lapidary.llm.common import dealt_join, free_name, hot_keys, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.9
SENT_ROWS = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins where its first run of characters begins, so it is not tried within the run.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LONG_RUN = re.compile(r"[0-9](?:[ -]?[0-9]){12}")
WORD = re.compile(r"[^\W\d_]{3,}")
DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address is the longest run of local characters before an @, and the domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield start, free
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in ADDRESS.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    if LONG_RUN.search(text):
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                yield m.span()


FINDERS = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then by start."""
    if "@" not in text and not DIGITS.search(text):
        return []
    return [(kind, a, b) for kind, find in zip(KINDS, FINDERS, strict=True) for a, b in find(text)]


def entity_of(kind: str, value: str) -> str:
    """One name for all spellings of a value."""
    return f"{kind}:{value.lower()}" if kind == "email" else f"{kind}:{''.join(DIGITS.findall(value)) if kind != 'ip' else value}"


def context(text: str, spans: list[tuple[str, int, int]]) -> tuple[set[str], list[tuple[str, int, int]]]:
    """The entities of a text, and (term, start, end) of each word outside all base spans."""
    if not spans:
        return set(), []
    starts = sorted(a for _, a, _ in spans)
    ends = sorted(b for _, _, b in spans)
    # as many spans end by its start as begin before its end: none overlaps it
    free = [(m[0].lower(), *m.span()) for m in WORD.finditer(text) if bisect_left(starts, m.end()) == bisect_right(ends, m.start())]
    return {entity_of(kind, text[a:b]) for kind, a, b in spans}, free


READ = "entities array<string>, words array<string>"
#: Code points of text after which a task hands on what it read.
READ_CHARS = 1 << 20


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different entities and words of each text (first column) that has an entity, after the other columns."""
    for batch in batches:
        texts, at, size = batch.column(0), 0, 0
        rows: list[tuple[int, list[str], list[str]]] = []
        for i in range(len(texts)):
            text = texts[i].as_py()
            names, words = context(text, base_spans(text))
            if names:
                rows.append((i, sorted(names), sorted({w for w, _, _ in words})))
            size += len(text)
            if size >= READ_CHARS or i + 1 == len(texts):
                kept = batch.take(pa.array([x[0] for x in rows], pa.int64())).columns[1:]
                lists = [pa.array([x[j] for x in rows], pa.list_(pa.string())) for j in (1, 2)]
                yield pa.RecordBatch.from_arrays([*kept, *lists], [*batch.schema.names[1:], "entities", "words"])
                rows, size = [], 0


def has_digit_or_at(text: Column) -> Column:
    """No text without either has an entity."""
    return text.contains("@") | text.rlike("[0-9]")


def with_contexts(texts: DataFrame, keys: str = "") -> DataFrame:
    """What :func:`contexts` reads of texts (text, and columns of these keys)."""
    return texts.filter(has_digit_or_at(F.col("text"))).mapInArrow(contexts, f"{keys}{READ}")


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many texts of a batch each word stands."""
    for batch in batches:
        found: Counter[str] = Counter()
        for t in batch.column(0).to_pylist():
            found.update({w.lower() for w in set(WORD.findall(t))})
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["term", "n"])


def judged_pairs(docs: DataFrame, disclosure: float) -> tuple[DataFrame, DataFrame]:
    """(key, entity, term) of each text and each of its pairs that are rare enough to disclose, and (entity, term) of all that do; key is the text's digest."""
    texts = docs.select(text_or_empty().alias("text"))
    keyed = texts.select("text", digest_of(F.col("text")).alias("key"))
    read = written(with_contexts(keyed, "key string, ").select(F.monotonically_increasing_id().alias("row"), "*"), "contexts")
    named = read.select("row", "key", F.explode("entities").alias("entity"))
    entities = written(named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "entities")
    most = entities.agg(F.max("n_e")).first()[0]
    if not most:
        return entities.select(F.col("entity").alias("key"), "entity", F.col("entity").alias("term")), entities.select("entity", F.col("entity").alias("term"))
    n_all = docs.count()
    terms = texts.mapInArrow(word_counts, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_t"))
    terms = written(terms, "words")
    rarer = lambda n_e: F.col("n_t") <= F.lit(n_all * (1 + 1e-9)) * F.pow(n_e / F.lit(n_all), F.lit(max(disclosure, 0.0)))
    words = dealt_join(read.select("row", F.explode("words").alias("term")), terms.filter(rarer(F.lit(most))), "term", hot_keys(terms, "term", "n_t"))
    named = dealt_join(named, entities, "entity", hot_keys(entities, "entity", "n_e"))
    pairs = written(words.join(named.hint("merge"), "row").filter(rarer(F.col("n_e"))).select("key", "entity", "term", "n_e", "n_t"), "pairs")
    counted = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_te"))
    information = F.log2(F.lit(n_all) / F.col("n_e"))
    shared = F.log2(F.lit(n_all) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    disclosing = written(counted.filter((information > 0) & (shared >= disclosure * information)).select("entity", "term"), "terms")
    return pairs.select("key", "entity", "term"), disclosing


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(entity, term) of every term that gives an entity away, from all of docs (text)."""
    return judged_pairs(docs, disclosure)[1]


FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, clean string"


def by_term(pairs: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    """The entities that each term gives away."""
    found: dict[str, set[str]] = {}
    for entity, term in pairs:
        found.setdefault(term, set()).add(entity)
    return found


def all_spans(text: str, disclosing: dict[str, set[str]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, term spans) of a text."""
    base = base_spans(text)
    names, words = context(text, base)
    telling = {w for w in {w for w, _, _ in words} & disclosing.keys() if not names.isdisjoint(disclosing[w])}
    return base, [("term", a, b) for w, a, b in words if w in telling]


def sanitised_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each base match replaced by its kind, and without disclosing terms."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1:]):
        if a < at:  # inside what is replaced already
            at = max(at, b)
            continue
        out += [text[at:a], "" if kind == "term" else f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def found_udf(sent: Broadcast | None, clean: bool) -> Callable[[Column, Column], Column]:
    """What is found in each text; the second column has the text's own (entity, term) pairs where none were sent."""

    @F.arrow_udf(FOUND)
    def udf(texts: pa.Array, own: pa.Array) -> pa.Array:
        rows = []
        for t, pairs in zip(texts.to_pylist(), own.to_pylist(), strict=True):
            disclosing = sent.value if sent else by_term((p["entity"], p["term"]) for p in pairs or ())
            base, terms = all_spans(t, disclosing)
            shown = [",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (base, base + terms)]
            count = Counter(k for k, _, _ in base)
            rows.append((*(count[k] for k in KINDS), hashlib.sha256(shown[0].encode()).hexdigest(), shown[1], sanitised_text(t, base + terms) if clean else None))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return udf


@F.arrow_udf(BooleanType())
def has_entity(texts: pa.Array) -> pa.Array:
    return pa.array([bool(base_spans(t)) for t in texts.to_pylist()], pa.bool_())


def nothing_found(text: Column, clean: bool) -> Column:
    """What is found in a text without an entity."""
    values = [*["0"] * 4, hashlib.sha256(b"").hexdigest(), ""]
    cells = [*map(F.lit, values), text if clean else F.lit(None)]
    return F.struct(*(c.cast(kind).alias(name) for c, (name, kind) in zip(cells, map(str.split, FOUND.split(", ")), strict=True)))


def personal_data(docs: DataFrame, clean: bool = False, disclosure: float = DISCLOSURE, sent_rows: int = SENT_ROWS, name: str = "found") -> DataFrame:
    """docs with a struct (``found``, or by another name): counts by kind, digest of the base spans, all spans and, on request, the sanitised text."""
    judged, terms = judged_pairs(docs, disclosure)
    some = terms.limit(sent_rows + 1).collect()
    pairs = F.lit(None).cast("array<struct<entity:string,term:string>>")
    if len(some) <= sent_rows:
        sent = docs.sparkSession.sparkContext.broadcast(by_term((r.entity, r.term) for r in some))
        return docs.withColumn(name, found_udf(sent, clean)(text_or_empty(), pairs))
    # Too many pairs to send: texts with an entity get those of their own pairs that disclose, by the text's digest.  Other texts are not shuffled.
    text = text_or_empty()
    key, own = (free_name(x, [*docs.columns, name]) for x in ("key", "pairs"))
    told = judged.join(terms.hint("merge"), ["entity", "term"])
    listed = told.groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("entity", "term")).alias(own))
    has = F.coalesce(has_digit_or_at(text) & has_entity(text), F.lit(False))
    plain = docs.filter(~has).withColumn(name, nothing_found(text, clean))
    joined = docs.filter(has).withColumn(key, digest_of(text)).join(listed.hint("merge"), key, "left")
    return plain.unionByName(joined.withColumn(name, found_udf(None, clean)(text, F.col(own))).drop(key, own))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, clean_sha256) of every row of docs; the last is the digest of the sanitised text."""
    found = personal_data(docs.select("doc_id", "text"), clean=True).select("doc_id", "found.*")
    return found.withColumn("clean_sha256", F.sha2(F.col("clean").cast("binary"), 256)).drop("clean")
