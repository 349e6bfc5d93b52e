"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased; every run of characters that are no letters is one blank.  All
training texts are counted: each task counts its character 4-grams, and Spark adds the
counts up.  A gram is counted as its first three characters, packed into 63 bits, and its
last; no gram is another one.  Lower orders use continuation counts, from the distinct
4-grams.  Spark makes the estimates with groupings and joins: one row of log probabilities for
each distinct gram, with a place for each language, in a table that grows with the distinct
grams of the corpus.  It is sent in blocks of about :data:`BLOCK_BYTES`, one at a time on the
driver, four to a pass over the texts.  A block has the grams and contexts of the pairs of
characters that fall to it, sorted by hash; a character of a text is looked up in the block of
the two before it.  Orders 1 and 2 go with each block.  4-grams are looked up by a 64-bit hash.

The prediction is the language with the lowest cross-entropy per character.  The score is
a logistic fit of the lead over the second-best language, on texts that its model has not
seen: the counts say how much of each comes from one text in :data:`FOLDS`, a model without
these is calibrated on a bounded sample of them, and its fit serves the model of all texts.
``rejected`` marks rows whose score is under :data:`REJECT_UNDER`.

There is no bound on grams or languages: more of them make more blocks.

Nulls and ties: a null text, or one without letters, gets ``und`` and score 0.  Of equal
cross-entropies, the language that sorts first wins.  Without any training row all is
``und``.  Repeated rows count each; other columns are kept, whatever their names, but for
those that are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import free_name, mixed, steps, text_or_empty, written

ORDER = 4
#: Bits of a code point in a packed key.
BITS = 21
CALIBRATION_ROWS = 4000
#: One text in so many, by a hash of the text, is left out of the model that is calibrated.
FOLDS = 8
REJECT_UNDER = 0.5
#: Bytes of a block of the model, and of one of its rows beside four for each language.
BLOCK_BYTES = 64 << 20
ROW_BYTES = 28
#: Blocks that one pass over the texts looks in.
SENT_BLOCKS = 4
#: Pairs of characters are dealt to blocks by their number modulo this prime.
DEALT = 1_000_003
SUMS = "logs array<double>, size bigint"
#: Rows of distinct grams that a task holds before it hands them on.
HELD_GRAMS = 500_000


@lru_cache(1)
def letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds of each row) of the normalised texts; each row begins with ORDER - 1 zeros."""
    pad = "\0" * (ORDER - 1)
    joined = pad.join(["", *(t.replace("\0", " ").lower() for t in texts.to_pylist()), ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes = np.where(letters()[codes] | (codes == 0), codes, 32)
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes = codes[keep]
    zeros = np.flatnonzero(codes == 0)[:: ORDER - 1]
    return codes, zeros


def packed(codes: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` characters, three at most, that end at each of the given places, as one number."""
    key = np.zeros(len(last), np.int64)
    for i in range(size - 1, -1, -1):
        key = key << BITS | codes[last - i]
    return key


def gram_hash(first: np.ndarray, char: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 4-grams, from their first three characters, packed, and the last one."""
    x = mixed(first.astype(np.uint64) + np.uint64(1)) + char.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x.view(np.int64)


class Index:
    """Where keys stand among some distinct ones: sorted by hash, with the bounds of each bucket."""

    def __init__(self, keys: np.ndarray) -> None:
        hashes = mixed(keys.view(np.uint64))
        self.shift = np.uint64(63 - max(1, len(keys)).bit_length())
        self.rows = np.argsort(hashes).astype(np.int32)
        self.keys = keys[self.rows]
        buckets = (hashes[self.rows] >> self.shift).astype(np.int64)
        self.bounds = np.zeros((1 << (64 - int(self.shift))) + 1, np.int32)
        self.bounds[1:] = np.cumsum(np.bincount(buckets, minlength=len(self.bounds) - 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        bucket = (mixed(keys.view(np.uint64)) >> self.shift).astype(np.int64)
        at, end = self.bounds[bucket], self.bounds[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            same = self.keys[at] == keys[open_]
            out[open_[same]] = self.rows[at[same]]
            more = ~same & (at + 1 < end)
            open_, at, end = open_[more], at[more] + 1, end[more]
        return out


def counter(languages: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    place = {x: i for i, x in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in steps(batch, "text"):
                codes, zeros = characters(part.column("text"))
                if len(codes) < ORDER:
                    continue
                lang = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                real = np.flatnonzero(codes[ORDER - 1 :])
                row = np.searchsorted(zeros, real + ORDER - 1, side="right") - 1
                last = real + ORDER - 1
                before, char = packed(codes, last - 1, ORDER - 1), codes[last].astype(np.int64)
                key = lang_hash(lang[row], gram_hash(before, char))
                _, at, of, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                apart = np.bincount(of, weights=part.column("apart").to_numpy(zero_copy_only=False)[row], minlength=len(at)).astype(np.int64)
                held.append(np.stack([key[at], lang[row[at]], before[at], char[at], count, apart]))
                size += len(at)
                if size > HELD_GRAMS:
                    held = [together(held)]
                    size = held[0].shape[1]
                    if size > HELD_GRAMS // 2:
                        yield table_of(held.pop())
                        size = 0
        if held:
            yield table_of(together(held))

    return counted


def together(parts: list[np.ndarray]) -> np.ndarray:
    """One column for each (language, gram), with the sums of its counts."""
    x = np.concatenate(parts, axis=1)
    _, first, inverse = np.unique(x[0], return_index=True, return_inverse=True)
    out = x[:, first]
    for i in (-2, -1):
        out[i] = np.bincount(inverse, weights=x[i]).astype(np.int64)
    return out


def lang_hash(lang: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mixed(key.view(np.uint64) ^ mixed(lang.astype(np.uint64) + np.uint64(1))).view(np.int64)


def table_of(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[1], pa.int32()), pa.array(x[2]), pa.array(x[3], pa.int32()), pa.array(x[4]), pa.array(x[5])], ["lang", "before", "char", "n", "apart"])


def left_out() -> Column:
    """Is a text left out of the model that is calibrated?"""
    return F.pmod(F.xxhash64(text_or_empty()), F.lit(FOLDS)) == 0


def gram_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, before, char, n, apart): one row for each different 4-gram of each language, by its first three characters and its last; apart counts those of texts that are left out."""
    parts = docs.select(text_or_empty().alias("text"), "lang", left_out().alias("apart")).mapInArrow(counter(languages), "lang int, before bigint, char int, n bigint, apart bigint")
    return parts.groupBy("lang", "before", "char").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"))


@dataclass
class Block:
    """The rows of a model for the pairs of characters that fall to it, and those of orders 1 and 2."""

    number: int
    blocks: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order from ORDER down: keys, log probabilities
    backoffs: list[tuple[np.ndarray, np.ndarray]]  # by order down to 2: contexts, log weights
    unseen: np.ndarray  # log probability of a character that no text has, for each language

    def indexed(self) -> list[Index]:
        if not hasattr(self, "_where"):
            self._where = [Index(keys) for keys, _ in [*self.grams, *self.backoffs]]
        return self._where

    def own(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The positions (counted from ORDER - 1 on) whose two characters before fall to this block."""
        if self.blocks == 1:
            return at
        return at[packed(codes, at + ORDER - 2, 2) % DEALT % self.blocks == self.number]

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row for each position, one column for each language."""
        where = self.indexed()
        out = np.zeros((len(at), len(self.unseen)), np.float32)
        open_ = np.arange(len(at))
        for i, size in enumerate(range(ORDER, 0, -1)):
            last = at[open_] + ORDER - 1
            row = where[i].find(gram_hash(packed(codes, last - 1, size - 1), codes[last]) if size == ORDER else packed(codes, last, size))
            hit = row >= 0
            out[open_[hit]] += self.grams[i][1][row[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            if size > 1:
                row = where[ORDER + i].find(packed(codes, at[open_] + ORDER - 2, size - 1))
                known = row >= 0
                out[open_[known]] += self.backoffs[i][1][row[known]]
        out[open_] += self.unseen
        return out

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of the block's positions in each language, number of characters) of each text; no characters without letters."""
        rows = len(texts)
        out, sizes = np.zeros((rows, len(self.unseen))), np.zeros(rows, np.int64)
        done = 0
        for part in steps(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            codes, zeros = characters(part.column(0))
            n = part.num_rows
            if len(codes) >= ORDER:
                every = np.flatnonzero(codes[ORDER - 1 :])
                row_of = lambda at: np.searchsorted(zeros, at + ORDER - 1, side="right") - 1  # noqa: B023, E731
                whose = row_of(every)
                letter = np.bincount(whose, weights=codes[every + ORDER - 1] != 32, minlength=n) > 0
                sizes[done : done + n] = np.where(letter, np.bincount(whose, minlength=n), 0)
                at = self.own(codes, every)
                if len(at):
                    row = row_of(at)
                    first = np.flatnonzero(np.append(True, np.diff(row) != 0))
                    out[done + row[first]] = np.add.reduceat(self.log_probabilities(codes, at).astype(np.float64), first, axis=0)
            done += n
        return out, sizes


@dataclass
class Model:
    """Where the rows of a model are: a table in the shared folder, read in blocks."""

    languages: list[str]
    rows: DataFrame  # size, context, char (-1: weight of the context), logs
    unseen: np.ndarray
    blocks: int
    slope: float = 1.0
    offset: float = 0.0

    def block(self, number: int) -> Block:
        """One block, gathered on the driver to be sent: about BLOCK_BYTES, beside orders 1 and 2."""
        pair = F.col("context").bitwiseAND(F.lit((1 << 2 * BITS) - 1))
        own = self.rows.filter((F.col("size") <= 2) | (pair % DEALT % self.blocks == number)).toArrow()
        size, context, char = (own.column(c).to_numpy() for c in ("size", "context", "char"))
        logs = own.column("logs").combine_chunks().flatten().to_numpy().reshape(own.num_rows, len(self.languages))
        grams, backoffs = [], []
        for k in range(ORDER, 0, -1):
            here = (size == k) & (char >= 0)
            keys = gram_hash(context[here], char[here]) if k == ORDER else context[here] << BITS | char[here]
            grams.append((keys, logs[here]))
            if k > 1:
                here = (size == k) & (char < 0)
                backoffs.append((context[here], logs[here]))
        return Block(number, self.blocks, grams, backoffs, self.unseen)


def dense(df: DataFrame, keys: list[str], values: dict[str, float], n_lang: int) -> DataFrame:
    """One row for each of the keys; each value is an array with a place for each language, of the given default where it has none."""
    entry = F.map_from_entries(F.collect_list(F.struct("lang", F.struct(*values))))
    place = F.sequence(F.lit(0), F.lit(n_lang - 1))

    def column(name: str, default: float) -> Column:
        return F.transform(place, lambda i: F.coalesce(F.try_element_at("own", i)[name], F.lit(default))).alias(name)

    return df.groupBy(*keys).agg(entry.alias("own")).select(*keys, *(column(k, v) for k, v in values.items()))


def shorter(size: int) -> Column:
    """The last characters of a context, as many as a gram of this size has before its last."""
    return F.col("context").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1))


def model_of(counts: DataFrame, languages: list[str], block_bytes: int = BLOCK_BYTES) -> Model:
    """Interpolated Kneser-Ney estimates from the counts of 4-grams (lang, before, char, n).

    A context, or a gram of the next lower order, has at most as many rows as there are characters.
    """
    n_lang = len(languages)
    levels = {ORDER: counts.select("lang", F.col("before").alias("context"), "char", "n")}
    for size in range(ORDER - 1, 0, -1):  # each distinct gram one longer is one continuation
        levels[size] = written(levels[size + 1].groupBy("lang", shorter(size).alias("context"), "char").agg(F.count(F.lit(1)).alias("n")), "grams")
    once = [
        level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).withColumn("size", F.lit(size))
        for size, level in levels.items()
    ]
    found = reduce(DataFrame.unionByName, once).collect()
    discounts = np.full((ORDER + 1, n_lang), 0.5)
    for r in found:
        if r.ones + r.twos:
            discounts[r.size, r.lang] = min(0.95, max(0.1, r.ones / (r.ones + 2 * r.twos)))
    vocabulary = levels[1].select("char").distinct().count() + 1
    unseen = np.full(n_lang, -np.log(vocabulary))
    for r in found:
        if r.size == 1:
            unseen[r.lang] += np.log(discounts[1, r.lang] * r.kinds / r.total)

    parts, lower = [], None
    places = F.sequence(F.lit(0), F.lit(n_lang - 1))
    for size in range(1, ORDER + 1):
        discount = F.array(*(F.lit(float(x)) for x in discounts[size]))
        sums = levels[size].groupBy("context", "lang").agg(F.sum("n").cast("double").alias("total"), F.count(F.lit(1)).alias("kinds"))
        sums = sums.withColumn("weight", F.get(discount, F.col("lang")) * F.col("kinds") / F.col("total"))
        contexts = written(dense(sums, ["context"], {"total": 1.0, "weight": 1.0}, n_lang), "contexts")
        grams = dense(levels[size].withColumn("n", F.col("n").cast("double")), ["context", "char"], {"n": 0.0}, n_lang).join(contexts, "context")
        if lower is None:
            grams = grams.withColumn("base", F.array_repeat(F.lit(1 / vocabulary), n_lang))
        else:
            grams = grams.withColumn("end", shorter(size - 1)).join(lower.select(F.col("context").alias("end"), "char", F.col("p").alias("base")), ["end", "char"])
        grams = grams.withColumn("discount", discount)
        p = F.transform(places, lambda i: F.greatest(F.get("n", i) - F.get("discount", i), F.lit(0.0)) / F.get("total", i) + F.get("weight", i) * F.get("base", i))
        lower = written(grams.select("context", "char", p.alias("p")), "estimates")
        parts.append(rows_of(lower, size, F.col("char"), "p"))
        if size > 1:
            parts.append(rows_of(contexts, size, F.lit(-1), "weight"))
    rows = reduce(DataFrame.unionByName, parts)
    blocks = max(1, -(-rows.count() * (ROW_BYTES + 4 * n_lang) // block_bytes))
    return Model(languages, rows, unseen.astype(np.float32), blocks)


def rows_of(df: DataFrame, size: int, char: Column, value: str) -> DataFrame:
    return df.select(F.lit(size).alias("size"), "context", char.alias("char"), F.transform(value, lambda x: F.log(x).cast("float")).alias("logs"))


def fit(train: DataFrame, block_bytes: int = BLOCK_BYTES) -> Model | None:
    """A model of every row of train (text, lang); rows without a language are left out."""
    train = train.select("text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL")
    languages = sorted(r[0] for r in train.select("lang").distinct().collect())
    if not languages:
        return None
    counts = written(gram_counts(train, languages), "grams")
    if counts.isEmpty():
        return None
    rest = counts.withColumn("n", F.col("n") - F.col("apart")).filter("n > 0")
    known = [] if rest.isEmpty() else calibration_rows(train, model_of(rest, languages, block_bytes))
    model = model_of(counts, languages, block_bytes)
    model.slope, model.offset = logistic(np.array([x for x, _ in known], bool), np.array([y for _, y in known], float))
    return model


def calibration_rows(train: DataFrame, model: Model) -> list[tuple[bool, float]]:
    """(is the best language right, its lead) of a bounded sample of the texts that the model was made without."""
    apart = train.filter(left_out())
    share = min(1.0, CALIBRATION_ROWS / max(1, apart.count()))
    sample = apart.sample(fraction=share, seed=7) if share < 1 else apart
    rows = with_best(sample, model, "x").select("lang", "x.*").collect()
    return [(r.best == r.lang, r.lead) for r in rows if r.best is not None]


def logistic(right: np.ndarray, lead: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with softened targets, which stays finite where all are right."""
    if not len(right):
        return 1.0, 0.0
    goal = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
    unit = max(float(np.median(np.abs(lead))), 1e-9)
    x, theta = np.stack([lead / unit, np.ones(len(lead))], 1), np.zeros(2)

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((np.logaddexp(0, z) - goal * z).sum() + 0.05 * (t * t).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - goal) + 0.1 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
    return float(max(theta[0], 1e-3) / unit), float(theta[1])


def summing_udf(block: Broadcast) -> Callable[[Column, Column], Column]:
    """struct(logs, size) of a text, to which the logs of earlier blocks are added."""

    @F.arrow_udf(SUMS)
    def udf(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        own: Block = block.value
        logs, sizes = own.sums(texts)
        if earlier.null_count < len(earlier):
            logs += earlier.field("logs").flatten().to_numpy().reshape(logs.shape)
        bounds = pa.array(np.arange(len(texts) + 1) * logs.shape[1], pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(bounds, pa.array(logs.ravel())), pa.array(sizes)], ["logs", "size"])

    return udf


def best_udf(languages: list[str]) -> Callable[[Column], Column]:
    """struct(best, lead, bits): best is null without letters; bits is the cross-entropy per character; the lead grows with the root of the length."""

    @F.arrow_udf("best string, lead double, bits double")
    def udf(sums: pa.Array) -> pa.Array:
        sizes = sums.field("size").to_numpy()
        none = sizes == 0
        bits = -sums.field("logs").flatten().to_numpy().reshape(len(sums), len(languages)) / np.maximum(sizes, 1)[:, None] / np.log(2)
        best = bits.argmin(1)
        if len(languages) == 1:
            lead = np.sqrt(sizes)
        else:
            two = np.partition(bits, 1, axis=1)
            lead = (two[:, 1] - two[:, 0]) * np.sqrt(np.minimum(sizes, 400))
        names = pa.array(languages).take(pa.array(best))
        masked = [pa.array(x, mask=none) for x in (names.to_numpy(zero_copy_only=False), lead, bits[np.arange(len(best)), best])]
        return pa.StructArray.from_arrays([masked[0].cast(pa.string()), *masked[1:]], ["best", "lead", "bits"])

    return udf


def with_best(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with a struct (best, lead, bits) by the given name; between passes, what was added up is written."""
    context = docs.sparkSession.sparkContext
    sums: Column = F.lit(None).cast(f"struct<{SUMS}>")
    for number in range(model.blocks):
        if number and number % SENT_BLOCKS == 0:
            docs = written(docs.withColumn(name, sums), "sums")
            sums = F.col(name)
        sums = summing_udf(context.broadcast(model.block(number)))(text_or_empty(), sums)
    return docs.withColumn(name, best_udf(model.languages)(sums))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score, rejected and bits_per_char."""
    new = ("lang_pred", "score", "rejected", "bits_per_char")
    kept = [c for c in docs.columns if c not in new]
    if model is None:
        return docs.select(*kept, F.lit("und").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(True).alias(new[2]), F.lit(None).cast("double").alias(new[3]))
    own = free_name("x", docs.columns)
    found = with_best(docs, model, own)
    score = F.coalesce(1 / (1 + F.exp(-(F.lit(model.slope) * F.col(f"{own}.lead") + F.lit(model.offset)))), F.lit(0.0))
    return found.select(*kept, F.coalesce(f"{own}.best", F.lit("und")).alias(new[0]), score.alias(new[1]), (score < REJECT_UNDER).alias(new[2]), F.col(f"{own}.bits").alias(new[3]))
