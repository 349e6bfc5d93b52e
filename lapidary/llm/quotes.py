"""Quotation linking: from messages that quote one another to reply-ordered conversations.

A line's quote level is the number of ``>`` that it begins with.  Consecutive lines of one
level make a passage; a line that announces a quotation ("... wrote:") right before a deeper
passage belongs to the quotation.  Passages are lower-cased, their white space is made even,
and they are hashed.  A message's own words give hashes of the whole, of its paragraphs
and of its lines, so that a passage is found whichever of these was quoted; a passage that
is found nowhere is tried line by line.

A quotation is linked to the latest earlier turn of its conversation that says it, else to
the first message anywhere before it (by conversation and turn).  The first linked passage
of level 1 names the message that is replied to.  Threads follow these replies up to a
message that replies to none.  A message's place in its thread is that of a walk in which
each message is followed by its answers, with all that answers these, in order of
conversation and turn; it is found by ranking the list of the walk's steps by doubling.

Joins are by hash with at most one original for each hash and conversation, or sorted
unions, so that phrases which everybody says do not multiply.  No conversation is gathered
in one row.

Nulls and ties: a null text is empty.  Messages without a conversation or turn are neither
linked nor linked to.  Rows that share conversation and turn are one message with several
texts: each keeps its own words, and the reply of the group is the least.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.common import text_or_empty, written

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ANNOUNCES = re.compile(r"wrote:\s*$")
MOST_ROUNDS = 64


def levels(text: str) -> Iterator[tuple[int, str]]:
    """(quote level, rest) of each line."""
    for line in text.split("\n"):
        m = MARKS.match(line)
        yield (m[1].count(">"), line[m.end() :]) if m else (0, line)


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines) of each maximal run of lines of one level; announcements go with what they announce."""
    runs: list[tuple[int, list[str]]] = []
    for level, line in levels(text):
        if runs and runs[-1][0] == level:
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
    for (low, lines), (high, _) in zip(runs, runs[1:], strict=False):
        if high > low:
            at = len(lines)
            while at and not lines[at - 1].strip():
                at -= 1
            if at and ANNOUNCES.search(lines[at - 1]):
                del lines[at - 1 :]
    return [(level, lines) for level, lines in runs if lines]


def normalised(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def digest(words: str) -> int:
    return xxhash.xxh3_64_intdigest(words) - (1 << 63)


def paragraphs(lines: list[str]) -> Iterator[list[str]]:
    own: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            own.append(line)
        elif own:
            yield own
            own = []


def parsed(text: str) -> dict:
    """own words, quoted passages in order (level, hash, hashes of their lines), hashes of what the message itself says."""
    found = passages(text)
    own = [lines for level, lines in found if level == 0]
    flat = [line for lines in own for line in lines]
    said = {normalised(flat), *(normalised(p) for lines in own for p in paragraphs(lines)), *(normalised([x]) for x in flat)} - {""}
    quotes = [{"level": level, "hash": digest(normalised(lines)), "lines": [digest(y) for x in lines if (y := normalised([x]))]} for level, lines in found if level and normalised(lines)]
    return {"own": "\n".join(flat).strip() if quotes else text, "quotes": quotes, "said": [digest(x) for x in sorted(said)]}


PARSED = "own string, quotes array<struct<level:int,hash:bigint,lines:array<bigint>>>, said array<bigint>"


def parsed_udf() -> Callable[[Column], Column]:
    quote = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("lines", pa.list_(pa.int64()))])
    kind = pa.struct([("own", pa.string()), ("quotes", pa.list_(quote)), ("said", pa.list_(pa.int64()))])

    @F.arrow_udf(PARSED)
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([parsed(t) for t in texts.to_pylist()], kind)

    return udf


def originals(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, to_conv, to_turn) for each different (conv_id, turn, hash) asked for that has an original."""
    near = said.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").select("conv_id", "hash", "turn", F.lit(True).alias("says"))
    marked = near.union(asked.select("conv_id", "hash", "turn", F.lit(False))).distinct()
    # an original of the same turn is no earlier one: quotations of a turn sort before what it says
    before = Window.partitionBy("conv_id", "hash").orderBy("turn", "says").rowsBetween(Window.unboundedPreceding, -1)
    same = marked.withColumn("to_turn", F.last(F.when(F.col("says"), F.col("turn")), ignorenulls=True).over(before)).filter("NOT says")
    first = said.join(asked.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    joined = same.join(first, "hash", "left")
    earlier = F.col("first") < F.struct("conv_id", "turn")
    return joined.select(
        "conv_id", "turn", "hash",
        F.when(F.col("to_turn").isNotNull(), F.col("conv_id")).when(earlier, F.col("first.conv_id")).alias("to_conv"),
        F.coalesce("to_turn", F.when(earlier, F.col("first.turn"))).alias("to_turn"),
    ).filter("to_turn IS NOT NULL")


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of each message that replies, by doubling the steps upwards."""
    up = written(replies.select("conv_id", "turn", F.col("to_conv").alias("root_conv"), F.col("to_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "replies")
    for _ in range(MOST_ROUNDS):
        above = up.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("c"), F.col("root_turn").alias("t"), F.col("depth").alias("d"))
        joined = up.join(above, ["root_conv", "root_turn"], "left")
        up = written(joined.select("conv_id", "turn", F.coalesce("c", "root_conv").alias("root_conv"), F.coalesce("t", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("c").isNotNull().alias("moved")), "replies")
        if not up.filter("moved").limit(1).count():
            return up.drop("moved")
        up = up.drop("moved")
    raise RuntimeError(f"replies are nested more than 2**{MOST_ROUNDS} deep")


def walked(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, behind) of each message that replies or is replied to: how many messages of its thread its walk has from it on.

    The walk enters a message, then its answers, and leaves it.  Each step has one next step
    and is the next of one, so that no key repeats in the joins that double the steps.
    """
    at = lambda c, t, leave: F.struct(F.col(c).alias("c"), F.col(t).alias("t"), F.lit(leave).alias("leave"))
    answers = Window.partitionBy("to_conv", "to_turn").orderBy("conv_id", "turn")
    edges = replies.select("conv_id", "turn", "to_conv", "to_turn")
    edges = edges.withColumns({"nth": F.row_number().over(answers), "next": F.lead(at("conv_id", "turn", False)).over(answers)})
    first = edges.filter("nth = 1").select(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn"), at("conv_id", "turn", False).alias("into"))
    nodes = edges.select("conv_id", "turn").union(edges.select("to_conv", "to_turn")).distinct()
    enters = nodes.join(first, ["conv_id", "turn"], "left").select(at("conv_id", "turn", False).alias("step"), F.coalesce("into", at("conv_id", "turn", True)).alias("next"), F.lit(1).cast("long").alias("n"))
    leaves = edges.select(at("conv_id", "turn", True).alias("step"), F.coalesce("next", at("to_conv", "to_turn", True)).alias("next"), F.lit(0).cast("long").alias("n"))
    steps = written(enters.unionByName(leaves), "walk")
    for _ in range(MOST_ROUNDS):
        after = steps.select(F.col("step").alias("next"), F.col("next").alias("then"), F.col("n").alias("more"))
        steps = written(steps.join(after, "next", "left").select("step", F.col("then").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "walk")
        if not steps.filter("next IS NOT NULL").limit(1).count():
            return steps.filter("NOT step.leave").select(F.col("step.c").alias("conv_id"), F.col("step.t").alias("turn"), F.col("n").alias("behind"))
    raise RuntimeError(f"threads of more than 2**{MOST_ROUNDS} steps")


def linked_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, reply_conv, reply_turn, thread_conv, thread_turn, depth, place) of every row.

    text is what the message itself says.  Sorted by thread_conv, thread_turn and place, the
    rows are the reply-ordered conversations; rows of one message share their place.
    """
    rows = messages.select("conv_id", "turn", "role", parsed_udf()(text_or_empty()).alias("p"))
    rows = written(rows.select("conv_id", "turn", "role", "p.*"), "messages")
    keyed = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = keyed.select("conv_id", "turn", F.explode("said").alias("hash"))
    quoted = keyed.select("conv_id", "turn", F.posexplode("quotes").alias("place", "q")).select("conv_id", "turn", "place", "q.*")
    quoted = written(quoted, "quoted")
    whole = written(originals(quoted.select("conv_id", "turn", "hash").distinct(), said), "originals")
    missing = quoted.join(whole, ["conv_id", "turn", "hash"], "left_anti")
    lines = missing.select("conv_id", "turn", "place", "level", F.posexplode("lines").alias("line", "hash"))
    by_line = originals(lines.select("conv_id", "turn", "hash").distinct(), said)
    key = ["conv_id", "turn", "hash"]
    found = quoted.join(whole, key).select("conv_id", "turn", "place", "level", F.lit(0).alias("line"), "to_conv", "to_turn")
    found = found.union(lines.join(by_line, key).select("conv_id", "turn", "place", "level", "line", "to_conv", "to_turn"))
    order = F.struct("place", "line", "to_conv", "to_turn")
    per_message = written(
        found.groupBy("conv_id", "turn").agg(
            F.count_distinct("place").alias("n_linked"), F.min(F.when(F.col("level") == 1, order)).alias("reply")
        ),
        "linked",
    )
    replies = per_message.filter("reply IS NOT NULL").select("conv_id", "turn", F.col("reply.to_conv").alias("to_conv"), F.col("reply.to_turn").alias("to_turn"))
    up = threads(replies)
    walk = written(walked(replies), "walked")
    whole = walk.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("behind").alias("size"))
    ranked = up.join(walk, ["conv_id", "turn"]).join(whole, ["root_conv", "root_turn"]).withColumn("place", F.col("size") - F.col("behind"))
    marks = per_message.join(ranked, ["conv_id", "turn"], "left").select("conv_id", "turn", "n_linked", F.col("reply.to_conv").alias("reply_conv"), F.col("reply.to_turn").alias("reply_turn"), "root_conv", "root_turn", "depth", "place")
    return rows.join(marks, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"),
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_conv", "reply_turn",
        F.coalesce("root_conv", "conv_id").alias("thread_conv"),
        F.coalesce("root_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("place", F.lit(0)).cast("long").alias("place"),
    )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """The messages without quotations, dealt out and sorted so that each thread reads in order."""
    linked = linked_messages(messages)
    order = ["thread_conv", "thread_turn", "place", "conv_id", "turn"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)
