"""Queues of work as snapshots: what may be claimed, what is given up, and what comes back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import urls
from lapidary.sources import shared

MOST_ATTEMPTS = 5
LEASE_SECONDS = 900


def claimable(now: Column, most_attempts: int = MOST_ATTEMPTS) -> Column:
    """New or failed, not given up, attempts left, no live lease, and due."""
    return (
        F.col("state").isin("discovered", "failed")
        & F.col("dead_lettered_at").isNull()
        & (F.col("attempts") < most_attempts)
        & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now))
        & (F.col("next_attempt_after").isNull() | (F.col("next_attempt_after") <= now))
    )


def claim(queue: DataFrame, now: Column, n: int) -> DataFrame:
    """The next n rows by depth, then age, then id, with a lease (n is the size of the claim)."""
    top = queue.filter(claimable(now)).orderBy("depth", "discovered_at", "id").limit(n)
    return top.withColumn("lease_expires_at", now + F.make_dt_interval(secs=F.lit(LEASE_SECONDS)))


def recovered(queue: DataFrame, now: Column) -> DataFrame:
    """An expired lease is charged as an attempt, and gives the row back or up."""
    expired = F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") <= now)
    attempts = F.when(expired, F.col("attempts") + 1).otherwise(F.col("attempts"))
    state = F.when(expired, F.lit("failed")).otherwise(F.col("state"))
    dead = F.when(F.col("dead_lettered_at").isNull() & (state == "failed") & (attempts >= MOST_ATTEMPTS), now).otherwise(F.col("dead_lettered_at"))
    lease = F.when(~expired, F.col("lease_expires_at"))
    return queue.withColumns({"attempts": attempts, "state": state, "dead_lettered_at": dead, "lease_expires_at": lease})


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(21_600), 300 * F.pow(F.lit(2), F.greatest(F.lit(0), attempts - 1)).cast("long"))


def retry_class(status: Column) -> Column:
    """What a response status says about trying again."""
    return (
        F.when(status.isNull(), "retry").when(status.isin(408, 425, 429) | status.between(500, 599), "retry")
        .when(status.between(300, 399), "redirect").when(status.between(400, 499), "give up").otherwise("done")
    )


def robots_access(status: Column) -> Column:
    """A robots.txt that is not there allows all; one that cannot be had now denies all."""
    return F.when(status.isNull() | (status == 429) | (status >= 500), "deny").when(status >= 400, "allow").otherwise("parse")


#: Statuses that may be followed, how far, and the longest delay that is waited for.
FOLLOWED = (301, 302, 303, 307, 308)
MOST_HOPS = 5
MOST_DELAY_SECONDS = 300.0


def redirect(status: Column, location: Column, current: Column, history: Column, downgrade: Column) -> Column:
    """struct(follow, url, reason): the first reason against following a redirect; history has the URLs of the chain, the current one among them."""
    target = urls.canonical(urls.resolved(current, F.trim(location)))
    no = lambda reason: F.struct(F.lit(False).alias("follow"), F.lit(None).cast("string").alias("url"), F.lit(reason).alias("reason"))
    lower = (urls.scheme(current) == "https") & (urls.scheme(target) == "http") & ~downgrade
    return (
        F.when(~F.coalesce(status.isin(*FOLLOWED), F.lit(False)), no("status")).when(F.coalesce(F.trim(location), F.lit("")) == "", no("no location"))
        .when(F.size(history) - 1 >= MOST_HOPS, no("hops")).when(target.isNull(), no("location")).when(F.array_contains(history, target), no("loop")).when(lower, no("downgrade"))
        .otherwise(F.struct(F.lit(True).alias("follow"), target.alias("url"), F.lit(None).cast("string").alias("reason")))
    )


def redirect_chains(starts: DataFrame, responses: DataFrame, most_hops: int = MOST_HOPS, downgrade: bool = False) -> DataFrame:
    """(*starts, final_url, n_hops, reason): each start's url followed through the responses (url, status, location), as far as it may be.

    The reason is null where a chain arrives at a response that leads nowhere else, "no response"
    where nothing is known of a url, else the first that :func:`redirect` has.  Of several
    responses of a url the least counts; a start that is no proper url has the reason "location".

    Ways are doubled: 1, 2, 4 hops of every url, so rounds grow with the logarithm of most_hops.
    Only ways that are as long as they can be so far meet others, and each url has one way, so a
    target of very many urls repeats one row; what a chain may do is decided on its whole way.
    """
    known = responses.groupBy(urls.canonical(F.col("url")).alias("url")).agg(F.min(F.struct("status", F.trim("location").alias("location"))).alias("r")).filter("url IS NOT NULL")
    followed, given = F.coalesce(F.col("r.status").isin(*FOLLOWED), F.lit(False)), F.coalesce(F.col("r.location"), F.lit("")) != ""
    to = urls.canonical(urls.resolved(F.col("url"), F.col("r.location")))
    hops = known.select("url", F.when(~followed, "").when(~given, "no location").when(to.isNull(), "location").alias("ends"), F.when(followed & given, to).alias("to"))
    hops = shared.written(hops, "hops")
    ways, length, longest = hops.select("url", F.array_compact(F.array("to")).alias("way")), 1, most_hops + 1
    while length < longest:
        going = ways.filter(F.size("way") == length).withColumn("last", F.element_at("way", -1))
        further = ways.select(F.col("url").alias("last"), F.col("way").alias("more"))
        doubled = going.join(further, "last", "left").select("url", F.slice(F.concat("way", F.coalesce("more", F.array().cast("array<string>"))), 1, longest).alias("way"))
        ways, length = shared.written(ways.filter(F.size("way") < length).unionByName(doubled), "ways"), min(2 * length, longest)
    keyed = starts.withColumn("_url", urls.canonical(F.col("url")))
    walked = keyed.join(ways.select(F.col("url").alias("_url"), F.col("way").alias("_way")), "_url", "left")
    walked = walked.withColumn("_nodes", F.concat(F.array("_url"), F.coalesce("_way", F.array().cast("array<string>"))))
    ended = walked.withColumn("_last", F.element_at("_nodes", -1)).join(hops.select(F.col("url").alias("_last"), F.col("ends").alias("_ends"), F.lit(True).alias("_known")), "_last", "left")
    here, there = lambda i: F.get("_nodes", i), lambda i: F.get("_nodes", i + 1)
    lower = lambda i: (urls.scheme(here(i)) == "https") & (urls.scheme(there(i)) == "http") & F.lit(not downgrade)
    against = lambda i: F.when(i >= most_hops, "hops").when(F.array_position("_nodes", there(i)) <= i + 1, "loop").when(lower(i), "downgrade")
    n = F.size("_nodes")
    places = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    refused = F.filter(F.transform(places, lambda i: F.struct(i.alias("at"), against(i).alias("reason"))), lambda x: x["reason"].isNotNull())
    at_end = F.when(F.col("_url").isNull(), "location").when(F.col("_known").isNull(), "no response").when((F.col("_ends") == "location") & (n - 1 >= most_hops), "hops").otherwise(F.nullif("_ends", F.lit("")))
    stop = F.coalesce(F.get(refused, F.lit(0)), F.struct((n - 1).alias("at"), at_end.alias("reason")))
    kept = ended.withColumn("_stop", stop).withColumn("_final", F.get("_nodes", F.col("_stop.at")))
    return kept.select(*(F.col(c) for c in starts.columns), F.col("_final").alias("final_url"), F.col("_stop.at").alias("n_hops"), F.col("_stop.reason").alias("reason"))


def polite_limits(per_minute: Column, concurrency: Column, delay: Column, asked: Column) -> Column:
    """struct(per_minute, concurrency, delay, refused): limits after a crawl delay, which only ever slows down; one that is too long is refused."""
    slower = F.coalesce(asked > delay, F.lit(False))
    reachable = F.greatest(F.lit(1), F.floor(60 / asked).cast("int"))
    return F.struct(
        F.when(slower, F.least(per_minute, reachable)).otherwise(per_minute).alias("per_minute"), F.when(slower, F.lit(1)).otherwise(concurrency).alias("concurrency"),
        F.when(slower, asked).otherwise(delay).alias("delay"), F.coalesce(slower & (asked > MOST_DELAY_SECONDS), F.lit(False)).alias("refused"),
    )


def pattern_regex(pattern: str) -> str:
    """A robots path pattern as a regular expression: * is any run, a final $ is the end."""
    body = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$"))
    return f"^{body}{'$' if pattern.endswith('$') else ''}"


def robots_decision(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The longest matching pattern decides, a final $ not counted, and of equals one that allows; without a match all is allowed."""
    hits = [F.when(path.rlike(pattern_regex(p)), F.struct(F.lit(len(p.removesuffix("$"))).alias("length"), F.lit(allow).alias("allow"))) for allow, p in rules if p]
    best = F.array_max(F.array_compact(F.array(*hits)))
    return F.coalesce(best["allow"], F.lit(True))


def robots_groups(lines: DataFrame, agent: str) -> DataFrame:
    """(authority, line, name, value): the lines of the group that holds for the agent; lines: authority, line, text.

    Consecutive agent lines share the rules that follow; any other line ends them.  The longest
    name that is part of the agent's product name holds, and * where none is; of names as long, the first.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"#.*$", ""))
    kv = lines.withColumn("plain", plain).filter(F.col("plain").contains(":"))
    cut = F.instr("plain", ":")
    kv = kv.select("authority", "line", F.lower(F.trim(F.substring("plain", F.lit(1), cut - 1))).alias("name"), F.trim(F.substring("plain", cut + 1, F.char_length("plain"))).alias("value"))
    order = Window.partitionBy("authority").orderBy("line")
    starts = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")
    kv = kv.withColumn("starts", starts.cast("int")).withColumn("block", F.sum("starts").over(order))
    token = F.lower(F.lit(re.split(r"[/\s]", agent.strip(), maxsplit=1)[0]))
    who = F.lower("value")
    fit = kv.filter((F.col("name") == "user-agent") & (F.col("value") != "") & ((who == "*") | token.contains(who))).withColumn("who", who)
    best = fit.groupBy("authority").agg(F.max_by("who", F.struct(F.when(F.col("who") == "*", 0).otherwise(F.char_length("who")), -F.col("line"))).alias("who"))
    blocks = fit.join(best, ["authority", "who"]).select("authority", "block").distinct()
    return kv.filter("name <> 'user-agent'").join(blocks, ["authority", "block"]).select("authority", "line", "name", "value")


def parsed_robots(lines: DataFrame, agent: str) -> DataFrame:
    """(authority, allow, pattern) for the group that holds for the agent; lines: authority, line, text."""
    rules = robots_groups(lines, agent).filter("name IN ('allow', 'disallow') AND value <> ''")
    return rules.select("authority", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))


def crawl_delays(lines: DataFrame, agent: str) -> DataFrame:
    """(authority, seconds): the longest delay that the group asks for; numbers that are not above zero ask for nothing."""
    asked = robots_groups(lines, agent).filter("name = 'crawl-delay'").withColumn("seconds", F.col("value").try_cast("double"))
    return asked.filter("seconds > 0 AND NOT isnan(seconds) AND seconds < double('inf')").groupBy("authority").agg(F.max("seconds").alias("seconds"))


def robots_decisions(paths: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, allowed) of each row of paths (key, authority, path), by the rules (authority, allow, pattern) of its own authority.

    A pattern begins with literal text, up to its first *.  Each path is cut to the lengths that
    its authority's patterns have, and meets by equality the patterns that begin like it; what
    follows a * is checked there.  So a path meets the rules that can match it and no others.
    """
    anchored, body = F.col("pattern").endswith("$"), F.regexp_replace("pattern", r"\$$", "")
    literal = F.substring_index(body, "*", 1)
    quoted = F.regexp_replace(F.regexp_replace(body, r"[\\^$.|?+()\[\]{}]", r"\\$0"), r"\*", ".*")
    known = rules.select(
        "authority", "allow", literal.alias("prefix"), F.char_length(body).alias("length"),
        F.concat(F.lit("(?s)^"), quoted, F.when(anchored, "$").otherwise("")).alias("regex"), (body.contains("*") | anchored).alias("wild"),
    ).distinct()
    cuts = known.groupBy("authority").agg(F.collect_set(F.char_length("prefix")).alias("cuts"))
    cut = paths.join(cuts, "authority").select(key, "authority", "path", F.explode(F.filter("cuts", lambda n: n <= F.char_length(F.col("path")))).alias("n"))
    met = cut.withColumn("prefix", F.left("path", F.col("n"))).join(known, ["authority", "prefix"]).filter(~F.col("wild") | F.expr("path RLIKE regex"))
    every = paths.select(key, F.lit(-1).alias("length"), F.lit(True).alias("allow")).unionByName(met.select(key, "length", "allow"))
    return every.groupBy(key).agg(F.max(F.struct("length", "allow")).alias("best")).select(key, F.col("best.allow").alias("allowed"))
