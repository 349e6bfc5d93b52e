"""Internet addresses as sixteen or four bytes in hexadecimal digits, and the ranges that must not be fetched from; all of it expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons in the order in which they are given, with the ranges that have them (the special-purpose registries of IANA).
REFUSED = {
    "ipv4_mapped": ("::ffff:0:0/96",),
    "embedded_ipv4": ("64:ff9b::/96", "64:ff9b:1::/48", "2002::/16", "2001::/32"),
    "unspecified": ("0.0.0.0/32", "::/128"),
    "loopback": ("127.0.0.0/8", "::1/128"),
    "link_local": ("169.254.0.0/16", "fe80::/10"),
    "multicast": ("224.0.0.0/4", "ff00::/8"),
    "carrier_grade_nat": ("100.64.0.0/10",),
    "documentation": ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "198.18.0.0/15", "2001:db8::/32"),
    "reserved": ("240.0.0.0/4", "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"),
    "private": ("0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "2001::/23", "fc00::/7"),
}
#: Parts of private ranges that are public.
PUBLIC = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

V4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?=[0-9])|\z)){4}\z"
V4_TAIL = r":([0-9]+(?:\.[0-9]+){3})\z"


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression that is named several times would be computed as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def v4_digits(text: Column) -> Column:
    """Eight hexadecimal digits; null for what is no IPv4 address."""
    pair = lambda part: F.lpad(F.lower(F.hex(part.try_cast("int"))), 2, "0")
    return F.when(text.rlike(V4), F.array_join(F.transform(F.split(text, r"\."), pair), ""))


def v6_digits(text: Column) -> Column:
    """Thirty-two hexadecimal digits; null for what is no IPv6 address.  A zone is left out, a dotted end counts as two groups."""
    none = F.array().cast("array<string>")

    def plain(x: Column) -> Column:
        colons = lambda end: F.concat(F.left(x["body"], F.char_length(x["body"]) - F.char_length(x["dotted"])), F.left(end, F.lit(4)), F.lit(":"), F.right(end, F.lit(4)))
        return F.when(x["dotted"] == "", x["body"]).otherwise(bound(v4_digits(x["dotted"]), colons))

    def sides(halves: Column) -> Column:
        groups = lambda i: F.when(F.coalesce(F.get(halves, F.lit(i)), F.lit("")) == "", none).otherwise(F.split(F.get(halves, F.lit(i)), ":", -1))
        return F.struct(F.size(halves).alias("n"), groups(0).alias("head"), groups(1).alias("tail"))

    def digits(x: Column) -> Column:
        missing = 8 - F.size(x["head"]) - F.size(x["tail"])
        whole = F.when(x["n"] == 1, missing == 0).when(x["n"] == 2, missing > 0).otherwise(False)
        joined = lambda every: F.when(F.forall(every, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))
        return F.when(whole, bound(F.concat(x["head"], F.array_repeat(F.lit("0"), missing), x["tail"]), joined))

    body = F.lower(F.regexp_replace(text, r"%[^%]+\z", ""))
    parts = bound(body, lambda b: F.struct(b.alias("body"), F.regexp_extract(b, V4_TAIL, 1).alias("dotted")))
    return F.when(F.contains(text, F.lit(":")), bound(F.split(bound(parts, plain), "::", -1), lambda h: bound(sides(h), digits)))


def within(v4: Column, v6: Column, ranges: tuple[str, ...]) -> Column:
    """Whether an address lies in one of the ranges."""
    found = F.lit(False)
    for network in map(ipaddress.ip_network, ranges):
        digits, width = (v4, 8) if network.version == 4 else (v6, 32)
        low, high = (format(int(network[i]), f"0{width}x") for i in (0, -1))
        found = found | F.coalesce(digits.between(low, high), F.lit(False))
    return found


def refused(text: Column) -> Column:
    """Why an address must not be fetched from: the first reason that holds, "malformed" for what is none and for null; null where nothing is against it."""
    both = F.struct(v4_digits(text).alias("v4"), v6_digits(text).alias("v6"))

    def judged(x: Column) -> Column:
        v4, v6 = x["v4"], x["v6"]
        public = within(v4, v6, PUBLIC)
        reasons = [F.when(within(v4, v6, ranges) & (~public if why == "private" else F.lit(True)), why) for why, ranges in REFUSED.items()]
        return F.when(v4.isNull() & v6.isNull(), "malformed").otherwise(F.coalesce(*reasons))

    return bound(both, judged)
