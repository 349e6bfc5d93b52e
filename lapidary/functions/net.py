"""What needs Python's own tables: Unicode forms, name-based ids, address ranges; and header values."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that some systems keep for devices.
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}
MOST_NAME_CHARS = 128
MOST_SHOWN_CHARS = 128


#: Fixed value: the namespace of document ids.
NAMESPACE = uuid.UUID("852e666c-780a-5903-85c4-d357129f3878")


def each(f: Callable[[str | None], str | None], column: Column) -> Column:
    """A Python function of strings, over batches."""

    @F.arrow_udf("string")
    def udf(values: pa.Array) -> pa.Array:
        return pa.array(map(f, values.to_pylist()), pa.string())

    return udf(column)


def document_id(digest: Column) -> Column:
    """The same id for the same digest, in every run."""
    return each(lambda x: None if x is None else str(uuid.uuid5(NAMESPACE, x)), digest)


def safe_name(name: str | None) -> str | None:
    """The last part of a path, in compatibility form, of letters, digits, dot, underscore and hyphen; null where none is left."""
    last = re.split(r"[/\\]", unicodedata.normalize("NFKC", name or ""))[-1].replace("\0", "")
    plain = re.sub(r"[^A-Za-z0-9._-]+", "_", last).strip("._-")
    stem, dot, extension = plain.rpartition(".") if "." in plain else (plain, "", "")
    if stem.lower() in RESERVED:
        stem += "_file"
    if len(stem + dot + extension) > MOST_NAME_CHARS and len(extension) <= 8:
        stem = stem[: MOST_NAME_CHARS - len(dot + extension)]
    return f"{stem}{dot}{extension}"[:MOST_NAME_CHARS].strip("._-") or None


def safe_filename(name: Column) -> Column:
    return each(safe_name, name)


#: Ranges that stand for something else than a public host, with why they are refused.
EMBEDDED = [ipaddress.ip_network(x) for x in ("64:ff9b::/96", "64:ff9b:1::/48", "2002::/16", "2001::/32")]
DOCUMENTATION = [ipaddress.ip_network(x) for x in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32", "198.18.0.0/15")]
CARRIER = ipaddress.ip_network("100.64.0.0/10")


def address_reason(text: str | None) -> str | None:
    """Why one address must not be fetched from, or null: the first of these that holds.  Columns of them: :func:`lapidary.functions.addresses.refused`."""
    try:
        ip = ipaddress.ip_address(text or "")
    except ValueError:
        return "malformed"
    checks = {
        "ipv4_mapped": getattr(ip, "ipv4_mapped", None) is not None,
        "embedded_ipv4": any(ip in x for x in EMBEDDED),
        "unspecified": ip.is_unspecified,
        "loopback": ip.is_loopback,
        "link_local": ip.is_link_local,
        "multicast": ip.is_multicast,
        "carrier_grade_nat": ip in CARRIER,
        "documentation": any(ip in x for x in DOCUMENTATION),
        "reserved": ip.is_reserved,
        "private": ip.is_private,
        "not_globally_routable": not ip.is_global,
    }
    return next((why for why, holds in checks.items() if holds), None)


def shown_name(name: Column) -> Column:
    """A file name as it is shown: the last part of a path without control characters, blanks even; upload where none is left."""
    last = F.element_at(F.split(name, r"[/\\\\]"), -1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(last, r"[\x00-\x1F\x7F]", ""), r"\s+", " "))
    return F.coalesce(F.nullif(F.left(F.btrim(plain, F.lit(". ")), F.lit(MOST_SHOWN_CHARS)), F.lit("")), F.lit("upload"))


def content_length(value: Column) -> Column:
    """Absent is null; what is no length is an error."""
    return F.when(value.isNull(), None).when(value.rlike("^[0-9]{1,18}$"), value.try_cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no content length: "), value)).cast("bigint"))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds, or the seconds until an HTTP date; never below zero; other values are null."""
    until = F.try_to_timestamp(F.regexp_extract(value, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(value.rlike("^[0-9]{1,9}$"), value.try_cast("bigint")).otherwise(F.unix_timestamp(until) - F.unix_timestamp(now))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0).cast("bigint"), wait))


def disposition_filename(value: Column) -> Column:
    """The file name of a Content-Disposition header, the encoded form first."""
    encoded = F.nullif(F.regexp_extract(value, r"(?i)filename\*\s*=\s*UTF-8''([^;\s]+)", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(value, r'(?i)filename\s*=\s*"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    bare = F.nullif(F.trim(F.regexp_extract(value, r'(?i)filename\s*=\s*([^";]+)', 1)), F.lit(""))
    return F.coalesce(F.try_url_decode(encoded), F.regexp_replace(quoted, r"\\(.)", "$1"), bare)
