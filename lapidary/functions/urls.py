"""URLs, links of pages, and file formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each format, and the bytes that files of a format begin with (in hexadecimal).
EXTENSIONS = {
    "pdf": ["pdf"], "xlsx": ["xlsx"], "xls": ["xls"], "docx": ["docx"], "doc": ["doc"], "csv": ["csv"], "json": ["json"],
    "xml": ["xml"], "html": ["html", "htm"], "zip": ["zip"], "png": ["png"], "jpeg": ["jpg", "jpeg"], "tiff": ["tif", "tiff"],
}
SIGNATURES = [
    ("255044462D", "pdf"),
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("49492A00", "tiff"),
    ("4D4D002A", "tiff"),
    ("D0CF11E0A1B11AE1", "doc"),
    ("504B0304", "zip"),
]
#: Formats that share a container, so that its first bytes name only one of them.
CONTAINERS = {"zip": ["zip", "xlsx", "docx"], "doc": ["doc", "xls"]}


def sniffed(content: Column) -> Column:
    """The format that the first bytes name, or null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*(F.when(head.startswith(magic), F.lit(kind)) for magic, kind in SIGNATURES))


def compatible(declared: Column, found: Column) -> Column:
    """Nothing found is no contradiction."""
    shared = F.coalesce(*(F.when(found == box, declared.isin(kinds)) for box, kinds in CONTAINERS.items()))
    return found.isNull() | F.coalesce(shared, declared == found)


def format_of_path(path: Column) -> Column:
    """The format that a path's extension names, or null."""
    known = F.create_map(*(F.lit(x) for kind, names in EXTENSIONS.items() for name in names for x in (name, kind)))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./?#]+)(?:[?#].*)?$", 1)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path(url: Column) -> Column:
    """The path with a slash at least, without query and fragment."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def path_and_query(url: Column) -> Column:
    return F.concat(path(url), F.regexp_extract(url, r"(\?[^#]*)", 1))


#: The ports that are spoken to.
PORTS = ("80", "443")


def ascii_host(url: Column) -> Column:
    """The host as it goes over the wire: no final dot, other scripts in Punycode; null where a name cannot be written so."""
    plain = F.regexp_replace(host(url), r"\.$", "")
    return F.when(plain.rlike(r"[^\x00-\x7F]"), F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), plain)).otherwise(plain)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment; null for other schemes, credentials and ports."""
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#@]*:([0-9]+)(?:[/?#]|$)", 1)
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    default = F.when(scheme(url) == "https", "443").otherwise("80")
    shown = F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port))
    allowed = scheme(url).isin("http", "https") & ~url.rlike(r"^[A-Za-z]+://[^/?#]*@") & (host(url) != "") & port.isin("", *PORTS)
    return F.when(allowed, F.concat(scheme(url), F.lit("://"), ascii_host(url), shown, path(url), query))


def hrefs(html: Column) -> Column:
    """The targets of all quoted href attributes, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"'#]*)"""), F.lit(1)))


def resolved(base: Column, link: Column) -> Column:
    """A link in a page: absolute, from the scheme, from the root, or beside the page."""
    link = F.regexp_replace(link, "#.*$", "")
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link == "", base)
        .otherwise(F.concat(root, folder, link))
    )


def host_allowed(own: Column, base_host: Column, others: list[str]) -> Column:
    """The source's own host and its subdomains, or a listed host exactly."""
    return (own == base_host) | own.endswith(F.concat(F.lit("."), base_host)) | own.isin(*others) if others else (own == base_host) | own.endswith(F.concat(F.lit("."), base_host))


def link_kind(url: Column, base_host: Column, depth: Column, most_depth: int, others: list[str] | None = None, denied: str = r"(?!)") -> Column:
    """struct(kind, reason): the first reason against a link, else a document by its extension, else a page to follow."""
    verdict = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    kind = format_of_path(path(url))
    return (
        F.when(~scheme(url).isin("http", "https"), verdict("ignored", "scheme"))
        .when(~host_allowed(host(url), base_host, others or []), verdict("ignored", "host"))
        .when(url.rlike(denied), verdict("ignored", "denied"))
        .when(kind.isNotNull() & (kind != "html"), verdict("document", None))
        .when(depth >= most_depth, verdict("ignored", "depth"))
        .otherwise(verdict("page", None))
    )
