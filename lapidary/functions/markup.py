"""Links of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The elements that link, by the attribute that says where to, and how many links of a page count.
LINKING = {"a": "href", "area": "href", "iframe": "src"}
MOST_LINKS = 5000
#: Links that are held as Python objects at once.
STEP_LINKS = 20_000


class _Targets(HTMLParser):
    """Stops by itself once there is one target more than may be kept."""

    class Enough(Exception):
        pass

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.found = most, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = LINKING.get(tag)
        self.found += [value.strip() for name, value in attrs if at == name and (value or "").strip()] if at else []
        if len(self.found) > self.most:
            raise self.Enough


def targets(html: str | None, most: int = MOST_LINKS) -> tuple[list[str], bool]:
    """Where a page links to, in order, repeats kept, and whether it has more than that; markup that cannot be read ends it, what came before counts."""
    page = _Targets(most)
    try:
        page.feed(html or "")
        page.close()
    except (_Targets.Enough, AssertionError, ValueError):
        pass
    return page.found[:most], len(page.found) > most


LINKS = pa.struct([("links", pa.list_(pa.string())), ("more", pa.bool_())])


def links_of(pages: pa.Array, most: int) -> pa.Array:
    """:func:`targets` of each page; only some pages' links are Python objects at a time."""
    done, found, size = [], [], 0
    for page in pages:
        here, more = targets(page.as_py(), most)
        found.append({"links": here, "more": more})
        size += len(here) + 1
        if size >= STEP_LINKS:
            done.append(pa.array(found, LINKS))
            found, size = [], 0
    return pa.concat_arrays([*done, pa.array(found, LINKS)])


def links(html: Column, most: int = MOST_LINKS) -> Column:
    """struct(links, more) of :func:`targets`: quoted or not, character references resolved, comments and scripts passed over; a page that is null has none."""

    @F.arrow_udf("links array<string>, more boolean")
    def scanned(pages: pa.Array) -> pa.Array:
        return links_of(pages, most)

    return scanned(html)
