"""The lines of bills, read in order: what a line is depends on the lines before it.

An Arrow batch holds documents with their pages, and these functions give the rows, blocks or
totals that each document's lines state, as texts; numbers are made of them by expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of priced rows, and units that count only where no letter stands before them.
UNITS = "Cumt|Cum|Sqmt|Sqm|Rmt|Mtrs|Metre|Meter|Mtr|Litres|Litre|Ltr|Quintal|Tonne|Km|MT|Nos|No|Each|Kg|Set|Job|LS|Pair|Points|Point|Joint|Month|Day|CM|m2|m3"
WORD_UNITS = "Sets|Pts|Pt|Rmtr|RM"
#: Figures, totals and numbers as bills print them.
QUANTITY = r"\(?[0-9][0-9,]*(?:\.[0-9]+)?\)?"
MONEY = r"\(?[0-9][0-9,]*\.[0-9]{2}\)?"
MONEY_LINE = r"^\(?[0-9,]+\.[0-9]{2}\)?$"
UNIT_LINE = rf"(?i)^(?:{WORD_UNITS}|{UNITS})\.?$"
#: The end of a row, and what stands in it behind its unit.
ROW_END = rf"(?i)((?<![A-Za-z])(?:{WORD_UNITS})|{UNITS})\.?\s*({QUANTITY})\s+({MONEY})\s+({MONEY})\s*$"
BEHIND_UNIT = "0123456789.,() \t\n\r\f\x0b\x85\u2028\u2029"
BARE_TRIPLE = rf"^({QUANTITY})\s+({MONEY})\s+({MONEY})\s*$"
MONEY_END = r"\.[0-9]{2}\)?\s*$"
ITEM_LINE = r"^([0-9]{1,3})(?:\s+(\S.*))?$"
NESTED_ITEM = r"^([0-9]+(?:\.[0-9]+)*)(?=\s|[A-Za-z])\s*(.*)$"
SUB_ITEM = r"(?i)^\([a-z]\)$"
PAGE_MARKER = r"^[IVXL]+-[0-9]+$"
TOTAL_LABEL = r"(?i)^(?:Grand\s+)?Total(?:\s+(?:Estimated\s+)?(?:Cost|Amount|Price))?$"
SECTION_TOTAL = r"(?i)^(?:Sub-?)?Total\b.*?[0-9,]+\.[0-9]{2}\s*$"
INLINE_TOTAL = r"(?i)^(?:Grand\s+)?Total\s+(\(?[0-9,]+\.[0-9]{2}\)?)$"
#: Lines of context that a description takes, and characters of the longest unit.
MOST_CONTEXT, MOST_UNIT = 41, 7
#: Documents whose lines are held as Python objects at once.
STEP_DOCUMENTS = 256

Lines = list[tuple[int, str]]


def finder(pattern: str) -> Callable[[str], re.Match | None]:
    """A pattern as Spark's expressions read it: ASCII only, and Unicode's line separators are no "." but may stand behind the end."""
    plain = pattern.replace(".*", r"[^\x85\u2028\u2029]*").replace("$", r"(?=[\x85\u2028\u2029]?\Z)").replace(r"\b", r"(?u:\b)")
    return re.compile(plain, re.ASCII).search


row_end, bare_triple, money_end, money_line, unit_line = map(finder, (ROW_END, BARE_TRIPLE, MONEY_END, MONEY_LINE, UNIT_LINE))
item_line, nested_item, sub_item, page_marker = map(finder, (ITEM_LINE, NESTED_ITEM, SUB_ITEM, PAGE_MARKER))
total_label, section_total, inline_total, one_line = map(finder, (TOTAL_LABEL, SECTION_TOTAL, INLINE_TOTAL, r"^.*\Z"))
rare_break, line_break = re.compile(r"[\r\f\x0B]").search, re.compile(r"\r\n|[\n\r\f\x0B]").split


def lines_of(pages: Iterable[tuple[int, str]]) -> Lines:
    cut = lambda text: line_break(text) if rare_break(text) else text.split("\n")
    return [(page, line.strip(" \t\xa0")) for page, text in pages for line in cut(text.replace("\x01", " "))]


def row_line(text: str) -> tuple[str, str, str, str, str] | None:
    """What stands before the unit, the unit and the three figures of a row.  No letter is behind the unit, so it is tried only where the last letters are."""
    found = row_end(text, max(len(text.rstrip(BEHIND_UNIT)) - MOST_UNIT, 0))
    head = text[: found.start()] if found else None
    return None if head is None or not (text.isascii() or one_line(head)) else (head, *found.groups())


# What is asked of a line before a pattern is tried is what the pattern itself begins with.


def passed_over(text: str) -> bool:
    return not text or (text[0] in "IVXL" and bool(page_marker(text)))


LINE_ROW = {"order": "int", "page": "int", "item": "string", "head": "string", "own": "string", "unit": "string", "quantity_literal": "string", "rate_literal": "string", "amount_literal": "string", "context": "string"}


def line_rows(lines: Lines) -> list[tuple]:
    """LINE_ROW of each row: an item number holds until the next, and lines since the last row or item describe the row."""
    unit, item, pieces, rows = None, None, [], []
    for page, text in lines:
        above_unit, unit = unit, None
        if passed_over(text) or (text[0] in "SsTt" and section_total(text)):
            continue
        row = bare = None
        if "." in text and money_end(text):
            bare = bare_triple(text)
            row = None if bare else row_line(text)
        elif len(text) <= MOST_UNIT + 2 and unit_line(text):
            unit = text
        if bare and above_unit is not None:
            rows.append((len(rows) + 1, page, item, None, None, above_unit, *bare.groups(), " ".join(pieces)))
            pieces = []
            continue
        head = row[0].strip(" ") if row else None
        shown = text if head is None else head
        numbered = nested_item(shown) if shown[:1].isdigit() else None
        item = numbered[1] if numbered else item
        if row:
            rows.append((len(rows) + 1, page, item, head, numbered[2] if numbered else None, *row[1:], " ".join(pieces)))
            pieces = []
            continue
        pieces = [] if numbered else pieces
        piece = numbered[2] if numbered else text
        if piece and len(pieces) < MOST_CONTEXT:
            pieces.append(piece)
    return rows


def table_items(lines: Lines) -> tuple[Lines, list[tuple[int, re.Match]], int | None]:
    """The lines of a table that count, where its items 1, 2, 3, ... start (other numbers are within the text), and where the total is labelled behind the first of them."""
    kept = [x for x in lines if not passed_over(x[1])]
    starts, labels = [], []
    for i, (_, text) in enumerate(kept):
        found = item_line(text) if text[0].isdigit() else None
        if found:
            if int(found[1]) == len(starts) + 1:
                starts.append((i, found))
        elif text[0] in "GgTt" and total_label(text):
            labels.append(i)
    return kept, starts, next((i for i in labels if not starts or i > starts[0][0]), None)


SUB_BLOCK = {"block": "int", "sub": "int", "number": "string", "letter": "string", "page": "int", "size": "int", "lines": "array<string>"}


def sub_blocks(lines: Lines) -> list[tuple]:
    """SUB_BLOCK of each item up to the total, its number cut off: one for each sub-item, whose lines are those above the first and its own."""
    kept, starts, total = table_items(lines)
    end, rows = len(kept) if total is None else total, []
    begun = [x for x in starts if x[0] < end]
    for block, (at, found) in enumerate(begun, 1):
        after = [text for _, text in kept[at + 1 : begun[block][0] if block < len(begun) else end]]
        own = [found[2]] * bool(found[2])
        marked = [i for i, text in enumerate(after) if sub_item(text)]
        head = (found[1], None, kept[at][0], len(own) + len(after))
        if not marked:
            rows.append((block, 0, *head, own + after))
        for sub, i in enumerate(marked):
            below = after[i + 1 : marked[sub + 1] if sub + 1 < len(marked) else len(after)]
            rows.append((block, sub, head[0], after[i][1].lower(), *head[2:], own + after[: marked[0]] + below))
    return rows


STATED = {"page": "int", "text": "string", "literal": "string"}


def table_total(lines: Lines) -> list[tuple]:
    """STATED of the first figure behind the total's label."""
    kept, _, total = table_items(lines)
    behind = kept[total + 1 :] if total is not None else []
    return next(([(page, text, text)] for page, text in behind if money_line(text)), [])


def hundredths(literal: str, digits: int) -> int | None:
    """A figure with two places as a whole number; below zero in parentheses, null if it has more digits than there is room for."""
    bracketed = literal[0] == "(" and literal[-1] == ")"
    whole, _, places = (literal[1:-1] if bracketed else literal).replace(",", "").partition(".")
    if not (whole.isdigit() and places.isdigit()) or len(whole.lstrip("0")) > digits:
        return None
    return -int(whole + places) if bracketed else int(whole + places)


def line_total(lines: Lines) -> list[tuple]:
    """STATED of the first bare total above zero that is not less than the sum of the rows, which can only total the whole."""
    stated = [(page, text, found[1]) for page, text in lines if text[:1] in ("G", "g", "T", "t") and (found := inline_total(text))]
    if not stated:
        return []
    least = sum(hundredths(row[-2], 12) or 0 for row in line_rows(lines))
    values = ((x, hundredths(x[2], 16)) for x in stated)
    return next(([x] for x, value in values if value is not None and value > 0 and value >= least), [])


ARROW = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def read(pages: Column, shape: dict[str, str], of: Callable[[Lines], list[tuple]], other: Column | None = None, of_other: Callable[[Lines], list[tuple]] | None = None) -> Column:
    """array<struct> of the given shape: what ``of`` reads in the lines of each document's pages, or ``of_other`` where ``other`` is true."""
    names, kinds = list(shape), [ARROW[kind] for kind in shape.values()]

    def steps(documents: pa.Array, others: pa.Array) -> Iterator[pa.Array]:
        for at in range(0, len(documents), STEP_DOCUMENTS):
            some = documents.slice(at, STEP_DOCUMENTS)
            number, text = (x.to_pylist() for x in some.flatten().flatten())
            rows, ends, first = [], [0], 0
            for n, is_other in zip(some.value_lengths().to_pylist(), others.slice(at, STEP_DOCUMENTS).to_pylist(), strict=True):
                rows += (of_other if is_other else of)(lines_of(zip(number[first : first + n], text[first : first + n], strict=True)))
                ends.append(len(rows))
                first += n
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names))

    @F.arrow_udf(f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in shape.items())}>>")
    def found(documents: pa.Array, others: pa.Array) -> pa.Array:
        return pa.concat_arrays(list(steps(documents, others)) or [pa.array([], pa.list_(pa.struct(list(zip(names, kinds, strict=True)))))])

    return found(pages, F.lit(False) if other is None else other)
