"""Workbooks (.xlsx) as a Spark data source: one row for each cell of each file's first sheet.

``spark.read.format("workbook").load(folder)`` lists the files on the driver, deals them out in
groups of about :data:`GROUP_BYTES`, and tasks open one file at a time.  A file is a zip of XML
parts; the sheet is read as a stream, so a task holds the shared strings and one row.  Values are
read and formulas are not.  A sheet is read up to :data:`MOST_ROWS` rows and
:data:`MOST_COLS` columns, and says so when it has more.  A file that cannot be read gives one
row with a reason and no cell.

The folder must be one that tasks can open as files; :func:`cells` reads the same from a column
of bytes, wherever Spark can read these (``binaryFile``).
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

#: Rows and columns that are read of a sheet, and characters of a cell.
MOST_ROWS, MOST_COLS = 5_000, 64
#: Bytes of one part of a workbook that a task unpacks, so that a small zip cannot fill its memory.
MOST_PART_BYTES = 64 << 20
GROUP_BYTES = 32 << 20
#: Cells that a task hands on at once.
STEP_CELLS = 10_000

CELL = "row int, col int, value string, kind string, truncated boolean, reason string"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PLACE = re.compile(r"([A-Z]{1,3})([0-9]{1,7})")

Cell = tuple[int | None, int | None, str | None, str | None, bool, str | None]


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def part(book: zipfile.ZipFile, name: str) -> io.BufferedIOBase:
    if book.getinfo(name).file_size > MOST_PART_BYTES:
        raise ValueError("part too large")
    return book.open(name)


def texts_in(element: ElementTree.Element) -> str:
    """A string's runs, end to end; how it is pronounced is not part of it."""
    return "".join(t.text or "" for t in element.findall(f"{SHEET}t")) + "".join(t.text or "" for run in element.findall(f"{SHEET}r") for t in run.findall(f"{SHEET}t"))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, element in ElementTree.iterparse(part(book, "xl/sharedStrings.xml")):
        if element.tag == f"{SHEET}si":
            out.append(texts_in(element))
            element.clear()
    return out


def first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the first sheet of the workbook's list."""
    sheet = ElementTree.parse(part(book, "xl/workbook.xml")).getroot().find(f"{SHEET}sheets/{SHEET}sheet")
    if sheet is None:
        raise ValueError("no sheet")
    links = ElementTree.parse(part(book, "xl/_rels/workbook.xml.rels")).getroot()
    target = next(x.get("Target") for x in links if x.get("Id") == sheet.get(f"{LINK}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def shown(element: ElementTree.Element, strings: list[str]) -> tuple[str | None, str | None]:
    """(value, kind) of a cell: number, text or bool; errors and cells without a value have none."""
    kind = element.get("t", "n")
    if kind == "inlineStr":
        inner = element.find(f"{SHEET}is")
        return (texts_in(inner), "text") if inner is not None else (None, None)
    value = element.findtext(f"{SHEET}v")
    if value is None or kind == "e":
        return None, None
    if kind == "s":
        return strings[int(value)], "text"
    return {"b": ("true" if value == "1" else "false", "bool"), "str": (value, "text")}.get(kind, (value, "number"))


def sheet_cells(book: zipfile.ZipFile) -> Iterator[Cell]:
    strings = shared_strings(book)
    row = col = 0
    found, wider = [], False
    stack: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(part(book, first_sheet(book)), events=("start", "end")):
        if event == "start":
            stack.append(element)
            if element.tag == f"{SHEET}row":
                row, col = int(element.get("r") or row + 1), 0
            continue
        stack.pop()
        if element.tag == f"{SHEET}c":
            place = PLACE.fullmatch(element.get("r") or "")
            col = column_number(place[1]) if place else col + 1
            value, kind = shown(element, strings)
            if value is not None and value != "":
                if row > MOST_ROWS or col > MOST_COLS:
                    wider = True
                else:
                    found.append((row, col, value, kind))
            element.clear()
        elif element.tag == f"{SHEET}row":
            element.clear()
            if row > MOST_ROWS and wider:
                break
    for x in found:
        yield *x, wider, None


def workbook_cells(content: bytes) -> Iterator[Cell]:
    """The cells of a workbook's first sheet, or one row with why there are none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            cells = list(sheet_cells(book))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, StopIteration, ValueError, NotImplementedError, EOFError, OSError, RuntimeError) as problem:
        yield None, None, None, None, False, reason_of(problem)
        return
    yield from cells or [(None, None, None, None, False, "empty sheet")]


def reason_of(problem: Exception) -> str:
    if isinstance(problem, zipfile.BadZipFile):
        return "not a workbook"
    if isinstance(problem, ValueError) and str(problem) in ("part too large", "no sheet"):
        return str(problem)
    return "broken workbook"


def cell_type() -> StructType:
    kinds = {"int": IntegerType(), "string": StringType(), "boolean": BooleanType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in (x.split() for x in CELL.split(", "))])


def cells(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, row, col, value, kind, truncated, reason) of the workbooks in files (key, content); null content is not a workbook."""
    names = [key, *(x.split()[0] for x in CELL.split(", "))]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = workbook_cells(batch.column(1)[i].as_py() or b"")
                while part := list(islice(found, STEP_CELLS)):
                    own = batch.column(0).take(pa.array([i] * len(part)))
                    columns = [pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([own, *columns], names)

    return files.select(key, "content").mapInArrow(read, StructType([files.schema[key], *cell_type().fields]))


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class WorkbookReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder.removeprefix("file://")

    def partitions(self) -> list[Files]:
        groups, size = [[]], 0
        for base, _, names in sorted(os.walk(self.folder)):
            for name in sorted(names):
                if name.endswith(".xlsx") and not name.startswith(("~$", ".")):
                    path = os.path.join(base, name)
                    own = os.path.getsize(path)
                    if groups[-1] and size + own > GROUP_BYTES:
                        groups.append([])
                        size = 0
                    groups[-1].append(path)
                    size += own
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as file:
                content = file.read()
            for cell in workbook_cells(content):
                yield path, *cell


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(folder)``, once :func:`register` has been called."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return f"path string, {CELL}"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


#: Fixed value: the date that every part of a made workbook has.
PART_DATE = (1980, 1, 1, 0, 0, 0)
WORKBOOK = f'<workbook xmlns="{SHEET[1:-1]}" xmlns:r="{LINK[1:-1]}"><sheets><sheet name="BOQ" sheetId="1" r:id="rId1"/></sheets></workbook>'
RELATIONS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'


def column_name(col: int) -> str:
    name = ""
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return name


def workbook_bytes(rows: list[tuple[int, int, str, str]]) -> bytes:
    """A workbook of (row, col, value, kind), the same bytes for the same cells: texts are shared, parts have one date and one order."""
    escaped = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    strings = {v: i for i, v in enumerate(sorted({v for _, _, v, k in rows if k == "text"}))}
    lines: dict[int, list[str]] = {}
    for row, col, value, kind in sorted(rows):
        inner, mark = {"text": (strings.get(value), ' t="s"'), "bool": (int(value == "true"), ' t="b"')}.get(kind, (escaped(value), ""))
        lines.setdefault(row, []).append(f'<c r="{column_name(col)}{row}"{mark}><v>{inner}</v></c>')
    body = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in sorted(lines.items()))
    shared = "".join(f'<si><t xml:space="preserve">{escaped(v)}</t></si>' for v in strings)
    parts = {
        "xl/workbook.xml": WORKBOOK, "xl/_rels/workbook.xml.rels": RELATIONS,
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEET[1:-1]}">{shared}</sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(zipfile.ZipInfo(name, PART_DATE), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def made(rows: DataFrame, key: str) -> DataFrame:
    """(key, content): a workbook for each key of rows (key, row, col, value, kind)."""

    def books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        one = lambda: pa.RecordBatch.from_arrays([pa.array([own[0][0]], kind), pa.array([workbook_bytes([x[1:] for x in own])], pa.binary())], [key, "content"])
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for *row, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and place == 1:
                    yield one()
                    own = []
                own.append(tuple(row))
        if own:
            yield one()

    # A task holds one workbook at a time.  The window makes Spark keep a key in one task; a repartition does not, as it is left out
    # over a union whose sides are dealt by key, and each side's parts are then put together by its own sizes.
    order = ["row", "col", "value", "kind"]
    listed = rows.select(key, *order, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("_place"))
    return listed.mapInArrow(books, StructType([rows.schema[key], StructField("content", BinaryType())]))


def window(found: DataFrame, key: str, around: DataFrame, radius: int = 12, columns: int = 26) -> DataFrame:
    """(key, row, col, value, more): the cells within so many rows of the row that around (key, at) names; more says whether the sheet goes on beyond them."""
    near = found.join(around, key)
    inside = (F.abs(F.col("row") - F.col("at")) <= radius) & (F.col("col") <= columns)
    # one reading of the sheets: what is kept of each is bounded by the window
    kept = near.groupBy(key).agg(F.collect_list(F.when(inside, F.struct("row", "col", "value"))).alias("cells"), F.bool_or(~inside).alias("more"))
    return kept.select(key, F.explode("cells").alias("c"), "more").select(key, "c.*", "more")
