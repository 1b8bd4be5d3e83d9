"""Spreadsheets (.xlsx) as a Spark data source: every column text, rows dealt to tasks by ranges.

    spark.dataSource.register(xlsx.Spreadsheet)
    spark.read.format("xlsx").option("sheet", "Year 2010-2011").load("/data/lines.xlsx")

Options: path (a file, or a folder of them with one header), sheet (name or place from 0;
the first), header (true), rowsPerPartition (50000). The driver reads the header row and
the sheet's stated size only. Each task streams its part of the sheet: rows before its
range are passed over without being parsed, and the last task reads to the end whatever
the stated size is. Paths are opened by pyarrow, so any store that it knows will do.

Cells as text: whole numbers without decimals, other numbers as the shortest decimal of
their double, dates (by the cell's number format) as ISO date and time, booleans TRUE and
FALSE; empty cells, errors and missing cells are null. Rows without cells are left out.
A row with more cells than the header keeps those under it. Text in CDATA sections isn't
looked for.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import IO, NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

BLOCK = 1 << 20
ROWS_AT_ONCE = 2000
# Number formats of the file format that are dates or times, and the two first days.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
FIRST_DAY, FIRST_DAY_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)

_ROW = re.compile(rb"<((?:\w+:)?row)(?=[\s>/])(?:[^>]*/>|.*?</\1>)", re.DOTALL)
_ROOT = re.compile(rb"<((?:\w+:)?worksheet)[^>]*>")
_SIZE = re.compile(rb"<(?:\w+:)?dimension[^>]*\bref=\"(?:[A-Z]+\d+:)?[A-Z]+(\d+)\"")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_NO_DATE = re.compile(r"\"[^\"]*\"|\[[^\]]*\]|\\.|_.|\*.")


def opened(path: str) -> tuple[pa.NativeFile, str]:
    filesystem, inner = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return filesystem.open_input_file(inner), inner


def files(path: str) -> list[str]:
    """The file itself, or the .xlsx files of a folder in order of name."""
    filesystem, inner = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    if filesystem.get_file_info(inner).type == pa.fs.FileType.File:
        return [path]
    found = sorted(f.base_name for f in filesystem.get_file_info(pa.fs.FileSelector(inner)) if f.base_name.endswith(".xlsx") and not f.base_name.startswith("~$"))
    if not found:
        raise FileNotFoundError(f"no .xlsx file at {path}")
    return [f"{path.rstrip('/')}/{name}" for name in found]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _said(element: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic notes."""
    parts = [t.text or "" for t in element if _local(t.tag) == "t"]
    parts += [t.text or "" for r in element if _local(r.tag) == "r" for t in r if _local(t.tag) == "t"]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def column_of(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def is_date_format(code: str) -> bool:
    return bool(re.search("[ymdhs]", _NO_DATE.sub("", code).lower().replace("general", "")))


class Cells(NamedTuple):
    """What turns a cell into text: shared strings, styles that are dates, and day 0."""

    strings: list[str]
    dates: frozenset[int]
    first_day: datetime

    def text(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return next((_said(x) for x in cell if _local(x.tag) == "is"), None)
        value = next((x.text for x in cell if _local(x.tag) == "v"), None)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            return "TRUE" if value.strip() == "1" else "FALSE"
        if kind in ("str", "d"):
            return value
        number = float(value)
        if int(cell.get("s", "0")) in self.dates:
            at = self.first_day + timedelta(milliseconds=round(number * 86_400_000))
            return at.isoformat(sep=" ", timespec="milliseconds" if at.microsecond else "seconds")
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


class Book:
    """One open spreadsheet file."""

    def __init__(self, path: str):
        self.handle, _ = opened(path)
        self.zip = zipfile.ZipFile(self.handle)

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.handle.close()

    def tree(self, part: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.zip.read(part)) if part in self.zip.namelist() else None

    def sheet_part(self, sheet: str | None) -> str:
        book = self.tree("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self.tree("xl/_rels/workbook.xml.rels")}
        sheets = [(s.get("name"), next(v for k, v in s.attrib.items() if _local(k) == "id")) for s in book.iter() if _local(s.tag) == "sheet"]
        names = [name for name, _ in sheets]
        place = names.index(sheet) if sheet in names else int(sheet or 0) if (sheet or "0").isdigit() else len(names)
        if place >= len(sheets):
            raise ValueError(f"no sheet {sheet!r}; there are: {', '.join(map(str, names))}")
        target = links[sheets[place][1]]
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def cells(self, most_strings: int | None = None) -> Cells:
        """most_strings: how many shared strings are enough."""
        strings = []
        if "xl/sharedStrings.xml" in self.zip.namelist() and most_strings != 0:
            with self.zip.open("xl/sharedStrings.xml") as part:
                for _, element in ElementTree.iterparse(part):
                    if _local(element.tag) == "si":
                        strings.append(_said(element))
                        element.clear()
                        if most_strings and len(strings) >= most_strings:
                            break
        dates, styles = set(), self.tree("xl/styles.xml")
        if styles is not None:
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if _local(f.tag) == "numFmt"}
            formats = [int(x.get("numFmtId", "0")) for xfs in styles if _local(xfs.tag) == "cellXfs" for x in xfs]
            dates = {i for i, f in enumerate(formats) if (is_date_format(own[f]) if f in own else f in DATE_FORMATS)}
        since_1904 = any(_local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in self.tree("xl/workbook.xml").iter())
        return Cells(strings, frozenset(dates), FIRST_DAY_1904 if since_1904 else FIRST_DAY)

    def stated_rows(self, part: str) -> int:
        with self.zip.open(part) as sheet:
            found = _SIZE.search(sheet.read(BLOCK))
        return int(found[1]) if found else 0

    def rows(self, part: str, first: int, last: int | None) -> Iterator[list[ElementTree.Element]]:
        """Rows first to last - 1 by their order in the sheet (last None: to the end), some at once."""
        with self.zip.open(part) as sheet:
            head, held, seen = b"", [], 0
            for row in _row_bytes(sheet):
                if isinstance(row, tuple):
                    head = row[0]
                    continue
                if last is not None and seen >= last:
                    break
                if seen >= first:
                    held.append(row)
                    if len(held) == ROWS_AT_ONCE:
                        yield _parsed(head, held)
                        held = []
                seen += 1
            if held:
                yield _parsed(head, held)


def _row_bytes(sheet: IO[bytes]) -> Iterator[bytes | tuple[bytes]]:
    """The sheet's start tag in a tuple, then each row element's bytes."""
    rest, started = b"", False
    while block := sheet.read(BLOCK):
        rest += block
        if not started:
            if not (root := _ROOT.search(rest)):
                continue
            started, rest = True, rest[root.end() :]
            yield (root[0],)
        end = 0
        for m in _ROW.finditer(rest):
            yield m[0]
            end = m.end()
        # What precedes the first open row can't become part of one, but for a tag that is itself cut off.
        rest = rest[end:]


def _parsed(head: bytes, rows: list[bytes]) -> list[ElementTree.Element]:
    name = _ROOT.match(head)[1]
    return list(ElementTree.fromstring(head + b"".join(rows) + b"</" + name + b">"))


def _texts(row: ElementTree.Element, cells: Cells, width: int) -> list[str | None]:
    out: list[str | None] = [None] * width
    at = -1
    for cell in row:
        at = column_of(cell.get("r")) if cell.get("r") else at + 1
        if at < width:
            out[at] = cells.text(cell)
    return out


def header(path: str, sheet: str | None, named: bool) -> list[str]:
    """Column names of the first row; without a header _c0, _c1 and so on."""
    with Book(path) as book:
        part = book.sheet_part(sheet)
        first = next(iter(next(book.rows(part, 0, 1), [])), None)
        if first is None:
            return []
        width = max((column_of(c.get("r")) if c.get("r") else i for i, c in enumerate(first)), default=-1) + 1
        if not named:
            return [f"_c{i}" for i in range(width)]
        wanted = [int(v.text) for c in first if c.get("t") == "s" for v in c if _local(v.tag) == "v"]
        names = _texts(first, book.cells(max(wanted, default=-1) + 1), width)
        return [n if n is not None else f"_c{i}" for i, n in enumerate(names)]


class Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int | None):
        self.path, self.first, self.last = path, first, last


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.width, self.names = len(schema.fields), [f.name for f in schema.fields]
        self.path, self.sheet = options["path"], options.get("sheet")
        self.named, self.size = options.get("header", "true").lower() == "true", int(options.get("rowsPerPartition", "50000"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files(self.path):
            if (found := header(path, self.sheet, self.named)) != self.names and found:
                raise ValueError(f"{path} has the columns {found}, not {self.names}")
            with Book(path) as book:
                stated = book.stated_rows(book.sheet_part(self.sheet))
            starts = list(range(int(self.named), max(stated, 2), self.size))
            out += [Rows(path, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with Book(partition.path) as book:
            part, cells = book.sheet_part(self.sheet), book.cells()
            for rows in book.rows(part, partition.first, partition.last):
                texts = [_texts(r, cells, self.width) for r in rows if len(r)]
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*texts, strict=True)], names=self.names)


class Spreadsheet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        path = files(self.options["path"])[0]
        names = header(path, self.options.get("sheet"), self.options.get("header", "true").lower() == "true")
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)
