"""The spreadsheet source against the CSV reader, and the corners of the format."""

import csv
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest

from basketry import sources
from basketry.operators import clean
from basketry.sources import RAW_COLUMNS, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(i):
    return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def write_book(path, rows, shared=True, size=True, prefix="", date1904=False, names=("Lines",)):
    """A workbook of one sheet: texts, numbers, (datetime, style 1), booleans, None for a missing cell."""
    strings, p = {}, f"{prefix}:" if prefix else ""
    first = datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 30)

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<{p}c r="{ref}" t="b"><{p}v>{int(v)}</{p}v></{p}c>'
        if isinstance(v, datetime):
            return f'<{p}c r="{ref}" s="1"><{p}v>{(v - first).total_seconds() / 86400!r}</{p}v></{p}c>'
        if isinstance(v, (int, float)):
            return f'<{p}c r="{ref}"><{p}v>{v!r}</{p}v></{p}c>'
        if v == "#N/A":
            return f'<{p}c r="{ref}" t="e"><{p}v>#N/A</{p}v></{p}c>'
        if shared:
            return f'<{p}c r="{ref}" t="s"><{p}v>{strings.setdefault(v, len(strings))}</{p}v></{p}c>'
        return f'<{p}c r="{ref}" t="inlineStr"><{p}is><{p}t xml:space="preserve">{escape(v)}</{p}t></{p}is></{p}c>'

    lines = [f'<{p}row r="{i}" x14ac:dyDescent="0.25">' + "".join(cell(f"{letters(j)}{i}", v) for j, v in enumerate(r)) + f"</{p}row>" if r else f'<{p}row r="{i}"/>' for i, r in enumerate(rows, 1)]
    wide = max(map(len, rows), default=1)
    ns = MAIN.replace("xmlns=", f"xmlns:{prefix}=") if prefix else MAIN
    sheet = f'<?xml version="1.0"?><{p}worksheet {ns} xmlns:x14ac="urn:x14ac">' + (f'<{p}dimension ref="A1:{letters(wide - 1)}{size if size is not True else len(rows)}"/>' if size else "") + f'<{p}sheetData>' + "".join(lines) + f"</{p}sheetData></{p}worksheet>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i in range(1, len(names) + 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet if i == 1 else f'<worksheet {MAIN}><sheetData><row><c t="inlineStr"><is><t>only</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy\\ hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t xml:space='preserve'>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" for s in strings) + "</sst>")


def lines(n=230):
    return [
        (f"C{i}" if i % 11 == 0 else 536000 + i, "POST" if i % 13 == 0 else f"{10000 + i % 40}", None if i % 9 == 0 else f"cup & <saucer> é {i % 6}", -2 if i % 17 == 0 else i % 5 + 1, datetime(2010, 12, 1 + i % 25, i % 24, i % 60), 1.1 * (i % 7), None if i % 8 == 0 else 17850.0 + i % 5, "United Kingdom")
        for i in range(n)
    ]


def read(spark, path, **options):
    spark.dataSource.register(xlsx.Spreadsheet)
    return spark.read.format("xlsx").options(**options).load(str(path))


@pytest.mark.parametrize("shared,size,prefix", [(True, True, ""), (False, False, ""), (True, 40, "x"), (True, 9999, "")])
def test_lines_equal_those_of_the_csv(spark, tmp_path, shared, size, prefix):
    data = lines()
    write_book(tmp_path / "lines.xlsx", [RAW_COLUMNS, *data], shared, size, prefix)
    with open(tmp_path / "lines.csv", "w", newline="") as f:
        csv.writer(f).writerows([RAW_COLUMNS, *data])
    sheet, plain = sources.read_invoice_sheet(spark, str(tmp_path / "lines.xlsx"), rows_per_task=50), sources.read_invoice_csv(spark, str(tmp_path / "lines.csv"))
    assert {t for _, t in sheet.dtypes} == {"string"}
    if size is True:
        assert sheet.rdd.getNumPartitions() == 5
    kept = lambda raw: sorted(map(str, clean.classified(raw).drop("copies").collect()))
    assert sheet.count() == len(data) and kept(sheet) == kept(plain)
    assert sorted(map(str, sheet.select("InvoiceNo", "Description", "InvoiceDate").collect())) == sorted(map(str, plain.select("InvoiceNo", "Description", "InvoiceDate").collect()))


def test_cells(spark, tmp_path):
    row = ["a_x000D_b", 3, 2.5499999999999998, 1e20, True, datetime(2011, 3, 1), datetime(2011, 3, 1, 12, 30, 15, 250000), "#N/A", None, " sp ", ""]
    names = [f"h{i}" for i in range(len(row))]
    for date1904 in (False, True):
        write_book(tmp_path / f"{date1904}.xlsx", [names, row, [], [None, 7], [*row, "beyond"]], date1904=date1904)
        got = [tuple(r) for r in read(spark, tmp_path / f"{date1904}.xlsx").collect()]
        want = ("a\rb", "3", "2.55", "1e+20", "TRUE", "2011-03-01 00:00:00", "2011-03-01 12:30:15.250", None, None, " sp ", "")
        assert got == [want, (None, "7", *[None] * 9), want]


def test_folders_sheets_and_headers(spark, tmp_path):
    for i in range(3):
        write_book(tmp_path / f"{i}.xlsx", [["a", "b"], [i, "x"], [10 + i, "y"]], names=("First", "Second"))
    assert sorted(r.a for r in read(spark, tmp_path, rowsPerPartition="1").collect()) == ["0", "1", "10", "11", "12", "2"]
    assert read(spark, tmp_path / "0.xlsx", sheet="Second", header="false").collect()[0]["_c0"] == "only"
    assert read(spark, tmp_path / "0.xlsx", sheet="1").columns == ["only"]
    assert read(spark, f"file://{tmp_path}/1.xlsx", header="false").count() == 3
    with pytest.raises(Exception, match="First, Second"):
        read(spark, tmp_path / "0.xlsx", sheet="Third").count()
    write_book(tmp_path / "9.xlsx", [["a", "other"], [1, "x"]])
    with pytest.raises(Exception, match="other"):
        read(spark, tmp_path).count()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no .xlsx"):
        read(spark, tmp_path / "none").count()


def test_header_alone_and_missing_columns(spark, tmp_path):
    write_book(tmp_path / "head.xlsx", [RAW_COLUMNS])
    assert sources.raw_lines(spark, str(tmp_path / "head.xlsx")).count() == 0
    write_book(tmp_path / "few.xlsx", [RAW_COLUMNS[:5], ["1"] * 5])
    with pytest.raises(ValueError, match="Country"):
        sources.read_invoice_sheet(spark, str(tmp_path / "few.xlsx"))


def test_rows_across_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx, "BLOCK", 64)
    write_book(tmp_path / "b.xlsx", [["a", "b"], *([i, "long text " * 9] for i in range(30))])
    with xlsx.Book(str(tmp_path / "b.xlsx")) as book:
        part = book.sheet_part(None)
        assert sum(len(x) for x in book.rows(part, 1, None)) == 30
        assert [len(x) for x in book.rows(part, 28, 31)] == [3]


@pytest.mark.parametrize("code,date", [("General", False), ("0.00", False), ("yyyy-mm-dd", True), ("[h]:mm", True), ('0 "days"', False), ("[Red]0", False), ("d\\-mmm", True), ("_(* #,##0_)", False)])
def test_date_formats(code, date):
    assert xlsx.is_date_format(code) is date
    assert [xlsx.column_of(x) for x in ("A1", "Z9", "AA7", "BC12")] == [0, 25, 26, 54]
