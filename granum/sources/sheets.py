"""Workbooks in the Office Open XML format, read and written on the driver.

A sheet holds 1,048,576 rows at most, which bounds what is read or collected.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granum import storage

# Name spaces and limits of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
ROWS, CELL, NAME = 1_048_576, 32_000, 31
WIDEST = 60


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_MAIN}}}t"))


def _rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list]:
    for _, row in ET.iterparse(book.open(part)):
        if row.tag != f"{{{_MAIN}}}row":
            continue
        values: dict[int, object] = {}
        for i, c in enumerate(row):
            kind, v = c.get("t", "n"), c.find(f"{{{_MAIN}}}v")
            raw = v.text if v is not None else None
            at = _column(c.get("r")) if c.get("r") else i
            if kind == "inlineStr":
                values[at] = _texts(c)
            elif raw is not None:
                values[at] = shared[int(raw)] if kind == "s" else (raw == "1") if kind == "b" else float(raw) if kind == "n" else raw
        yield [values.get(i) for i in range(max(values, default=-1) + 1)]
        row.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet (the first, if none is named) with its first row as column names; all cells as text.

    Whole numbers lose their ``.0``; empty cells are null; an absent sheet is an error.
    """
    content = spark.read.format("binaryFile").load(path).select("content").first()
    if content is None:
        raise FileNotFoundError(path)
    with zipfile.ZipFile(io.BytesIO(bytes(content[0]))) as book:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        names = {s.get("name"): rels[s.get(f"{{{_REL}}}id")] for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")}
        target = names[sheet] if sheet is not None else next(iter(names.values()))
        shared = [_texts(s) for s in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        rows = _rows(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}", shared)
        header = [str(h) for h in next(rows, [])]
        show = lambda v: v if v is None or isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v:.15g}"
        data = [tuple(show(v) for v in (r + [None] * len(header))[: len(header)]) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{h}` string" for h in header))


def _sheet_xml(df: DataFrame) -> str:
    cut = df.select(*[F.substring(c, 1, CELL).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    rows = cut.limit(ROWS).collect()
    if len(rows) >= ROWS:
        raise ValueError(f"a sheet holds {ROWS - 1} rows below its header")
    widths = [min(WIDEST, max([len(c), *(len(str(r[i])) for r in rows[:200] if r[i] is not None)]) + 2) for i, c in enumerate(df.columns)]
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))

    def cell(v: object, at: str) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    lines = [df.columns, *rows]
    body = "".join(f'<row r="{n}">{"".join(cell(v, f"{_letters(i)}{n}") for i, v in enumerate(line))}</row>' for n, line in enumerate(lines, 1))
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}">{view}<cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>' if df.columns else f'<worksheet xmlns="{_MAIN}"><sheetData/></worksheet>'


def write_workbook(sheets: dict[str, DataFrame], path: str, dictionary: bool = True) -> None:
    """One workbook with a sheet for each frame: fitted widths, frozen header, texts cut to what a cell holds.

    ``dictionary`` adds a sheet that lists every column and its type.
    """
    any_df = next(iter(sheets.values()))
    spark = any_df.sparkSession
    if dictionary:
        rows = [(n, c, t) for n, df in sheets.items() for c, t in df.dtypes]
        sheets = sheets | {"dictionary": spark.createDataFrame(rows, "sheet string, column_name string, type string")}
    n = range(1, len(sheets) + 1)
    names = [re.sub(r"[\[\]:*?/\\]", "_", s)[:NAME] for s in sheets]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        book.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, s in zip(n, names, strict=True)) + "</sheets></workbook>")
        for i, df in zip(n, sheets.values(), strict=True):
            book.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(df))
    fs, p = storage.hadoop_path(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
