"""Workbook (.xlsx) uploads.

No Spark source reads workbooks, so Spark reads the files (``binaryFile``, any store) and
Python tasks parse them with stdlib ``zipfile`` and ``xml.etree``, one file per record:
the first sheet, row by row as it streams out of the archive, every value as text.
Many files are read in parallel; the output has the same shape as the CSV cell reader,
so header mapping and field building are shared.

Texts are what the usual Python reader gives: a cell with a date format as
``YYYY-MM-DD HH:MM:SS`` (a time alone as ``HH:MM:SS``), whole numbers without a point,
errors as missing. Rows that the sheet leaves out are empty rows, but for those after the
last value. A file that cannot be parsed, or holds no row, is refused alone.
Legacy ``.xls`` has no available reader and is refused.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import sys
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipfold.sources.csv import NA_TOKENS

# The parse functions run in Python workers. Pickle this module by value so
# executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pickler: the package must be on the workers
    pass

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")
# FIXED VALUES: the format's built-in number formats that show dates and times,
# and the one that shows elapsed time.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)])
_ELAPSED_FORMATS = frozenset([46])
# Parts of a format code that show no value: quoted text, escapes, fill, colours and conditions.
_NO_VALUE = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)
#: Rows handed back at a time, and why a file is refused.
CHUNK_ROWS = 5000
UNREADABLE = "not a readable workbook"
NO_ROWS = "no row in the first sheet"


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _first_sheet_path(z: zipfile.ZipFile, workbook) -> str:
    sheet = workbook.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{_NS['r']}}}id")
    for rel in _xml(z, "xl/_rels/workbook.xml.rels").findall("pr:Relationship", _NS):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


def _text(node) -> str:
    """A string item's own text and its runs', without phonetic guides."""
    own = [t.text or "" for t in node.findall("m:t", _NS)]
    return "".join(own + [t.text or "" for t in node.findall("m:r/m:t", _NS)])


def format_kind(code: str) -> str:
    """What a number format's first section shows: "date", "elapsed" or "number"."""
    code = _NO_VALUE.sub("", code).split(";")[0].lower()
    if re.search(r"\[[hms]+\]", code):
        return "elapsed"
    return "date" if re.search("[ymdhs]", code) and "general" not in code else "number"


def _style_kinds(styles) -> list[str]:
    """Per cell style: what its number format shows."""
    if styles is None:
        return []
    own = {f.get("numFmtId"): format_kind(f.get("formatCode") or "") for f in styles.findall("m:numFmts/m:numFmt", _NS)}

    def kind(number: str) -> str:
        if number in own:
            return own[number]
        n = int(number or 0)
        return "date" if n in _DATE_FORMATS else "elapsed" if n in _ELAPSED_FORMATS else "number"

    return [kind(x.get("numFmtId") or "0") for x in styles.findall("m:cellXfs/m:xf", _NS)]


def number_text(text: str, kind: str, from_1904: bool) -> str | None:
    """A number cell as text, by what its format shows."""
    value = float(text)
    if kind == "number" or value != value:
        return str(int(value)) if value == int(value) else repr(value)
    time = dt.timedelta(milliseconds=round(value % 1 * 86_400_000))
    if kind == "elapsed":
        return str(dt.timedelta(days=value // 1) + time)
    if 0 <= value < 1 and not time.days:
        return str((dt.datetime.min + time).time())
    # Day 60 of the 1900 system is a day that never was; days before it count from one later.
    first = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 31 if value < 60 else 30)
    try:
        return str(first + dt.timedelta(days=value // 1) + time)
    except OverflowError:  # no such date: the number stays one
        return number_text(text, "number", from_1904)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as lists of text (None for empty cells), one after another."""
    z = zipfile.ZipFile(io.BytesIO(content))
    workbook, strings = _xml(z, "xl/workbook.xml"), _xml(z, "xl/sharedStrings.xml")
    shared = [] if strings is None else [_text(si) for si in strings.findall("m:si", _NS)]
    kinds = _style_kinds(_xml(z, "xl/styles.xml"))
    properties = workbook.find("m:workbookPr", _NS)
    from_1904 = properties is not None and properties.get("date1904") in ("1", "true")

    def value(c) -> str | None:
        kind, v = c.get("t"), c.find("m:v", _NS)
        if kind == "inlineStr":
            inline = c.find("m:is", _NS)
            return None if inline is None else _text(inline)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind == "str":
            return v.text
        if kind == "d":
            return str(dt.datetime.fromisoformat(v.text))
        style = int(c.get("s") or 0)
        return number_text(v.text, kinds[style] if style < len(kinds) else "number", from_1904)

    at, empty = 0, 0
    with z.open(_first_sheet_path(z, workbook)) as stream:
        for _, node in ET.iterparse(stream):
            if node.tag != _MAIN + "row":
                continue
            number = int(node.get("r") or at + 1)
            empty += max(0, number - at - 1)
            at, vals = number, {}
            for c in node.findall("m:c", _NS):
                m = _REF.match(c.get("r") or "")
                vals[_col_index(m.group(1)) if m else max(vals, default=-1) + 1] = value(c)
            node.clear()
            if not any(v is not None for v in vals.values()):
                empty += 1
                continue
            for _ in range(empty):
                yield []
            empty = 0
            yield [vals.get(i) for i in range(max(vals) + 1)]


def file_rows(content: bytes) -> Iterator[tuple[list[str | None], str | None]]:
    """(row, None) of each row; for a file that is refused, its last is an empty row and the reason."""
    found = False
    try:
        for row in sheet_rows(content):
            found = True
            yield row, None
    except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, AttributeError, EOFError, NotImplementedError,
            RuntimeError, zlib.error):
        yield [], UNREADABLE
        return
    if not found:
        yield [], NO_ROWS


def read_workbook_cells(spark: SparkSession, paths) -> DataFrame:
    """Cells of ``.xlsx`` files: ``file_path, file_index, line_no, cells, raw_cells`` (same
    shape as ``read_csv_cells``; rows keep their own width) and ``unreadable``, the reason on
    one row of a file that is refused."""
    for p in paths if isinstance(paths, (list, tuple)) else [paths]:
        if not str(p).endswith(".xlsx"):
            raise ValueError(f"only .xlsx workbooks can be read: {p}")
    files = spark.read.format("binaryFile").load(paths).select(
        F.col("path").alias("file_path"), "content")
    columns = ["file_path", "line_no", "cells", "raw_cells", "unreadable"]

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["file_path"], pdf["content"]):
                out = []
                for line_no, (row, refused) in enumerate(file_rows(bytes(content))):
                    raw = ["" if v is None else v for v in row]
                    cells = [None if (v is None or v in NA_TOKENS) else v for v in row]
                    out.append((path, line_no, cells, raw, refused))
                    if len(out) == CHUNK_ROWS:
                        yield pd.DataFrame.from_records(out, columns=columns)
                        out = []
                yield pd.DataFrame.from_records(out, columns=columns)

    cells = files.mapInPandas(parse, "file_path string, line_no long, cells array<string>, "
                                     "raw_cells array<string>, unreadable string")
    order = files.select("file_path").withColumn(
        "file_index", F.dense_rank().over(Window.orderBy("file_path")) - 1)
    return cells.join(order, "file_path")
