"""Spreadsheets in the Office Open XML format, read and written at the boundary with nothing but the standard library.

Workbooks are files of one machine's size by their format (MOST_ROWS rows a
sheet); they pass through the driver, and larger tables are refused.
"""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: rows of a sheet, and the name spaces of its parts.
MOST_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_NAMES = {"m": _MAIN, "p": f"{_PACKAGE}/relationships"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_names(path: str) -> list[str]:
    """The names of a workbook's sheets, in order."""
    with zipfile.ZipFile(path) as z:
        return [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NAMES)]


def _rows(path: str, sheet: str | int):
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml")).findall(".//m:sheet", _NAMES)
        one = book[sheet] if isinstance(sheet, int) else next((s for s in book if s.get("name") == sheet), None)
        if one is None:
            raise ValueError(f"{path} has no sheet {sheet!r}")
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iterfind("p:Relationship", _NAMES)}
        texts = []
        if "xl/sharedStrings.xml" in z.namelist():
            texts = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NAMES)) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NAMES)]
        target = targets[one.get(f"{{{_REL}}}id")]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{{{_MAIN}}}row":
                    continue
                out: dict[int, str] = {}
                for i, c in enumerate(row.iterfind("m:c", _NAMES)):
                    kind, v = c.get("t"), c.findtext("m:v", None, _NAMES)
                    if kind == "inlineStr":
                        v = "".join(t.text or "" for t in c.iterfind(".//m:t", _NAMES))
                    elif kind == "s" and v is not None:
                        v = texts[int(v)]
                    out[_column(c.get("r")) if c.get("r") else i] = v
                yield out
                row.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, columns: list[str] | None = None, pinned: dict[str, str] | None = None) -> DataFrame:
    """A sheet whose first row has the names; every column is text unless pinned to a type. `columns` picks some of them."""
    rows = _rows(path, sheet)
    head = next(rows, {})
    names = {i: n for i, n in sorted(head.items()) if n}
    wanted = [(i, n) for i, n in names.items() if columns is None or n in columns]
    lost = [c for c in columns or [] if c not in names.values()]
    if lost:
        raise ValueError(f"{path}: sheet {sheet!r} has no columns {lost}")
    data = [tuple(r.get(i) for i, _ in wanted) for r in rows]
    df = spark.createDataFrame(data, ", ".join(f"`{n}` string" for _, n in wanted))
    return df.withColumns({c: df[c].cast(k) for c, k in (pinned or {}).items()})


def _cell(at: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f'<c r="{at}"><v>{v!r}</v></c>'
    plain = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'


def write_sheets(tables: dict[str, DataFrame], path: str) -> None:
    """A workbook with one sheet for each table, its names in the first row. A table that a sheet can't hold is an error."""
    held = {}
    for name, df in tables.items():
        rows = df.limit(MOST_ROWS).collect()
        if len(rows) >= MOST_ROWS:
            raise ValueError(f"{name}: a sheet holds fewer than {MOST_ROWS} rows below its names")
        held[name] = [df.columns, *rows]
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(held) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(held, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(held) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        for i, rows in enumerate(held.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'{head}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for n, row in enumerate(rows, 1):
                    out.write((f'<row r="{n}">' + "".join(_cell(f"{_letters(k)}{n}", v) for k, v in enumerate(row)) + "</row>").encode())
                out.write(b"</sheetData></worksheet>")
