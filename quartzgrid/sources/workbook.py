"""Reads workbooks into rows of cells: OOXML and binary OOXML packages and delimited text, one file a task.

Formulas are never evaluated while reading. XML with entity declarations, packages that declare too much and parts that
are malformed are refused for that file; the file's rows then hold the error and the job goes on.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzgrid.formulas import lexer

MAX_PACKAGE, MAX_CSV = 512 << 20, 256 << 20
#: A declared area beyond so many cells, and so many times what is populated, is noted as not true.
MAX_SHEET_CELLS, MOST_EMPTY = 5_000_000, 4
#: Rows and columns of a sheet (fixed values of the format): delimited text beyond them is refused.
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
#: Cells of an array formula's extent that are marked one by one.
MAX_ARRAY_CELLS = 100_000
CELLS = "path string, sha256 string, sheet string, sheet_ix int, row int, col int, kind string, num double, str string, ts timestamp_ntz, formula string, number_format string, is_percentage boolean, is_currency boolean, merged_range string, array_range string, array_master string, error string"
#: Facts of workbooks that are no cells; `fact` says which kind, and what a kind needs not is null.
FACTS = "path string, sha256 string, fact string, sheet string, sheet_ix int, name string, ref string, row_lo int, row_hi int, col_lo int, col_hi int, header_rows int, totals_rows int, texts array<string>"
#: Number formats that need no definition in a file and show dates (fixed values of the format).
DATE_FORMATS = {14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}
PLAIN_FORMATS = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 48: "##0.0E+0", 49: "@"}
CURRENCY = re.compile("[$€£¥₹]")
#: Error codes of the binary format (fixed values).
BINARY_ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}
NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")


class WorkbookError(ValueError):
    """The file is refused, with the reason."""


@dataclass
class Cell:
    row: int
    col: int
    kind: str
    value: Any
    formula: str | None = None
    number_format: str = "General"
    array_range: str | None = None
    array_master: str | None = None


@dataclass
class Sheet:
    name: str
    cells: list[Cell] = field(default_factory=list)
    merged: list[str] = field(default_factory=list)
    dimension: str = ""
    visibility: str = "visible"
    is_macro: bool = False
    objects: list[Any] = field(default_factory=list)

    @property
    def dimension_is_false(self) -> bool:
        """Declares far more than it holds."""
        area = area_of(self.dimension)
        return area > MAX_SHEET_CELLS and area > MOST_EMPTY * len(self.cells)


@dataclass
class Table:
    """A table object of a sheet."""

    name: str
    sheet: str
    ref: str
    columns: list[str]
    header_rows: int = 1
    totals_rows: int = 0


@dataclass
class Workbook:
    sheets: list[Sheet]
    names: dict[tuple[str | None, str], str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    has_macros: bool = False


def parse_xml(data: bytes, start=None, end=None, characters=None) -> None:
    """Expat without entities: a declaration of one is an error, so is malformed XML."""
    parser = expat.ParserCreate(namespace_separator="}")

    def refuse(*_: Any) -> None:
        raise WorkbookError("entity declarations are refused")

    parser.EntityDeclHandler = parser.UnparsedEntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        parser.Parse(data, True)
    except expat.ExpatError as error:
        raise WorkbookError(f"malformed XML ({error})") from None


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def plain_keys(attributes: dict[str, str]) -> dict[str, str]:
    return {local(k): v for k, v in attributes.items()}


def position(reference: str) -> tuple[int, int]:
    letters = reference.rstrip("0123456789")
    n = 0
    for c in letters.upper().replace("$", ""):
        n = n * 26 + ord(c) - 64
    return int(reference[len(letters) :]), n


def rectangle(ref: str) -> tuple[int, int, int, int]:
    """(row_lo, row_hi, col_lo, col_hi) of a cell or of a rectangle, with or without dollar signs."""
    first, _, last = ref.replace("$", "").partition(":")
    (r1, c1), (r2, c2) = position(first), position(last or first)
    return min(r1, r2), max(r1, r2), min(c1, c2), max(c1, c2)


def area_of(ref: str) -> int:
    """Cells of a rectangle; 0 for what is none."""
    try:
        r1, r2, c1, c2 = rectangle(ref)
    except ValueError:
        return 0
    return (r2 - r1 + 1) * (c2 - c1 + 1)


def serial_date(value: float, epoch_1904: bool = False) -> datetime | None:
    start = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
    try:
        return start + timedelta(seconds=round(value * 86400, 3))
    except OverflowError:
        return None


def is_date_format(code: str) -> bool:
    return bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|General', "", code), re.I)) and "#" not in code


# ---- OOXML ---------------------------------------------------------------------


class Package:
    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise WorkbookError("not a workbook: neither a package nor delimited text") from None
        if sum(i.file_size for i in self.zip.infolist()) > MAX_PACKAGE:
            raise WorkbookError("the package declares too many bytes")
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def part(self, name: str) -> bytes | None:
        found = self.names.get(name.lower().lstrip("/"))
        return self.zip.read(found) if found else None

    def relations(self, part: str) -> dict[str, str]:
        folder, name = posixpath.split(part)
        data, found = self.part(f"{folder}/_rels/{name}.rels"), {}

        def start(tag: str, a: dict[str, str]) -> None:
            if local(tag) == "Relationship" and a.get("TargetMode") != "External":
                target = a.get("Target", "")
                found[a.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))

        if data:
            parse_xml(data, start)
        return found


def read_ooxml(data: bytes) -> Workbook:
    package = Package(data)
    if package.part("xl/workbook.bin"):
        return read_binary(package)
    main = package.part("xl/workbook.xml")
    if main is None:
        raise WorkbookError("the package holds no workbook")
    listed: list[tuple[str, str, str]] = []
    names: dict[tuple[str | None, str], str] = {}
    state: dict[str, Any] = {"name": None, "epoch": False, "text": ""}

    def start(tag: str, attributes: dict[str, str]) -> None:
        a, kind = plain_keys(attributes), local(tag)
        if kind == "sheet":
            listed.append((a.get("name", ""), a.get("id", ""), a.get("state", "visible")))
        elif kind == "workbookPr":
            state["epoch"] = a.get("date1904") in ("1", "true")
        elif kind == "definedName":
            state.update({"name": (int(a["localSheetId"]) if "localSheetId" in a else None, a.get("name", "")), "text": ""})

    def end(tag: str) -> None:
        if local(tag) == "definedName" and state["name"]:
            scope, name = state["name"]
            names[listed[scope][0] if scope is not None and scope < len(listed) else None, name] = state["text"]
            state["name"] = None

    def characters(text: str) -> None:
        if state["name"]:
            state["text"] += text

    parse_xml(main, start, end, characters)
    relations = package.relations("xl/workbook.xml")
    strings, formats = _shared_strings(package), _cell_formats(package)
    book = Workbook([], names, has_macros=package.part("xl/vbaProject.bin") is not None or "macroEnabled" in (package.part("[Content_Types].xml") or b"").decode("utf-8", "replace"))
    for name, relation, visibility in listed:
        part = relations.get(relation, "")
        content = package.part(part) if "/worksheets/" in f"/{part}" else None
        if content is None:
            book.sheets.append(Sheet(name, visibility=visibility, is_macro="/macrosheets/" in f"/{part}" or "/dialogsheets/" in f"/{part}"))
            book.warnings.append(f"sheet {name} is no worksheet")
            continue
        sheet = scan_sheet(name, content, strings, formats, state["epoch"])
        sheet.visibility = visibility
        if sheet.dimension_is_false:
            book.warnings.append(f"sheet {name} declares {sheet.dimension}, far more than its cells; that was not believed")
        book.sheets.append(sheet)
        for target in sorted(package.relations(part).values()):
            if "/tables/" in f"/{target}" and (found := package.part(target)):
                book.tables.append(_table(name, found))
        from quartzgrid.sources.objects import sheet_objects

        sheet.objects, warnings = sheet_objects(package, part)
        book.warnings += warnings
    return book


def _table(sheet: str, data: bytes) -> Table:
    table = Table("", sheet, "", [])

    def start(tag: str, attributes: dict[str, str]) -> None:
        a, kind = plain_keys(attributes), local(tag)
        if kind == "table":
            table.name, table.ref = a.get("displayName") or a.get("name", ""), a.get("ref", "")
            table.header_rows, table.totals_rows = int(a.get("headerRowCount", 1)), int(a.get("totalsRowCount", 0))
        elif kind == "tableColumn":
            table.columns.append(a.get("name", ""))

    parse_xml(data, start)
    return table


def _shared_strings(package: Package) -> list[str]:
    data, out, state = package.part("xl/sharedStrings.xml"), [], {"in": False, "skip": 0}
    if not data:
        return out

    def start(tag: str, _: dict[str, str]) -> None:
        kind = local(tag)
        if kind == "si":
            out.append("")
        state["skip"] += kind == "rPh"
        state["in"] = kind == "t" and not state["skip"]

    def end(tag: str) -> None:
        state["skip"] -= local(tag) == "rPh"
        state["in"] = False

    def characters(text: str) -> None:
        if state["in"]:
            out[-1] += text

    parse_xml(data, start, end, characters)
    return out


def _cell_formats(package: Package) -> list[str]:
    data, codes, out, state = package.part("xl/styles.xml"), {}, [], {"in": False}
    if not data:
        return ["General"]

    def start(tag: str, attributes: dict[str, str]) -> None:
        a, kind = plain_keys(attributes), local(tag)
        if kind == "numFmt":
            codes[int(a["numFmtId"])] = a.get("formatCode", "General")
        elif kind == "cellXfs":
            state["in"] = True
        elif kind == "xf" and state["in"]:
            n = int(a.get("numFmtId", 0))
            out.append(codes.get(n) or DATE_FORMATS.get(n) or PLAIN_FORMATS.get(n) or "General")

    def end(tag: str) -> None:
        if local(tag) == "cellXfs":
            state["in"] = False

    parse_xml(data, start, end)
    return out or ["General"]


def scan_sheet(name: str, data: bytes, strings: list[str], formats: list[str], epoch_1904: bool) -> Sheet:
    """One pass over a worksheet; cells without a position follow the one before. Declared dimensions are not trusted."""
    sheet, shared = Sheet(name), {}
    at = {"row": 0, "col": 0, "cell": None, "field": None}

    def start(tag: str, attributes: dict[str, str]) -> None:
        a, kind = plain_keys(attributes), local(tag)
        if kind == "row":
            at["row"], at["col"] = int(a["r"]) if "r" in a else at["row"] + 1, 0
        elif kind == "c":
            at["row"], at["col"] = position(a["r"]) if "r" in a else (at["row"], at["col"] + 1)
            at["cell"] = {"type": a.get("t", "n"), "style": int(a.get("s", 0)), "v": "", "f": None, "is": "", "fa": {}}
        elif kind == "f" and at["cell"] is not None:
            at["cell"]["f"], at["cell"]["fa"], at["field"] = "", a, "f"
        elif kind == "v" and at["cell"] is not None:
            at["field"] = "v"
        elif kind == "t" and at["cell"] is not None:
            at["field"] = "is"
        elif kind == "mergeCell":
            sheet.merged.append(a.get("ref", ""))
        elif kind == "dimension":
            sheet.dimension = a.get("ref", "")

    def characters(text: str) -> None:
        if at["cell"] is not None and at["field"]:
            at["cell"][at["field"]] += text

    def end(tag: str) -> None:
        kind = local(tag)
        if kind in ("f", "v", "t"):
            at["field"] = None
        elif kind == "c" and at["cell"] is not None:
            raw, at["cell"] = at["cell"], None
            code = formats[raw["style"]] if raw["style"] < len(formats) else "General"
            formula = _formula(raw, shared, at["row"], at["col"])
            cell_kind, value = saved_value(raw, code, strings, epoch_1904)
            if cell_kind != "empty" or formula is not None:
                sheet.cells.append(Cell(at["row"], at["col"], cell_kind, value, formula, code, raw["fa"].get("ref") if raw["fa"].get("t") in ("array", "dataTable") else None))

    parse_xml(data, start, end, characters)
    _mark_arrays(sheet)
    return sheet


def _mark_arrays(sheet: Sheet) -> None:
    """Cells without a formula inside an array formula's extent hold its results: they name the cell that has the formula."""
    owners: dict[tuple[int, int], str] = {}
    for cell in sheet.cells:
        if cell.array_range and 1 < area_of(cell.array_range) <= MAX_ARRAY_CELLS:
            r1, r2, c1, c2 = rectangle(cell.array_range)
            owners |= {(r, c): f"{letters(cell.col)}{cell.row}" for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
    for cell in sheet.cells if owners else ():
        if cell.formula is None and not cell.array_range:
            cell.array_master = owners.get((cell.row, cell.col))


def _formula(raw: dict, shared: dict, row: int, col: int) -> str | None:
    if raw["f"] is None:
        return None
    attributes = raw["fa"]
    if attributes.get("t") == "dataTable":
        return f"=TABLE({attributes.get('r1', '')},{attributes.get('r2', '')})"
    if attributes.get("t") == "shared":
        if raw["f"]:
            shared[attributes.get("si")] = (raw["f"], row, col)
        elif attributes.get("si") in shared:
            text, from_row, from_col = shared[attributes["si"]]
            return "=" + moved(text, row - from_row, col - from_col)
    return "=" + raw["f"] if raw["f"] else None


def moved(formula: str, rows: int, cols: int) -> str:
    """The formula as filled from one cell to another: relative references follow."""
    def one(m: re.Match) -> str:
        r, c = position(m[2] + m[4])
        r, c = r if m[3] else r + rows, c if m[1] else c + cols
        return f"{m[1]}{letters(c)}{m[3]}{r}" if r > 0 and c > 0 else "#REF!"

    out = []
    for token in lexer.tokens(formula):
        sheet, mark, cells = token.text.rpartition("!")
        out.append(sheet + mark + re.sub(r"(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d*)(?![\w(])", one, cells) if token.kind == lexer.REF and "[" not in token.text else token.text)
    return "".join(out)


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def saved_value(raw: dict, code: str, strings: list[str], epoch_1904: bool) -> tuple[str, Any]:
    kind, text = raw["type"], raw["v"]
    if kind == "inlineStr":
        return "text", raw["is"]
    if text == "":
        return ("text", "") if kind == "str" and raw["f"] is not None else ("empty", None)
    if kind == "s":
        return "text", strings[int(text)] if int(text) < len(strings) else ""
    if kind == "str":
        return "text", text
    if kind == "b":
        return "boolean", text.strip() in ("1", "true")
    if kind == "e":
        return "error", text
    if kind == "d":
        return "date", datetime.fromisoformat(text.rstrip("Z"))
    number = float(text)
    if is_date_format(code):
        when = serial_date(number, epoch_1904)
        return ("date", when) if when else ("error", "#VALUE!")
    return "number", number


# ---- the binary format ----------------------------------------------------------


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(id, body) of the records: ids take up to two bytes, lengths up to four, seven bits each."""
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80 and at < len(data):
            kind |= data[at] << 8
            at += 1
        size = shift = 0
        while at < len(data):
            byte = data[at]
            at += 1
            size |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80 or shift > 21:
                break
        yield kind, data[at : at + size]
        at += size


def _wide(body: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", body, at)[0]
    return ("", at + 4) if n == 0xFFFFFFFF else (body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n)


def read_binary(package: Package) -> Workbook:
    """Values only: formula text is not decoded, which a warning says; such cells have the formula '='."""
    strings = [_wide(body, 1)[0] for kind, body in records(package.part("xl/sharedStrings.bin") or b"") if kind == 0x13]
    relations, book = package.relations("xl/workbook.bin"), Workbook([])
    for kind, body in records(package.part("xl/workbook.bin") or b""):
        if kind == 0x19C:
            relation, at = _wide(body, 8)
            name, _ = _wide(body, at)
            book.sheets.append(_binary_sheet(name, package.part(relations.get(relation, "")) or b"", strings))
    n = sum(c.formula is not None for s in book.sheets for c in s.cells)
    if n:
        book.warnings.append(f"{n} formula cells without formula text")
    return book


def _binary_sheet(name: str, data: bytes, strings: list[str]) -> Sheet:
    sheet, row = Sheet(name), 0
    for kind, body in records(data):
        if kind == 0x00:
            row = struct.unpack_from("<I", body)[0] + 1
        elif 0x01 <= kind <= 0x0B and len(body) >= 8:
            col = struct.unpack_from("<I", body)[0] + 1
            formula = "=" if kind >= 0x08 else None
            if kind == 0x02:
                packed = struct.unpack_from("<I", body, 8)[0]
                value = float(struct.unpack("<i", struct.pack("<I", packed))[0] >> 2) if packed & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", packed & 0xFFFFFFFC))[0]
                cell = ("number", value / 100 if packed & 1 else value)
            elif kind in (0x03, 0x0B):
                cell = ("error", BINARY_ERRORS.get(body[8], "#VALUE!"))
            elif kind in (0x04, 0x0A):
                cell = ("boolean", bool(body[8]))
            elif kind in (0x05, 0x09):
                cell = ("number", struct.unpack_from("<d", body, 8)[0])
            elif kind in (0x06, 0x08):
                cell = ("text", _wide(body, 8)[0])
            elif kind == 0x07:
                n = struct.unpack_from("<I", body, 8)[0]
                cell = ("text", strings[n] if n < len(strings) else "")
            else:
                continue
            sheet.cells.append(Cell(row, col, *cell, formula))
    return sheet


# ---- delimited text ---------------------------------------------------------------


def read_delimited(data: bytes, name: str) -> Workbook:
    """One sheet. Fields are typed; integers with a leading zero are text, and commas are decimal in files split by semicolons."""
    if len(data) > MAX_CSV:
        raise WorkbookError("the text is too long")
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    # What stands in quotes says nothing about the delimiter.
    head = re.sub(r'"(?:[^"]|"")*"', '""', text[:65536]).splitlines()[:20]
    delimiter = max(",;\t|", key=lambda d: (sum(d in x for x in head), sum(x.count(d) for x in head), -",;\t|".index(d)))
    sheet = Sheet(sheet_name(name))
    csv.field_size_limit(MAX_CSV)
    for r, fields in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter), 1):
        if r > MAX_ROWS or len(fields) > MAX_COLUMNS:
            raise WorkbookError(f"more than {MAX_ROWS} rows or {MAX_COLUMNS} columns")
        for c, value in enumerate(fields, 1):
            kind, typed = typed_field(value, delimiter == ";")
            if kind != "empty":
                sheet.cells.append(Cell(r, c, kind, typed))
    return Workbook([sheet], warnings=["delimited text: no formulas, formats or names"])


def typed_field(text: str, comma_decimal: bool) -> tuple[str, Any]:
    stripped = text.strip()
    if not stripped:
        return "empty", None
    if stripped.upper() in ("TRUE", "FALSE"):
        return "boolean", stripped.upper() == "TRUE"
    number = stripped.replace(",", ".") if comma_decimal else stripped
    if NUMBER.fullmatch(number) and not re.fullmatch(r"[+-]?0\d+", stripped):
        return "number", float(number)
    return "text", text


def sheet_name(label: str) -> str:
    stem = re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", label)[-1])
    return re.sub(r"[\[\]:*?/\\]", "_", stem)[:31] or "Sheet1"


def read_workbook(data: bytes, name: str) -> Workbook:
    if data[:2] == b"PK" or not name.lower().endswith((".csv", ".tsv", ".txt")):
        return read_ooxml(data)
    return read_delimited(data, name)


#: What reading a broken file may raise; anything else is a fault of this module.
UNREADABLE = (WorkbookError, zipfile.BadZipFile, LookupError, ValueError, OverflowError, EOFError, NotImplementedError, RuntimeError, struct.error, csv.Error, zlib.error)


# ---- as DataFrames ----------------------------------------------------------------


def cells_of(path: str, digest: str, data: bytes) -> Iterator[tuple]:
    try:
        book = read_workbook(data, path)
    except UNREADABLE as error:
        yield (path, digest, *[None] * 15, str(error))
        return
    for ix, sheet in enumerate(book.sheets):
        masters = {position(m.split(":")[0].replace("$", "")): m for m in sheet.merged if m}
        for cell in sheet.cells:
            number = float(cell.value) if cell.kind in ("number", "boolean") else None
            text = str(cell.value) if cell.kind in ("text", "error") else None
            when = cell.value if cell.kind == "date" else None
            yield (path, digest, sheet.name, ix, cell.row, cell.col, cell.kind, number, text, when, cell.formula, cell.number_format, "%" in cell.number_format, bool(CURRENCY.search(cell.number_format)), masters.get((cell.row, cell.col)), cell.array_range, cell.array_master, None)


def facts_of(path: str, digest: str, data: bytes) -> Iterator[tuple]:
    """Rows of FACTS: sheets, names, tables, arrays, merged ranges, objects, warnings, macros. A refused file gives its error as one row."""
    def row(fact: str, sheet: str | None = None, ix: int | None = None, name: str | None = None, ref: str | None = None, span: tuple = (None,) * 4, heads: int | None = None, totals: int | None = None, texts: list[str] | None = None) -> tuple:
        return (path, digest, fact, sheet, ix, name, ref, *span, heads, totals, texts)

    try:
        book = read_workbook(data, path)
    except UNREADABLE as error:
        yield row("error", texts=[str(error)])
        return
    for ix, sheet in enumerate(book.sheets):
        used = (max((c.row for c in sheet.cells), default=1), max((c.col for c in sheet.cells), default=1))
        yield row("macro_sheet" if sheet.is_macro else "sheet", sheet.name, ix, sheet.name, sheet.dimension, (1, used[0], 1, used[1]), texts=[sheet.visibility])
        for ref in sheet.merged:
            if area_of(ref):
                yield row("merged", sheet.name, ix, None, ref, rectangle(ref))
        for cell in sheet.cells:
            if cell.array_range and area_of(cell.array_range) > 1:
                yield row("array", sheet.name, ix, f"{letters(cell.col)}{cell.row}", cell.array_range, rectangle(cell.array_range))
        for found in sheet.objects:
            yield row("object", sheet.name, ix, found.key, found.anchor, texts=[found.kind, found.detail, *found.sources])
    for table in book.tables:
        yield row("table", table.sheet, None, table.name, table.ref, rectangle(table.ref), table.header_rows, table.totals_rows, table.columns)
    for (scope, name), target in sorted(book.names.items(), key=lambda x: (x[0][1].lower(), x[0][0] or "")):
        yield row("name", scope, None, name, target)
    for warning in book.warnings:
        yield row("warning", texts=[warning])
    if book.has_macros:
        yield row("macros")


def facts_frame(files: DataFrame) -> DataFrame:
    """files(path, sha256, content) -> FACTS."""
    columns = [c.split()[0] for c in FACTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, d, c in zip(frame["path"], frame["sha256"], frame["content"]) for r in facts_of(p, d, bytes(c))]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in ("sheet_ix", "row_lo", "row_hi", "col_lo", "col_hi", "header_rows", "totals_rows")})

    return files.select("path", "sha256", "content").mapInPandas(run, FACTS)


def workbook_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, content) of the files below a path; lock files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).where(~F.col("path").rlike(r"/~\$[^/]*$"))
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content")


def read_facts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return facts_frame(workbook_files(spark, path, pattern))


def read_cells(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A row for each populated cell of the workbooks below a path; a refused file is one row with its error."""
    return cells_frame(workbook_files(spark, path, pattern))


def cells_frame(files: DataFrame) -> DataFrame:
    """files(path, sha256, content) -> CELLS."""
    columns = [c.split()[0] for c in CELLS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, digest, content in zip(frame["path"], frame["sha256"], frame["content"]):
                rows = []
                for row in cells_of(name, digest, bytes(content)):
                    rows.append(row)
                    if len(rows) >= 50_000:
                        yield _typed(rows, columns)
                        rows = []
                if rows:
                    yield _typed(rows, columns)

    return files.select("path", "sha256", "content").mapInPandas(run, CELLS)


def _typed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    frame["ts"] = pd.to_datetime(frame["ts"])
    return frame.astype({c: "Int32" for c in ("sheet_ix", "row", "col")} | {c: "boolean" for c in ("is_percentage", "is_currency")} | {"num": "float64"})
