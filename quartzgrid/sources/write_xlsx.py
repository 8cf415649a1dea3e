"""Writes small workbooks as OOXML packages: for tests, samples and generated sources."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from quartzgrid.sources.workbook import Table, letters, rectangle

_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Styles by number: plain, date, percent, money.
_STYLES = f'<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="&quot;$&quot;#,##0.00"/></numFmts><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/><xf numFmtId="164"/></cellXfs></styleSheet>'
DATE, PERCENT, MONEY = 1, 2, 3


@dataclass(frozen=True)
class Styled:
    """A number with one of the styles above."""

    value: float
    style: int


@dataclass(frozen=True)
class Formula:
    """A formula, its saved value and, of an array formula, its extent."""

    text: str
    saved: Any = None
    array: str = ""


def _serial(value: date) -> float:
    at = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    return (at - datetime(1899, 12, 30)).total_seconds() / 86400


def _cell(row: int, col: int, value: Any) -> str:
    ref, formula, style = f"{letters(col)}{row}", "", ""
    if isinstance(value, tuple):
        value = Formula(*value)
    if isinstance(value, Formula):
        kind = f' t="array" ref="{value.array}"' if value.array else ""
        formula, value = f"<f{kind}>{escape(value.text.removeprefix('='))}</f>", value.saved
    if isinstance(value, Styled):
        style, value = f' s="{value.style}"', value.value
    if isinstance(value, date):
        style, value = f' s="{DATE}"', _serial(value)
    if value is None and not formula:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b">{formula}<v>{int(value)}</v></c>'
    if isinstance(value, str):
        kind = "e" if value.startswith("#") else "str" if formula else "inlineStr"
        body = f"<v>{escape(value)}</v>" if formula or kind == "e" else f"<is><t>{escape(value)}</t></is>"
        return f'<c r="{ref}" t="{kind}">{formula}{body}</c>'
    return f'<c r="{ref}"{style}>{formula}' + (f"<v>{value}</v>" if value is not None else "") + "</c>"


def _relations(targets: list[tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets, 1))
    return f'<Relationships xmlns="{_PACKAGE}">{rows}</Relationships>'


def _table(k: int, table: Table) -> str:
    columns = "".join(f'<tableColumn id="{i}" name={quoteattr(c)}/>' for i, c in enumerate(table.columns, 1))
    return f'<table xmlns="{_MAIN}" id="{k}" name={quoteattr(table.name)} displayName={quoteattr(table.name)} ref="{table.ref}" headerRowCount="{table.header_rows}" totalsRowCount="{table.totals_rows}"><tableColumns count="{len(table.columns)}">{columns}</tableColumns></table>'


def workbook(
    sheets: dict[str, list[list[Any]]], merged: dict[str, list[str]] | None = None, names: dict[str | tuple[str, str], str] | None = None, tables: list[Table] | None = None,
    validations: dict[str, list[tuple[str, str]]] | None = None, charts: dict[str, list[list[str]]] | None = None, hidden: set[str] | None = None, macro_sheets: list[str] | None = None, dimensions: dict[str, str] | None = None,
) -> bytes:
    """Rows of values; Formula or (formula, saved value) for a formula. Names by text, or by (sheet, text) for a sheet's own.

    validations: (cells, list formula) of a sheet; charts: the references of each chart of a sheet.
    """
    out, order = io.BytesIO(), list(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("[Content_Types].xml", _TYPES)
        package.writestr("xl/styles.xml", _STYLES)
        every = [*order, *(macro_sheets or ())]
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"' + (' state="hidden"' if n in (hidden or ()) else "") + "/>" for k, n in enumerate(every, 1))
        defined = ""
        for key, target in (names or {}).items():
            scope, name = key if isinstance(key, tuple) else (None, key)
            local_id = f' localSheetId="{order.index(scope)}"' if scope is not None else ""
            defined += f"<definedName name={quoteattr(name)}{local_id}>{escape(target)}</definedName>"
        package.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets>' + (f"<definedNames>{defined}</definedNames>" if defined else "") + "</workbook>")
        package.writestr("xl/_rels/workbook.xml.rels", _relations([("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(order) + 1)] + [("xlMacrosheet", f"macrosheets/sheet{k}.xml") for k in range(1, len(every) - len(order) + 1)]))
        for k in range(1, len(every) - len(order) + 1):
            package.writestr(f"xl/macrosheets/sheet{k}.xml", f'<macrosheet xmlns="{_MAIN}"/>')
        n_tables = n_charts = 0
        for k, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(f'<row r="{r}">' + "".join(_cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
            spans = (merged or {}).get(name, [])
            merges = f'<mergeCells count="{len(spans)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in spans) + "</mergeCells>" if spans else ""
            rules = "".join(f'<dataValidation type="list" sqref="{at}"><formula1>{escape(source)}</formula1></dataValidation>' for at, source in (validations or {}).get(name, []))
            rules = f"<dataValidations>{rules}</dataValidations>" if rules else ""
            declared = f'<dimension ref="{dimensions[name]}"/>' if name in (dimensions or {}) else ""
            package.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN}">{declared}<sheetData>{body}</sheetData>{merges}{rules}</worksheet>')
            related = []
            for table in tables or ():
                if table.sheet == name:
                    n_tables += 1
                    package.writestr(f"xl/tables/table{n_tables}.xml", _table(n_tables, table))
                    related.append(("table", f"../tables/table{n_tables}.xml"))
            if own := (charts or {}).get(name):
                drawn = []
                for references in own:
                    n_charts += 1
                    series = "".join(f"<c:val><c:f>{escape(r)}</c:f></c:val>" for r in references)
                    package.writestr(f"xl/charts/chart{n_charts}.xml", f'<c:chartSpace xmlns:c="chart"><c:ser>{series}</c:ser></c:chartSpace>')
                    drawn.append(("chart", f"../charts/chart{n_charts}.xml"))
                package.writestr(f"xl/drawings/drawing{k}.xml", "<drawing/>")
                package.writestr(f"xl/drawings/_rels/drawing{k}.xml.rels", _relations(drawn))
                related.append(("drawing", f"../drawings/drawing{k}.xml"))
            if related:
                package.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", _relations(related))
    return out.getvalue()


def table_of(name: str, sheet: str, ref: str, columns: list[str], header_rows: int = 1, totals_rows: int = 0) -> Table:
    """A table object; its columns must be as many as its reference has."""
    _, _, c1, c2 = rectangle(ref)
    if c2 - c1 + 1 != len(columns):
        raise ValueError(f"{ref} has {c2 - c1 + 1} columns, not {len(columns)}")
    return Table(name, sheet, ref, columns, header_rows, totals_rows)
