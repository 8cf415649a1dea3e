"""Regions of a sheet: bands of occupied rows and columns, blocks, titles, tables, units and notes.

A sheet is a group; its populated cells are bounded by the file it came from.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from quartzgrid.functions.text import NOTE, UNITS
from quartzgrid.sources.workbook import letters, position

HEADER_ROWS, GROUP_LEAST, GROUPS = 3, 50, 8
REGIONS = "workbook_id string, sheet string, region_ix int, kind string, a1 string, row_lo int, row_hi int, col_lo int, col_hi int, title string, headers array<string>, units array<string>, types array<string>, n_rows int, header_rows array<int>, units_row int, cols array<int>"
_NOTE = re.compile(NOTE)


@dataclass
class Region:
    kind: str
    row_lo: int
    row_hi: int
    col_lo: int
    col_hi: int
    title: str = ""
    headers: list[str] = field(default_factory=list)
    units: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    n_rows: int = 0
    header_rows: tuple[int, ...] = ()
    units_row: int | None = None
    cols: list[int] = field(default_factory=list)

    @property
    def a1(self) -> str:
        first, last = f"{letters(self.col_lo)}{self.row_lo}", f"{letters(self.col_hi)}{self.row_hi}"
        return first if first == last else f"{first}:{last}"


def bands(values: set[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for v in sorted(values):
        if out and v == out[-1][1] + 1:
            out[-1] = (out[-1][0], v)
        else:
            out.append((v, v))
    return out


def detect(cells: dict[tuple[int, int], tuple[str, Any]], merged: list[str] = ()) -> list[Region]:
    """cells: (row, col) -> (kind, value), kind one of number, boolean, date, formula, text, error."""
    cover = {}
    for m in merged:
        first, _, last = m.replace("$", "").partition(":")
        (r1, c1), (r2, c2) = position(first), position(last or first)
        if (r2 - r1 + 1) * (c2 - c1 + 1) <= 100_000:
            cover |= {(r, c): (r1, c1, r2, c2) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
    by_row: dict[int, list[int]] = defaultdict(list)
    for r, c in sorted(cells):
        by_row[r].append(c)
    spread = {r for r, _ in cells} | {r for r, _ in cover}
    columns = bands({c for _, c in cells} | {c for _, c in cover})
    out: list[Region] = []
    for low, high in bands(spread):
        for left, right in columns:
            rows = {r: [c for c in by_row.get(r, ()) if left <= c <= right] for r in range(low, high + 1)}
            if any(rows.values()):
                out += _block(cells, cover, rows, low, high, left, right)
    return out


def _block(cells, cover, rows: dict[int, list[int]], low: int, high: int, left: int, right: int) -> list[Region]:
    out: list[Region] = []
    is_data = lambda r, c: cells[r, c][0] in ("number", "boolean", "date", "formula")
    text_of = lambda r: [str(cells[r, c][1] or "") for c in rows[r] if cells[r, c][0] == "text"]
    at = low
    while at <= high and len(rows[at]) == 1 and cells[at, rows[at][0]][0] == "text":
        span = cover.get((at, rows[at][0]))
        if not (span and span[1] <= left and span[3] >= right and right > left):
            break
        at += 1
    if at > low:
        out.append(Region("title", low, at - 1, left, right, " ".join(t for r in range(low, at) for t in text_of(r))))
    body = [r for r in range(at, high + 1)]
    if not any(rows[r] for r in body):
        return out
    if not any(is_data(r, c) for r in body for c in rows[r]):
        texts = [t for r in body for t in text_of(r)]
        kind = "title" if len(body) == 1 and texts else "notes" if any(_NOTE.search(t) for r in body for t in text_of(r)[:1]) else "generic"
        return [*out, Region(kind, body[0], high, left, right, texts[0] if kind == "title" else "", n_rows=len(body))]
    label_like = lambda r: bool(rows[r]) and 2 * sum(is_data(r, c) for c in rows[r]) < len(rows[r])
    heads: list[int] = []
    for r in body[:HEADER_ROWS]:
        if not label_like(r):
            break
        heads.append(r)
    units_row = None
    normal = lambda t: t.strip().strip(".:").lower()
    if len(heads) >= 2 and (texts := [normal(t) for t in text_of(heads[-1]) if t.strip()]) and all(t in UNITS for t in texts):
        units_row = heads.pop()
    data = [r for r in body if r not in heads and r != units_row]
    notes: list[int] = []
    while data and rows[data[-1]] and _NOTE.search(str(cells[data[-1], rows[data[-1]][0]][1] or "")):
        notes.insert(0, data.pop())
    if not data:
        first = heads[0] if heads else body[0]
        kind = "title" if heads and cells[first, rows[first][0]][0] == "text" else "generic"
        return [*out, Region(kind, body[0], high, left, right, text_of(first)[0] if kind == "title" else "", n_rows=len(body))]

    def head(r: int, c: int) -> str:
        span = cover.get((r, c))
        cell = cells.get((r, c)) or (cells.get(span[:2]) if span else None)
        return str(cell[1]) if cell and cell[1] is not None else ""

    region = Region("table", body[0], data[-1], left, right, n_rows=len(data), header_rows=tuple(heads), units_row=units_row)
    for c in range(left, right + 1):
        present = [cells[r, c] for r in data if (r, c) in cells]
        path = " / ".join(dict.fromkeys(h for h in (head(r, c) for r in heads) if h))
        if present or path:
            region.cols.append(c)
            region.headers.append(path or f"Column {letters(c)}")
            region.units.append(str(cells[units_row, c][1]) if units_row and (units_row, c) in cells else "")
            region.types.append(column_type({k for k, _ in present}))
    out.append(region)
    if notes:
        out.append(Region("notes", notes[0], high, left, right, n_rows=len(notes)))
    return out


def column_type(kinds: set[str]) -> str:
    if not kinds:
        return "empty"
    if kinds <= {"number", "date"} and "number" in kinds:
        return "number"
    return next(iter(kinds)) if len(kinds) == 1 else "mixed"


def group_size(n: int, most: int = GROUPS, least: int = GROUP_LEAST) -> int:
    return max(least, -(-n // most))


def regions(cells: DataFrame) -> DataFrame:
    """cells(workbook_id, sheet, row, col, kind, num, str, formula, merged_range) -> a row for each region, a sheet a group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held, merged = {}, []
        for row, col, kind, num, text, formula, span in zip(*(frame[c] for c in ("row", "col", "kind", "num", "str", "formula", "merged_range"))):
            held[int(row), int(col)] = ("formula" if formula else kind, num if kind == "number" else text)
            if span:
                merged.append(span)
        rows = [(frame["workbook_id"].iloc[0], frame["sheet"].iloc[0], k, r.kind, r.a1, r.row_lo, r.row_hi, r.col_lo, r.col_hi, r.title, r.headers, r.units, r.types, r.n_rows, list(r.header_rows), r.units_row, r.cols) for k, r in enumerate(detect(held, merged))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REGIONS.split(", ")]).astype({"units_row": "Int32"})

    columns = ["workbook_id", "sheet", "row", "col", "kind", "num", "str", "formula", "merged_range"]
    return cells.select(*columns).groupBy("workbook_id", "sheet").applyInPandas(run, REGIONS)
