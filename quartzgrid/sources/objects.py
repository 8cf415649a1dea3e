"""Charts, pivot tables and data validations of a worksheet, as rows with what they read."""

from __future__ import annotations

import posixpath
import re
from typing import NamedTuple

from quartzgrid.formulas.references import Context, Edge, Gap, analyse
from quartzgrid.sources.workbook import Package, WorkbookError, local, parse_xml, plain_keys

MOST = 500
#: Validation formulas that read nothing: lists in quotes, numbers, dates.
CONSTANT = re.compile(r'^\s*(".*"|[+-]?[\d.]+(?:[eE][+-]?\d+)?|TRUE|FALSE)\s*$', re.I | re.S)


class SheetObject(NamedTuple):
    kind: str
    key: str
    anchor: str
    sources: tuple[str, ...]
    detail: str = ""


def _related(package: Package, part: str, folder: str) -> list[str]:
    return sorted(p for p in package.relations(part).values() if f"/{folder}/" in f"/{p}")


def chart_sources(data: bytes) -> tuple[str, ...]:
    """The formulas of a chart's series: names, categories, values, sizes; each once, in order."""
    found: dict[str, None] = {}
    state = {"in": False, "text": ""}

    def start(tag: str, _: dict[str, str]) -> None:
        if local(tag) == "f":
            state.update({"in": True, "text": ""})

    def end(tag: str) -> None:
        if local(tag) == "f" and state["in"]:
            found[state["text"].strip()] = None
            state["in"] = False

    def characters(text: str) -> None:
        if state["in"]:
            state["text"] += text

    parse_xml(data, start, end, characters)
    return tuple(found)


def pivot(package: Package, part: str) -> SheetObject:
    """Its source is a range of a sheet or a table; a source outside the workbook is said to be unreadable."""
    facts: dict[str, str] = {}

    def table(tag: str, attributes: dict[str, str]) -> None:
        a = plain_keys(attributes)
        if local(tag) == "pivotTableDefinition":
            facts["name"] = a.get("name", "")
        elif local(tag) == "location":
            facts["ref"] = a.get("ref", "")

    def cache(tag: str, attributes: dict[str, str]) -> None:
        a = plain_keys(attributes)
        if local(tag) == "cacheSource":
            facts["type"] = a.get("type", "")
        elif local(tag) == "worksheetSource":
            sheet, ref = a.get("sheet"), a.get("ref")
            facts["source"] = a["name"] + "[#All]" if "name" in a else f"'{sheet}'!{ref}" if sheet and ref else ref or ""

    parse_xml(package.part(part) or b"", table)
    for definition in _related(package, part, "pivotCache"):
        parse_xml(package.part(definition) or b"", cache)
    source = facts.get("source", "")
    return SheetObject("pivot_table", facts.get("name", ""), facts.get("ref", ""), (source,) if source else (), "" if source else f"the source is outside the workbook ({facts.get('type') or 'unreadable'})")


def validations(data: bytes) -> list[SheetObject]:
    """Those whose formulas read cells."""
    out: list[SheetObject] = []
    state: dict = {"at": None, "field": False, "text": ""}

    def start(tag: str, attributes: dict[str, str]) -> None:
        kind, a = local(tag), plain_keys(attributes)
        if kind == "dataValidation":
            state["at"] = (a.get("sqref", ""), a.get("type", "none"), [])
        elif kind in ("formula1", "formula2") and state["at"]:
            state.update({"field": True, "text": ""})

    def end(tag: str) -> None:
        kind = local(tag)
        if kind in ("formula1", "formula2") and state["field"]:
            if state["text"].strip() and not CONSTANT.match(state["text"]):
                state["at"][2].append(state["text"].strip())
            state["field"] = False
        elif kind == "dataValidation" and state["at"]:
            anchor, rule, formulas = state["at"]
            if formulas:
                out.append(SheetObject("data_validation", f"validation {anchor}", anchor, tuple(formulas), rule))
            state["at"] = None

    def characters(text: str) -> None:
        if state["field"]:
            state["text"] += text

    parse_xml(data, start, end, characters)
    return out


def sheet_objects(package: Package, part: str) -> tuple[list[SheetObject], list[str]]:
    """(objects, warnings): at most MOST of a kind, and the warning says how many there are; a malformed part is a warning."""
    charts, pivots, warnings = [], [], []
    for drawing in _related(package, part, "drawings"):
        for chart in _related(package, drawing, "charts"):
            try:
                charts.append(SheetObject("chart", posixpath.basename(chart).removesuffix(".xml"), "", chart_sources(package.part(chart) or b"")))
            except WorkbookError as error:
                warnings.append(f"{chart}: {error}")
    for table in _related(package, part, "pivotTables"):
        try:
            pivots.append(pivot(package, table))
        except WorkbookError as error:
            warnings.append(f"{table}: {error}")
    rules = validations(package.part(part) or b"")
    for kind, found in (("charts", charts), ("pivot tables", pivots), ("validations", rules)):
        if len(found) > MOST:
            warnings.append(f"{len(found)} {kind}, of which {MOST} are read")
    return [*charts[:MOST], *pivots[:MOST], *rules[:MOST]], warnings


def object_edges(found: SheetObject, context: Context) -> tuple[list[Edge], list[Gap]]:
    """What an object reads: its sources are formulas like any other."""
    edges: dict[Edge, None] = {}
    gaps: dict[Gap, None] = {}
    for source in found.sources:
        more, missing = analyse("=" + source.removeprefix("="), context)
        edges |= dict.fromkeys(more)
        gaps |= dict.fromkeys(missing)
    if found.kind == "pivot_table" and not found.sources:
        gaps[Gap(found.key, "external_link")] = None
    return list(edges), list(gaps)
