"""Text views of workbooks within a token budget, ranges cut by rows, questions mined from labels.

`grid` and `render` show plain cells by DataFrame operations. `workbook_text` shows a workbook as a whole, with what its
facts say: a workbook is a group, bounded by its file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.formulas.lexer import pattern
from quartzgrid.formulas.references import Context, analyse
from quartzgrid.functions.a1 import column_letter
from quartzgrid.functions.text import approx_tokens, cell_text, label
from quartzgrid.operators.model import a1, context_of, of_workbooks, static_target
from quartzgrid.operators.regions import Region, detect
from quartzgrid.operators.spatial import label_before
from quartzgrid.sources.objects import SheetObject, object_edges
from quartzgrid.sources.workbook import letters

#: Rows from the head and the tail, and characters of a cell, at each level of detail.
LADDER = ((1_000_000, 0, 200), (200, 20, 120), (40, 10, 80), (12, 4, 60), (5, 2, 40), (1, 0, 24))
MAX_CELLS = 2000


def grid(cells: DataFrame, keys: list[str], head: int, tail: int, limit: int) -> DataFrame:
    """(keys, lines): rows as lines of cells with their column letters; rows left out are said, in their place."""
    row = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "display"))), lambda x: F.concat(column_letter(x["col"]), F.lit(":"), cell_text(x["display"], limit))), " | ").alias("line"))
    counted = row.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("row")))
    kept = counted.where((F.col("rn") <= head) | (F.col("rn") > F.col("n") - tail))
    gap = F.when((F.col("rn") == head) & (F.col("n") > head + tail), F.concat(F.lit("\n… "), F.col("n") - head - tail, F.lit(" rows omitted …"))).otherwise("")
    line = F.concat(F.col("row").cast("string"), F.lit(" "), F.col("line"), gap)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def render(cells: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(keys, rung, text): the most detailed rung that fits the budget; if none does, the last one cut at the budget."""
    rungs = [grid(cells, keys, *step).withColumn("rung", F.lit(k)) for k, step in enumerate(LADDER)]
    every = rungs[0]
    for rung in rungs[1:]:
        every = every.unionByName(rung)
    fitting = every.withColumn("fits", approx_tokens(F.col("lines")) <= budget)
    best = fitting.groupBy(*keys).agg(F.min(F.when(F.col("fits"), F.struct("rung", "lines"))).alias("best"), F.max(F.struct("rung", "lines")).alias("least"))
    chosen = F.coalesce("best", F.struct(F.col("least.rung").alias("rung"), F.substring("least.lines", 1, 3 * budget).alias("lines")))
    return best.select(*keys, chosen["rung"].alias("rung"), chosen["lines"].alias("text"))


# ---- whole workbooks ---------------------------------------------------------------

#: Stands after a value that a formula was saved with (fixed value).
MARK = "ƒ"
TEXT = "workbook_id string, detail string, tokens int, complete boolean, text string"
LEAST_BUDGET = 50


@dataclass(frozen=True)
class Detail:
    """How much of a workbook one rung of the ladder shows: head and tail rows of a table, columns, formulas a sheet, characters a cell, loose cells."""

    name: str
    head: int | None = None
    tail: int = 0
    columns: int | None = None
    formulas: int | None = None
    chars: int | None = None
    loose: int | None = None
    grids: bool = True
    schemas: bool = True


#: The rungs, most detailed first (fixed values).
RUNGS = (
    Detail("full"), Detail("rows-2000", 2000, 100, 100, 1000, 200, 1000), Detail("rows-1000", 1000, 50, 80, 600, 160, 500), Detail("rows-500", 500, 25, 60, 400, 120, 300), Detail("rows-200", 200, 20, 60, 300, 120, 200), Detail("rows-50", 50, 10, 40, 100, 80, 50),
    Detail("rows-20", 20, 5, 25, 40, 60, 20), Detail("rows-8", 8, 3, 15, 15, 40, 8), Detail("rows-3", 3, 1, 10, 6, 30, 3), Detail("schemas", 0, 0, 10, 3, 30, 0, grids=False), Detail("overview", 0, 0, 0, 0, 30, 0, grids=False, schemas=False),
)


def count_tokens(text: str) -> int:
    return -(-len(text) // 3)


def shown_number(x: float) -> str:
    """Whole numbers without a point, others with twelve digits at most."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else format(x, ".12g")


def flat_text(text: str, most: int | None) -> str:
    """White space collapsed, bars escaped, an ellipsis where it is too long."""
    out = " ".join(text.split()).replace("|", "\\|")
    return out if most is None or len(out) <= most else out[: most - 1] + "…"


def shown_value(cell: dict, most: int | None) -> str:
    kind = cell["kind"]
    if kind == "boolean":
        return "TRUE" if cell["num"] else "FALSE"
    if kind == "date":
        when: datetime = pd.Timestamp(cell["ts"]).to_pydatetime()
        return when.date().isoformat() if (when.hour, when.minute, when.second) == (0, 0, 0) else when.isoformat(" ")
    if kind == "number":
        return shown_number(cell["num"] * 100) + "%" if cell["is_percentage"] else shown_number(cell["num"])
    return "" if kind == "empty" else flat_text(cell["str"] or "", most)


def shown_cell(cell: dict | None, most: int | None = None) -> str:
    """A formula shows its saved value with MARK after it, or its text if none was saved."""
    if cell is None:
        return ""
    if not cell["formula"]:
        return shown_value(cell, most)
    return flat_text(cell["formula"], most) if cell["kind"] == "empty" else f"{shown_value(cell, most)} {MARK}"


def named_sheet(sheet: str, at: str) -> str:
    return f"{sheet}!{at}" if sheet.replace("_", "").isalnum() else "'" + sheet.replace("'", "''") + f"'!{at}"


class _Text:
    def __init__(self) -> None:
        self.lines: list[str] = []
        self.complete = True

    def add(self, line: str = "") -> None:
        self.lines.append(line)

    def left_out(self, line: str) -> None:
        self.complete = False
        self.lines.append(line)


@dataclass
class _Sheet:
    name: str
    cells: dict[tuple[int, int], dict]
    regions: list[Region]
    formulas: list[tuple[str, int, str, str, list[str], list[str]]]  # where, cells, text, saved value, reads, gaps
    objects: list[str]
    visibility: str
    is_macro: bool


def formula_lines(sheet: str, cells: dict[tuple[int, int], dict], context: Context) -> list[tuple]:
    """A sheet's formulas by pattern: extent, number of cells, the first one's text and saved value, what all of them read and can't say."""
    groups: dict[str, list[tuple[int, int]]] = {}
    for place in sorted(cells):
        if cells[place]["formula"]:
            groups.setdefault(pattern(cells[place]["formula"]), []).append(place)
    out = []
    for _, places in sorted(groups.items()):
        rows, columns = [r for r, _ in places], [c for _, c in places]
        spans: dict[tuple[str, str], list[int]] = {}
        gaps: dict[str, None] = {}
        for r, c in places:
            found, missing = analyse(cells[r, c]["formula"], replace(context, sheet=sheet, row=r, col=c))
            for k, e in enumerate(found):
                key = (e.sheet, f"{e.kind}{k}")
                old = spans.get(key, [e.row_lo, e.row_hi, e.col_lo, e.col_hi])
                spans[key] = [min(old[0], e.row_lo), max(old[1], e.row_hi), min(old[2], e.col_lo), max(old[3], e.col_hi)]
            gaps |= dict.fromkeys(f"{g.text} ({g.reason})" for g in missing)
        first = cells[places[0]]
        reads = list(dict.fromkeys(named_sheet(s, a1(*span)) for (s, _), span in spans.items()))
        out.append((a1(min(rows), max(rows), min(columns), max(columns)), len(places), first["formula"], "" if first["kind"] == "empty" else shown_value(first, None), reads, list(gaps)))
    return sorted(out)


def formula_line(entry: tuple, most: int | None) -> str:
    where, n, text, saved, reads, gaps = entry
    many = f" ({n} cells, one pattern)" if n > 1 else ""
    result = ("values in the grid" if saved else "no saved values") if n > 1 else saved or "no saved value"
    line = f"{where}{many}: {flat_text(text, most)} → {result}"
    return line + (f"; reads {', '.join(reads)}" if reads else "") + (f"; unresolved: {', '.join(gaps)}" if gaps else "")


def _rows_shown(rows: list[int], detail: Detail) -> tuple[list[int], tuple[int, int, int] | None]:
    """Head and tail of the data rows, and (first, last, number) of those between that are left out."""
    if detail.head is None or len(rows) <= detail.head + detail.tail:
        return rows, None
    tail = rows[len(rows) - detail.tail :]
    middle = rows[detail.head : len(rows) - detail.tail]
    return rows[: detail.head] + tail, (middle[0], middle[-1], len(middle))


def _grid_of(out: _Text, sheet: _Sheet, region: Region, detail: Detail) -> None:
    """Header and units rows are pinned: they are shown whatever else is left out."""
    inside = sorted({r for r, c in sheet.cells if region.row_lo <= r <= region.row_hi and region.col_lo <= c <= region.col_hi})
    pinned = [r for r in inside if r in region.header_rows or r == region.units_row]
    data, gap = _rows_shown([r for r in inside if r not in pinned], detail)
    columns = list(range(region.col_lo, region.col_hi + 1))
    kept = columns if detail.columns is None else columns[: detail.columns]
    out.add("| | " + " | ".join(map(letters, kept)) + " |")
    out.add("|---|" + "---|" * len(kept))
    said = gap is None
    for row in sorted({*pinned, *data}):
        if not said and row > gap[1]:
            out.left_out(f"| … | rows {gap[0]}-{gap[1]} omitted ({gap[2]} rows with data) |")
            said = True
        out.add(f"| {row} | " + " | ".join(shown_cell(sheet.cells.get((row, c)), detail.chars) for c in kept) + " |")
    if not said:
        out.left_out(f"| … | rows {gap[0]}-{gap[1]} omitted ({gap[2]} rows with data) |")
    if len(kept) < len(columns):
        out.left_out(f"(Columns {letters(columns[len(kept)])}-{letters(columns[-1])} omitted: {len(columns) - len(kept)} columns.)")


def loose_cells(cells: dict[tuple[int, int], dict], regions: list[Region]) -> list[tuple[int, int]]:
    """Places of cells that no region covers, in reading order."""
    return [(r, c) for r, c in sorted(cells) if not any(x.row_lo <= r <= x.row_hi and x.col_lo <= c <= x.col_hi for x in regions)]


def _sheet_text(out: _Text, sheet: _Sheet, detail: Detail) -> None:
    if sheet.is_macro:
        out.add(f'## Sheet "{sheet.name}" - macro sheet, not loaded')
        return out.add()
    rows, columns = [r for r, _ in sheet.cells], [c for _, c in sheet.cells]
    used = a1(min(rows), max(rows), min(columns), max(columns)) if rows else "empty"
    out.add(f'## Sheet "{sheet.name}" - used range {used}' + ("" if sheet.visibility == "visible" else f", {sheet.visibility}"))
    if not detail.schemas:
        out.left_out("Regions: " + (", ".join(f"{r.kind} {r.a1}" for r in sheet.regions) or "none") + ". (Contents omitted.)")
        return out.add()
    for region in sheet.regions:
        at = named_sheet(sheet.name, region.a1)
        if region.kind in ("title", "notes"):
            out.add(f"### {region.kind.capitalize()} - {at}")
            for place in sorted(p for p in sheet.cells if region.row_lo <= p[0] <= region.row_hi and region.col_lo <= p[1] <= region.col_hi):
                out.add(f"> {shown_cell(sheet.cells[place], detail.chars)}")
            continue
        heads = f", header row(s) {', '.join(map(str, region.header_rows))}" if region.header_rows else ""
        out.add(f"### {'Table' if region.kind == 'table' else 'Grid'} - {at}{heads}")
        if region.headers:
            out.add("Columns: " + "; ".join(f"{letters(c)} {h} ({t}{', ' + u if u else ''})" for c, h, t, u in zip(region.cols, region.headers, region.types, region.units)))
        if detail.grids:
            _grid_of(out, sheet, region, detail)
        else:
            out.left_out(f"(Rows omitted: {region.a1}.)")
    loose = loose_cells(sheet.cells, sheet.regions)
    kept = loose if detail.loose is None else loose[: detail.loose]
    if kept:
        out.add("Other cells: " + "; ".join(f"{letters(c)}{r} = {shown_cell(sheet.cells[r, c], detail.chars)}" for r, c in kept))
    if len(kept) < len(loose):
        out.left_out(f"({len(loose) - len(kept)} other cell(s) omitted.)")
    for title, lines in (("Formulas:", [formula_line(e, None if detail.chars is None else 3 * detail.chars) for e in sheet.formulas]), ("Charts, pivot tables and validations:", sheet.objects)):
        kept_lines = lines if detail.formulas is None else lines[: detail.formulas]
        if kept_lines:
            out.add(title)
            out.lines += [f"- {x}" for x in kept_lines]
        if len(kept_lines) < len(lines):
            out.left_out(f"({len(lines) - len(kept_lines)} more omitted.)")
    out.add()


def clip(text: str, budget: int, count: Callable[[str], int] = count_tokens) -> str:
    """The lines from the first on that fit, and a line that says so: cut at a line's end, never inside one."""
    mark = "\n(Rendering clipped to the token budget.)\n"
    lines, kept = text.splitlines(), []
    for line in lines:
        if count("\n".join([*kept, line]) + mark) > budget:
            break
        kept.append(line)
    return "\n".join(kept) + mark


def rendered(book: str, sheets: list[_Sheet], facts: dict[str, Any], budget: int, count: Callable[[str], int] = count_tokens) -> tuple[str, int, bool, str]:
    """(detail, tokens, complete, text): the most detailed rung within the budget; if none is, the last one clipped."""
    if budget < LEAST_BUDGET:
        raise ValueError(f"a budget under {LEAST_BUDGET} tokens can't hold an overview")
    n_cells = sum(len(s.cells) for s in sheets)
    text = ""
    for detail in RUNGS:
        if detail.head is None and 2 * n_cells > budget:
            continue  # a whole grid takes two tokens a cell at least
        body = _Text()
        for sheet in sheets:
            _sheet_text(body, sheet, detail)
        head = _Text()
        n_tables, n_formulas = sum(r.kind == "table" for s in sheets for r in s.regions), sum(e[1] for s in sheets for e in s.formulas)
        head.add(f"# Workbook: {book}")
        head.add(f"{len(sheets)} sheet(s), {n_tables} table(s), {n_formulas} formula cell(s), {len(facts['names'])} named range(s).")
        if n_formulas:
            head.add(f"Formula cells ({MARK}) show the value that was saved; nothing is recalculated.")
        if facts["macros"]:
            head.add("Contains macros; they were not loaded or run.")
        head.lines += [f"Note: {w}" for w in facts["warnings"]]
        if facts["names"]:
            head.add("Named ranges: " + "; ".join(facts["names"]))
        if not body.complete:
            head.add(f"This rendering is partial (detail: {detail.name}); omissions are marked.")
        text = "\n".join([*head.lines, "", *body.lines]).rstrip() + "\n"
        if count(text) <= budget:
            return detail.name, count(text), body.complete, text
    text = clip(text, budget, count)
    return "clipped", count(text), False, text


def _name_line(name: str, scope: str | None, target: str, context: Context) -> str:
    said = name if scope is None else f"{name} (sheet {scope})"
    e, why = static_target(target, scope, context)
    return f"{said} = {named_sheet(e.sheet, a1(e.row_lo, e.row_hi, e.col_lo, e.col_hi))}" if e else f"{said} (not a static range: {why})"


def _object_lines(known: pd.DataFrame, sheet: str, context: Context) -> list[str]:
    verbs = {"chart": "plots", "pivot_table": "summarises", "data_validation": "values from"}
    out = []
    for f in known[(known["fact"] == "object") & (known["sheet"] == sheet)].itertuples():
        kind, detail, *sources = f.texts
        found, gaps = object_edges(SheetObject(kind, f.name, f.ref, tuple(sources), detail), replace(context, sheet=sheet))
        reads = ", ".join(dict.fromkeys(named_sheet(e.sheet, a1(e.row_lo, e.row_hi, e.col_lo, e.col_hi)) for e in found))
        missing = ", ".join(dict.fromkeys(f"{g.text} ({g.reason})" for g in gaps))
        out.append(f"{kind.replace('_', ' ')} {f.name}" + (f" at {f.ref}" if f.ref else "") + (f": {verbs.get(kind, 'reads')} {reads}" if reads else "") + (f"; unresolved: {missing}" if missing else ""))
    return out


def workbook_text(cells: DataFrame, facts: DataFrame, budget: int = 8000) -> DataFrame:
    """TEXT, a row a workbook. cells(workbook_id, sheet, row, col, kind, num, str, ts, formula, is_percentage), facts as the reader gives them."""

    def run(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in TEXT.split(", ")]
        if not len(frame):
            return pd.DataFrame([], columns=columns)
        context, by_sheet = context_of(known), {name: part for name, part in frame.groupby("sheet")}
        sheets = []
        for f in known[known["fact"].isin(["sheet", "macro_sheet"])].sort_values("sheet_ix").itertuples():
            part = by_sheet.get(f.sheet)
            held = {} if part is None else {(int(x["row"]), int(x["col"])): x for x in part.to_dict("records")}
            for x in held.values():
                x["formula"], x["str"] = (None if pd.isna(x[k]) else x[k] for k in ("formula", "str"))
            merged = known[(known["fact"] == "merged") & (known["sheet"] == f.sheet)]["ref"].tolist()
            found = detect({p: ("formula" if x["formula"] else x["kind"], x["num"] if x["kind"] == "number" else x["str"]) for p, x in held.items()}, merged) if held else []
            sheets.append(_Sheet(f.sheet, held, found, formula_lines(f.sheet, held, context), _object_lines(known, f.sheet, context), f.texts[0], f.fact == "macro_sheet"))
        said = {
            "names": [_name_line(f.name, f.sheet if isinstance(f.sheet, str) else None, f.ref, context) for f in known[known["fact"] == "name"].itertuples()],
            "warnings": [f.texts[0] for f in known[known["fact"] == "warning"].itertuples()],
            "macros": bool(known["fact"].isin(["macros", "macro_sheet"]).any()),
        }
        book = frame["workbook_id"].iloc[0]
        return pd.DataFrame([(book, *rendered(book, sheets, said, budget))], columns=columns)

    names = ["workbook_id", "sheet", "row", "col", "kind", "num", "str", "ts", "formula", "is_percentage"]
    return cells.select(*names).groupBy("workbook_id").cogroup(of_workbooks(facts).groupBy("workbook_id")).applyInPandas(run, TEXT)


def read_range(cells: DataFrame, row_lo: int, row_hi: int, col_lo: int, col_hi: int) -> DataFrame:
    """Cells of a rectangle in reading order, whole rows up to MAX_CELLS cells; each row says where the next range begins (null: nowhere)."""
    rows = max(1, MAX_CELLS // max(1, col_hi - col_lo + 1))
    last = min(row_hi, row_lo + rows - 1)
    following = F.lit(last + 1 if last < row_hi else None).cast("int")
    return cells.where(F.col("row").between(row_lo, last) & F.col("col").between(col_lo, col_hi)).withColumn("next_row", following).orderBy("row", "col")


def mine_cases(cells: DataFrame, limit: int = 100) -> DataFrame:
    """Questions whose answers are known: a formula's label asks how it is calculated, an input's what it is.

    The label is the nearest text to the left in the row; of equal questions the first in reading order stays.
    """
    text = F.when(F.col("kind") == "text", label(F.col("display")))
    named = cells.withColumn("label", label_before(["workbook_id", "sheet", "row"], ["col"], text)).where("label IS NOT NULL")
    how, what = F.concat(F.lit("How is "), "label", F.lit(" calculated?")), F.concat(F.lit("What is the "), "label", F.lit("?"))
    question = F.when(F.col("formula").isNotNull(), how).when(F.col("kind") == "number", what)
    asked = named.withColumn("question", question).where("question IS NOT NULL")
    first = asked.groupBy("workbook_id", F.lower("question").alias("k")).agg(F.min(F.struct("sheet", "row", "col", "question")).alias("c"))
    cases = first.select("workbook_id", "c.question", "c.sheet", F.concat(column_letter(F.col("c.col")), F.col("c.row")).alias("a1"))
    return cases.orderBy("workbook_id", "sheet", "question").limit(limit)
