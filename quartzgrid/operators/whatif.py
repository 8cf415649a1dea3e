"""What-if recalculation of workbooks: dirty marking over cell edges, then evaluation in topological order.

One workbook is one group: a chain of 50,000 cells is a loop in one task, not 50,000 jobs, and many workbooks are many
tasks. The cells of a workbook are bounded by its file. Changes and facts are rows that name their workbook.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import replace
from datetime import date, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.formulas import lexer
from quartzgrid.formulas.evaluator import EPOCH, VOLATILE, Error, Evaluator, Grid, Unknown, number, parsed
from quartzgrid.formulas.references import Context, Edge, analyse
from quartzgrid.operators.model import context_of, of_workbooks
from quartzgrid.sources.workbook import FACTS, rectangle

Key = tuple[str, int, int]
RESULT = "workbook_id string, sheet string, row int, col int, status string, kind string, num double, str string, saved_kind string, saved_num double, saved_str string, formula string, reason string"
CHANGES = "workbook_id string, sheet string, row int, col int, kind string, num double, str string"
MAX_RANGE_CELLS = 1_000_000
#: Error values that a cell or a change may hold (fixed values).
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA")
#: Relative and absolute difference up to which numbers count as equal.
TOLERANCE = 1e-9


class InputError(ValueError):
    """A change or a target that names no cell of the workbook."""


def template(formula: str) -> tuple[str, tuple[str, ...]]:
    """(shape, operands): formulas that differ in their operands only have one shape, and are parsed once."""
    shape, operands = [], []
    for token in lexer.tokens(formula):
        if token.kind == lexer.REF and "[" not in token.text and re.search(r"\d$", token.text):
            shape.append(f"_REF{len(operands)}.")  # the point keeps it from being read as a cell
            operands.append(token.text)
        elif token.kind != lexer.SPACE or "!" in token.text:
            shape.append(token.text)
    return "=" + "".join(shape), tuple(operands)


class Model:
    """cells: key -> (value, formula or None, saved result). arrays: cell with an array formula -> its extent."""

    def __init__(self, cells: dict[Key, tuple[Any, str | None, Any]], context: Context, arrays: dict[Key, tuple[int, int, int, int]] | None = None) -> None:
        self.cells, self.context, self.arrays = cells, context, arrays or {}
        self.edges: dict[Key, list[Edge]] = {}
        self.gaps: dict[Key, str] = {}
        self.rows: dict[str, dict[int, list[int]]] = {}
        self.by_lower: dict[str, str] = {s.lower(): s for s in context.sheets}
        for sheet, row, col in cells:
            self.rows.setdefault(sheet, {}).setdefault(row, []).append(col)
        for sheet, by_row in self.rows.items():
            context.extents.setdefault(sheet, (max(by_row), max(map(max, by_row.values()))))
        #: Cells that hold a part of an array formula's result, by that formula's cell.
        self.spilled: dict[Key, Key] = {}
        for key, (r1, r2, c1, c2) in self.arrays.items():
            for r in range(r1, r2 + 1):
                for c in self.rows.get(key[0], {}).get(r, ()):
                    if c1 <= c <= c2 and (key[0], r, c) != key and not cells[key[0], r, c][1]:
                        self.spilled[key[0], r, c] = key
        for key, (_, formula, _) in cells.items():
            if formula:
                found, gaps = analyse(formula, self._at(key))
                self.edges[key] = found
                if gaps:
                    self.gaps[key] = f"{gaps[0].reason} ({gaps[0].text})"
        for key, master in self.spilled.items():
            self.edges[key] = [Edge(master[0], master[1], master[1], master[2], master[2], "spill")]

    def _at(self, key: Key) -> Context:
        return replace(self.context, sheet=key[0], row=key[1], col=key[2])

    def members(self, edge: Edge) -> list[Key]:
        """Populated cells of a rectangle, by whichever is fewer: its rows or the sheet's."""
        by_row = self.rows.get(edge.sheet, {})
        rows = range(edge.row_lo, edge.row_hi + 1) if edge.row_hi - edge.row_lo < len(by_row) else sorted(r for r in by_row if edge.row_lo <= r <= edge.row_hi)
        return [(edge.sheet, r, c) for r in rows for c in sorted(by_row.get(r, ())) if edge.col_lo <= c <= edge.col_hi]

    def calculate(self, changes: dict[Key, Any], everything: bool = False) -> dict[Key, tuple[str, Any]]:
        """(status, value) of each formula, spilled or changed cell: changed, saved, recalculated or unknown. Members of a cycle are unknown."""
        for sheet, row, col in changes:  # a change may fill a cell that was empty
            columns = self.rows.setdefault(sheet, {}).setdefault(row, [])
            if col not in columns:
                columns.append(col)
        reads = {key: [m for e in edges for m in self.members(e)] for key, edges in self.edges.items()}
        readers: dict[Key, list[Key]] = {}
        for key, members in reads.items():
            for m in members:
                readers.setdefault(m, []).append(key)
        formula = lambda key: (self.cells[key][1] or "").upper() if key in self.cells else ""
        dirty = set(self.edges) if everything else {k for k in self.edges if any(f"{v}(" in formula(k) for v in VOLATILE)}
        if changes:  # what a formula reads that no edge names may be anything
            dirty |= {k for k, gap in self.gaps.items() if gap.startswith(("indirect", "volatile_offset", "unsupported_function"))}
        waiting = list(dirty | set(changes))
        while waiting:
            for reader in readers.get(waiting.pop(), ()):
                if reader not in dirty:
                    dirty.add(reader)
                    waiting.append(reader)
        dirty -= set(changes)
        values: dict[Key, Any] = {k: v for k, (v, f, s) in self.cells.items()} | {k: s for k, (_, f, s) in self.cells.items() if f and k not in dirty} | changes
        out: dict[Key, tuple[str, Any]] = {k: ("changed", v) for k, v in changes.items()} | {k: ("saved", self.cells[k][2]) for k in self.edges if k not in dirty and k not in changes}
        open_inputs = {k: sum(m in dirty for m in dict.fromkeys(reads[k])) for k in dirty}
        ready = [k for k, n in open_inputs.items() if not n]
        whole: dict[Key, Any] = {}
        while ready:
            key = ready.pop()
            values[key] = value = self._part(key, whole) if key in self.spilled else self._computed(key, values, whole)
            out[key] = ("unknown" if isinstance(value, Unknown) else "recalculated", value)
            for reader in dict.fromkeys(readers.get(key, ())):
                if reader in open_inputs:
                    open_inputs[reader] -= 1
                    if not open_inputs[reader]:
                        ready.append(reader)
            del open_inputs[key]
        return out | {k: ("unknown", Unknown("a circular reference, or reads one")) for k in open_inputs}

    def _part(self, key: Key, whole: dict[Key, Any]) -> Any:
        """An array's element; beyond the result nothing."""
        master = self.spilled[key]
        result = whole.get(master)
        if result is None:
            return Unknown("its array formula was not recomputed")
        if not isinstance(result, Grid):
            return result
        r, c = key[1] - master[1], key[2] - master[2]
        r, c = r if len(result) > 1 else 0, c if result and len(result[0]) > 1 else 0
        return result[r][c] if r < len(result) and c < len(result[r]) else None

    def _computed(self, key: Key, values: dict[Key, Any], whole: dict[Key, Any]) -> Any:
        if key in self.gaps and not self.gaps[key].startswith("unsupported_function (LET"):
            return Unknown(self.gaps[key])

        def grid(sheet: str, r1: int, r2: int, c1: int, c2: int) -> Grid:
            if (r2 - r1 + 1) * (c2 - c1 + 1) > MAX_RANGE_CELLS:
                raise ValueError("the range is too large")
            return Grid([[values.get((sheet, r, c)) for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)])

        shape, operands = template(self.cells[key][1])
        evaluator = Evaluator(self._at(key), grid, {f"_REF{k}.": text for k, text in enumerate(operands)})
        result = evaluator.run(lambda: parsed(shape), key in self.arrays)
        if isinstance(result, Grid):
            whole[key] = result
            return result[0][0] if result and result[0] else None
        if key in self.arrays:
            whole[key] = result
        return result


def plain(value: Any) -> tuple[str, float | None, str | None]:
    """(kind, number, text) of a value."""
    if value is None or (isinstance(value, float) and value != value):
        return "empty", None, None
    if isinstance(value, bool):
        return "boolean", float(value), "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return "number", float(value), None
    if isinstance(value, date):
        return "date", number(value), value.isoformat()
    if isinstance(value, Error):
        return "error", None, value.code
    if isinstance(value, Unknown):
        return "unknown", None, None
    return "text", None, str(value)


def value_of(kind: Any, num: Any, text: Any, when: Any = None) -> Any:
    """What a cell's columns stand for: dates, logical values and errors are told apart from numbers and text."""
    if kind == "date":
        return pd.Timestamp(when).to_pydatetime() if when is not None and when == when else EPOCH + pd.Timedelta(days=num) if num is not None and num == num else None
    if kind == "boolean":
        return bool(num)
    if kind == "error":
        return Error(text)
    if kind == "empty":
        return None
    return float(num) if num is not None and num == num else text


# ---- what users write ------------------------------------------------------------


def parse_target(text: str, sheets: list[str]) -> tuple[str, tuple[int, int, int, int]]:
    """(sheet, rectangle) of Sheet!A1 or 'My sheet'!A1:B2, the sheet's name without regard to case."""
    found = re.fullmatch(r"\s*(?:'((?:[^']|'')+)'|([^'!]+))!\s*(\$?[A-Za-z]{1,3}\$?[1-9]\d*(?::\$?[A-Za-z]{1,3}\$?[1-9]\d*)?)\s*", text)
    if not found:
        raise InputError(f"{text!r} names no cell or range with its sheet")
    asked = (found[1] or "").replace("''", "'") or (found[2] or "").strip()
    sheet = next((s for s in sheets if s.casefold() == asked.casefold()), None)
    if sheet is None:
        raise InputError(f"no sheet is named {asked!r}; there are {', '.join(map(repr, sheets))}")
    return sheet, rectangle(found[3].upper())


def typed(raw: Any) -> Any:
    """What a text typed into a cell becomes: a logical value, an error, a number (7%, 1,200), a date in ISO form, text; empty text nothing."""
    if not isinstance(raw, str):
        return raw
    text = raw.strip()
    if not text:
        return None
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    if text.upper() in ERRORS:
        return Error(text.upper())
    bare = text.replace(",", "")
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%?", bare):
        return float(bare.rstrip("%")) / (100 if bare.endswith("%") else 1)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?", text):
        return datetime.fromisoformat(text)
    return raw


def parse_changes(changes: Mapping[str, Any], sheets: list[str]) -> dict[Key, Any]:
    """Sheet!A1 -> value, for one workbook. A change sets one cell, and no formula."""
    out: dict[Key, Any] = {}
    for target, raw in changes.items():
        sheet, (r1, r2, c1, c2) = parse_target(target, sheets)
        if (r1, c1) != (r2, c2):
            raise InputError(f"a change sets one cell, not {target!r}")
        if isinstance(raw, str) and raw.strip().startswith("="):
            raise InputError(f"a change sets a value, not a formula: {target}")
        out[sheet, r1, c1] = typed(raw)
    return out


def changes_frame(spark, changes: Mapping[str, Mapping[Key, Any]]) -> DataFrame:
    """workbook -> cell -> value, as rows of CHANGES."""
    rows = [(book, *key, *plain(value)) for book, own in changes.items() for key, value in own.items()]
    return spark.createDataFrame(rows, CHANGES)


# ---- as DataFrames ---------------------------------------------------------------


def recalculate(cells: DataFrame, changes: DataFrame | None, facts: DataFrame, everything: bool = False) -> DataFrame:
    """A row for each formula, array and changed cell, a workbook a task.

    cells(workbook_id, sheet, row, col, kind, num, str, ts, formula); changes as CHANGES, each for its workbook; facts
    as sources.workbook gives them. Changes of workbooks without cells are left out.
    """
    names = [c.split()[0] for c in FACTS.split(", ")]
    known = of_workbooks(facts).select("workbook_id", *(n for n in names if n != "path"))
    if changes is not None:
        given = F.array("kind", F.col("num").cast("string"), "str")
        told = {"fact": F.lit("change"), "sheet": F.col("sheet"), "row_lo": F.col("row"), "col_lo": F.col("col"), "texts": given}
        kinds = dict(c.split() for c in FACTS.split(", "))
        known = known.unionByName(changes.select("workbook_id", *(told.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names if n != "path")))

    def run(frame: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in RESULT.split(", ")]
        if not len(frame):
            return pd.DataFrame([], columns=columns)
        held: dict[Key, tuple[Any, str | None, Any]] = {}
        for sheet, row, col, kind, num, text, when, formula in zip(*(frame[c] for c in ("sheet", "row", "col", "kind", "num", "str", "ts", "formula"))):
            value = value_of(kind, num, text, when)
            held[sheet, int(row), int(col)] = (value, formula or None, value)
        set_to: dict[Key, Any] = {}
        arrays: dict[Key, tuple[int, int, int, int]] = {}
        for f in rest.itertuples():
            if f.fact == "change":
                kind, num, text = f.texts
                set_to[f.sheet, int(f.row_lo), int(f.col_lo)] = value_of(kind, None if num is None else float(num), text)
            elif f.fact == "array":
                arrays[f.sheet, int(f.row_lo), int(f.col_lo)] = (int(f.row_lo), int(f.row_hi), int(f.col_lo), int(f.col_hi))
        context = context_of(rest)
        if not context.sheets:
            context = replace(context, sheets=sorted(frame["sheet"].unique()), sheet=min(frame["sheet"]))
        model = Model(held, context, arrays)
        rows = []
        for key, (status, value) in sorted(model.calculate(set_to, everything).items()):
            _, formula, saved = held.get(key, (None, None, None))
            reason = value.reason if isinstance(value, Unknown) else None
            rows.append((frame["workbook_id"].iloc[0], *key, status, *plain(value), *plain(saved), formula, reason))
        return pd.DataFrame(rows, columns=columns)

    columns = ["workbook_id", "sheet", "row", "col", "kind", "num", "str", "ts", "formula"]
    return cells.select(*columns).groupBy("workbook_id").cogroup(known.groupBy("workbook_id")).applyInPandas(run, RESULT)


def differs() -> Column:
    """Whether a recalculated value isn't the saved one: numbers and dates within TOLERANCE, all else exactly and with its kind."""
    numeric = F.col("kind").isin("number", "date") & F.col("saved_kind").isin("number", "date")
    near = F.abs(F.col("num") - F.col("saved_num")) <= F.greatest(F.lit(TOLERANCE), TOLERANCE * F.greatest(F.abs("num"), F.abs("saved_num")))
    same = F.when(numeric, near).otherwise((F.col("kind") == F.col("saved_kind")) & F.col("num").eqNullSafe(F.col("saved_num")) & F.col("str").eqNullSafe(F.col("saved_str")))
    return (F.col("status") == "recalculated") & (F.col("saved_kind") != "empty") & ~same


def check_saved(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Every formula recalculated, with `differs`: what the engine makes of a workbook, against what was saved in it."""
    return recalculate(cells, None, facts, everything=True).withColumn("differs", differs())


def unknown_reasons(results: DataFrame) -> DataFrame:
    """(reason, n): why cells stayed unknown, without the details in brackets, most frequent first."""
    reasons = results.where("status = 'unknown'").groupBy(F.split_part("reason", F.lit(" ("), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))
    return reasons.orderBy(F.col("n").desc(), "reason")


def checked(results: DataFrame) -> DataFrame:
    """One row a workbook: formulas recalculated, equal, different and unknown."""
    return results.groupBy("workbook_id").agg(F.count("*").alias("n_formulas"), *(F.sum(F.expr(test).cast("long")).alias(name) for name, test in (("n_equal", "status = 'recalculated' AND NOT differs"), ("n_different", "differs"), ("n_unknown", "status = 'unknown'"))))
