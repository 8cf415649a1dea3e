"""A workbook's facts (names, tables, macro sheets, array extents) beside its formulas: what resolves references and what they read.

Facts come as rows (sources.workbook.FACTS) and meet the formulas of their workbook in one task; a file bounds both.
"""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzgrid.formulas import lexer
from quartzgrid.formulas.references import Context, Edge, Table, analyse
from quartzgrid.sources.objects import SheetObject, object_edges
from quartzgrid.sources.workbook import letters

EDGES = "workbook_id string, sheet string, formula string, this_row int, target_sheet string, row_lo int, row_hi int, col_lo int, col_hi int, kind string, reference_text string, reason string"
OBJECTS = "workbook_id string, sheet string, object_kind string, name string, anchor string, detail string, target_sheet string, row_lo int, row_hi int, col_lo int, col_hi int, kind string, reference_text string, reason string"
NAMES = "workbook_id string, name string, scope_sheet string, target string, resolved boolean, target_sheet string, row_lo int, row_hi int, col_lo int, col_hi int, detail string"
_INTS = {c: "Int32" for c in ("row_lo", "row_hi", "col_lo", "col_hi")}
#: Formulas whose reading depends on their own row.
OWN_ROW = r"\[\s*@|(?i)#\s*this row|\bROW\(\)"
_OWN_ROW = re.compile(r"\[\s*@|#\s*this row|\bROW\(\)", re.I)


def context_of(facts: pd.DataFrame) -> Context:
    """The facts of one workbook as the analysis takes them; of a table or name that occurs twice the last one counts."""
    sheets, macro, extents, tables, names, spills = [], set(), {}, {}, {}, {}
    for f in facts.sort_values("sheet_ix", kind="stable").itertuples():
        if f.fact in ("sheet", "macro_sheet"):
            (macro.add if f.fact == "macro_sheet" else sheets.append)(f.sheet)
            extents[f.sheet] = (int(f.row_hi), int(f.col_hi))
        elif f.fact == "table":
            tables[f.name] = Table(f.sheet, int(f.row_lo), int(f.row_hi), int(f.col_lo), tuple(f.texts), int(f.header_rows), int(f.totals_rows))
        elif f.fact == "name":
            names[f.sheet if isinstance(f.sheet, str) else None, f.name] = f.ref
        elif f.fact == "array":
            spills[f.sheet, int(f.row_lo), int(f.col_lo)] = (int(f.row_lo), int(f.row_hi), int(f.col_lo), int(f.col_hi))
    return Context(sheet=sheets[0] if sheets else "", sheets=sheets, extents=extents, names=names, tables=tables, spills=spills, macro_sheets=frozenset(macro))


def of_workbooks(facts: DataFrame) -> DataFrame:
    """Facts by workbook: the path is the workbook's id where the table has no other."""
    return facts if "workbook_id" in facts.columns else facts.withColumn("workbook_id", F.col("path"))


def edges(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each edge of each distinct formula of a sheet, and one for each gap, with a reason instead of a rectangle.

    cells(workbook_id, sheet, row, formula). `this_row` is set for the formulas whose reading depends on their own row;
    join on (workbook_id, sheet, formula) and on this_row where it isn't null.
    """
    own_row = F.when(F.col("formula").rlike(OWN_ROW), F.col("row")).alias("this_row")
    distinct = cells.where("formula IS NOT NULL").select("workbook_id", "sheet", "formula", own_row).distinct()

    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        base, rows = context_of(known), []
        for book, sheet, formula, row in zip(asked["workbook_id"], asked["sheet"], asked["formula"], asked["this_row"]):
            found, gaps = analyse(formula, replace(base, sheet=sheet, row=None if pd.isna(row) else int(row)))
            rows += [(book, sheet, formula, row, e.sheet, e.row_lo, e.row_hi, e.col_lo, e.col_hi, e.kind, None, None) for e in found]
            rows += [(book, sheet, formula, row, None, None, None, None, None, None, g.text, g.reason) for g in gaps]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")]).astype(_INTS | {"this_row": "Int32"})

    return distinct.groupBy("workbook_id").cogroup(of_workbooks(facts).groupBy("workbook_id")).applyInPandas(run, EDGES)


def edges_of_cells(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """edges() by cell: (workbook_id, sheet, row, col, target...); each formula cell with each of its edges and gaps."""
    found = edges(cells, facts)
    asked = cells.where("formula IS NOT NULL").select("workbook_id", "sheet", "row", "col", "formula")
    joined = asked.join(found, ["workbook_id", "sheet", "formula"])
    return joined.where(F.col("this_row").isNull() | (F.col("this_row") == F.col("row"))).drop("this_row")


def objects(facts: DataFrame) -> DataFrame:
    """Charts, pivot tables and validations with what they read: a row for each edge or gap, one row of an object that reads nothing."""

    def run(known: pd.DataFrame) -> pd.DataFrame:
        base, rows = context_of(known), []
        for f in known[known["fact"] == "object"].itertuples():
            kind, detail, *sources = f.texts
            found, gaps = object_edges(SheetObject(kind, f.name, f.ref, tuple(sources), detail), replace(base, sheet=f.sheet))
            head = (f.workbook_id, f.sheet, kind, f.name, f.ref, detail)
            rows += [(*head, e.sheet, e.row_lo, e.row_hi, e.col_lo, e.col_hi, e.kind, None, None) for e in found]
            rows += [(*head, *[None] * 6, g.text, g.reason) for g in gaps]
            if not found and not gaps:
                rows.append((*head, *[None] * 8))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OBJECTS.split(", ")]).astype(_INTS)

    return of_workbooks(facts).groupBy("workbook_id").applyInPandas(run, OBJECTS)


def static_target(target: str, scope: str | None, context: Context) -> tuple[Edge | None, str | None]:
    """(rectangle, None) of a defined name whose target is one reference, else (None, reason)."""
    found, gaps = analyse("=" + target.removeprefix("="), replace(context, sheet=scope or context.sheet))
    alone = [t.kind for t in lexer.tokens(target) if t.kind != lexer.SPACE] == [lexer.REF]
    if alone and len(found) == 1 and not gaps:
        return found[0], None
    return None, gaps[0].reason if gaps else "not a static range"


def names(facts: DataFrame) -> DataFrame:
    """Defined names, each with its rectangle if its target is a static one, else with the reason."""

    def run(known: pd.DataFrame) -> pd.DataFrame:
        base, rows = context_of(known), []
        for f in known[known["fact"] == "name"].itertuples():
            scope = f.sheet if isinstance(f.sheet, str) else None
            at, why = static_target(f.ref, scope, base)
            rows.append((f.workbook_id, f.name, scope, f.ref, at is not None, *(at[:5] if at else (None,) * 5), why))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NAMES.split(", ")]).astype(_INTS)

    return of_workbooks(facts).groupBy("workbook_id").applyInPandas(run, NAMES)


def broadened(cells: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of clusters: for each pattern and target sheet, the rectangle that the edges of its cells cover together.

    found: edges_of_cells() with the columns `keys` that name a cluster. Exact, as every cell's own edges go in.
    """
    return found.where("target_sheet IS NOT NULL").groupBy(*keys, "target_sheet", "kind").agg(F.min("row_lo").alias("row_lo"), F.max("row_hi").alias("row_hi"), F.min("col_lo").alias("col_lo"), F.max("col_hi").alias("col_hi"), F.count("*").alias("n_edges"))


def a1(row_lo: int, row_hi: int, col_lo: int, col_hi: int) -> str:
    first, last = f"{letters(col_lo)}{row_lo}", f"{letters(col_hi)}{row_hi}"
    return first if first == last else f"{first}:{last}"


def summary(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Inspection of workbooks: a row for each sheet with its numbers of cells, formulas, tables, names, arrays, merged ranges and objects."""
    known = of_workbooks(facts)
    held = cells.groupBy("workbook_id", "sheet").agg(F.count("*").alias("n_cells"), F.count("formula").alias("n_formulas"), F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col").alias("col_lo"), F.max("col").alias("col_hi"))
    counts = known.groupBy("workbook_id", "sheet").agg(*(F.sum((F.col("fact") == kind).cast("long")).alias(f"n_{kind}s") for kind in ("table", "name", "array", "object")), F.sum((F.col("fact") == "merged").cast("long")).alias("n_merged"))
    sheets = known.where(F.col("fact").isin("sheet", "macro_sheet")).select("workbook_id", "sheet", "sheet_ix", (F.col("fact") == "macro_sheet").alias("is_macro"), F.col("texts")[0].alias("visibility"))
    joined = reduce(lambda a, b: a.join(b, ["workbook_id", "sheet"], "left"), [held, counts], sheets)
    return joined.fillna(0, ["n_cells", "n_formulas", "n_tables", "n_names", "n_arrays", "n_objects", "n_merged"])
