"""Static analysis of formulas as DataFrames: patterns and clusters, edges and gaps. Python sees distinct formulas only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzgrid.formulas.lexer import pattern
from quartzgrid.formulas.references import Context, analyse

EDGE_SCHEMA = "sheet string, formula string, target_sheet string, row_lo int, row_hi int, col_lo int, col_hi int, kind string, reference_text string, reason string"


def patterns(distinct: DataFrame, formula: str = "formula") -> DataFrame:
    """(formula, pattern)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(pattern=frame[formula].map(pattern))[[formula, "pattern"]]

    return distinct.select(formula).where(F.col(formula).isNotNull()).mapInPandas(run, f"{formula} string, pattern string")


def clusters(cells: DataFrame) -> DataFrame:
    """cells(sheet, row, col, formula) -> one row for each pattern of a sheet: its extent, its first formula, its size."""
    named = cells.where("formula IS NOT NULL").join(patterns(cells.select("formula").distinct()), "formula")
    place = F.struct("row", "col")
    return named.groupBy("sheet", "pattern").agg(
        F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col").alias("col_lo"), F.max("col").alias("col_hi"), F.min_by("formula", place).alias("first_formula"), F.count("*").alias("n_cells")
    )


def edges(distinct: DataFrame, sheets: list[str], **facts) -> DataFrame:
    """(sheet, formula) -> a row for each edge, and one for each gap, which has a reason instead of a rectangle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for sheet, formula in zip(frame["sheet"], frame["formula"]):
                found, gaps = analyse(formula, Context(sheet=sheet, sheets=sheets, **facts))
                rows += [(sheet, formula, e.sheet, e.row_lo, e.row_hi, e.col_lo, e.col_hi, e.kind, None, None) for e in found]
                rows += [(sheet, formula, None, None, None, None, None, None, g.text, g.reason) for g in gaps]
            columns = ["sheet", "formula", "target_sheet", "row_lo", "row_hi", "col_lo", "col_hi", "kind", "reference_text", "reason"]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in ("row_lo", "row_hi", "col_lo", "col_hi")})

    return distinct.select("sheet", "formula").where("formula IS NOT NULL").mapInPandas(run, EDGE_SCHEMA)
