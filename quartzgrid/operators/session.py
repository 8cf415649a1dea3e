"""Questions about one model's cells: find, what a range reads, who reads a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.functions.a1 import column_letter, overlaps
from quartzgrid.operators import model
from quartzgrid.operators.profile import find_capped
from quartzgrid.operators.spatial import interval_join

MATCHES, FORMULAS = 50, 100


def find(cells: DataFrame, needle: str) -> DataFrame:
    """The first MATCHES cells whose display or formula holds the text, whatever the case, with the true total."""
    place = cells.withColumn("place", F.struct("sheet", "row", "col"))
    return find_capped(place, needle, F.concat_ws(" ", "display", "formula"), "place", MATCHES).drop("place")


def _meets(rectangle: tuple[int, int, int, int]) -> Column:
    row_lo, row_hi, col_lo, col_hi = map(F.lit, rectangle)
    return overlaps(F.col("row_lo"), F.col("row_hi"), row_lo, row_hi) & overlaps(F.col("col_lo"), F.col("col_hi"), col_lo, col_hi)


def precedents(formulas: DataFrame, edges: DataFrame, sheet: str, rectangle: tuple[int, int, int, int]) -> DataFrame:
    """What the formulas inside the rectangle read: formulas(sheet, row, col, formula) with edges by (sheet, formula)."""
    row_lo, row_hi, col_lo, col_hi = rectangle
    inside = formulas.where((F.col("sheet") == sheet) & F.col("row").between(row_lo, row_hi) & F.col("col").between(col_lo, col_hi)).orderBy("row", "col").limit(FORMULAS)
    return inside.join(edges, ["sheet", "formula"]).select("sheet", "row", "col", "formula", "target_sheet", "row_lo", "row_hi", "col_lo", "col_hi", "kind", "reference_text", "reason")


def dependents(formulas: DataFrame, edges: DataFrame, sheet: str, rectangle: tuple[int, int, int, int]) -> DataFrame:
    """Formulas with an edge that meets the rectangle, each once."""
    readers = edges.where((F.col("target_sheet") == sheet) & _meets(rectangle)).select("sheet", "formula").distinct()
    return formulas.join(readers, ["sheet", "formula"], "left_semi").orderBy("sheet", "row", "col").limit(FORMULAS)


def readers_of_changes(changes: DataFrame, edges: DataFrame, width: int = 64) -> DataFrame:
    """changes(change_id, sheet, row, col) -> (change_id, reader): points in rectangles, as a join on the grid of rows."""
    points = changes.select("change_id", F.col("sheet").alias("target_sheet"), "row", "col")
    met = interval_join(points, edges.select("target_sheet", "row_lo", "row_hi", "col_lo", "col_hi", F.col("sheet").alias("reader_sheet"), "formula"), ("row", "row"), ("row_lo", "row_hi"), width, ["target_sheet"])
    return met.where("col BETWEEN col_lo AND col_hi").select("change_id", "reader_sheet", "formula").distinct()


def find_everywhere(cells: DataFrame, names: DataFrame, needle: str) -> DataFrame:
    """(place, text, total): the first MATCHES cells and defined names that hold the text, whatever the case, with the true total.

    cells(workbook_id, sheet, row, col, display, formula), names as operators.model gives them. Cells come before names.
    """
    at = F.concat(F.col("sheet"), F.lit("!"), column_letter(F.col("col")), F.col("row").cast("string"))
    held = cells.select(F.struct(F.lit(0).alias("kind"), "workbook_id", "sheet", "row", "col", F.lit("").alias("name")).alias("order"), at.alias("place"), F.concat_ws(" ", "display", "formula").alias("text"))
    named = names.select(F.struct(F.lit(1).alias("kind"), "workbook_id", F.coalesce("scope_sheet", F.lit("")).alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("col"), "name").alias("order"), F.col("name").alias("place"), F.concat_ws(" ", "name", "target").alias("text"))
    return find_capped(held.unionByName(named), needle, F.col("text"), "order", MATCHES).select("order.workbook_id", "place", "text", "total")


def readers(cells: DataFrame, facts: DataFrame, sheet: str, rectangle: tuple[int, int, int, int]) -> DataFrame:
    """(workbook_id, kind, sheet, at): formula cells and objects with a resolved edge that meets the rectangle, each once; gaps meet nothing."""
    resolved = (F.col("target_sheet") == sheet) & _meets(rectangle)
    formulas = model.edges_of_cells(cells, facts).where(resolved).select("workbook_id", F.lit("formula").alias("kind"), "sheet", F.concat(column_letter(F.col("col")), F.col("row").cast("string")).alias("at"))
    drawn = model.objects(facts).where(resolved).select("workbook_id", F.col("object_kind").alias("kind"), "sheet", F.col("name").alias("at"))
    return formulas.unionByName(drawn).distinct()


def reads(cells: DataFrame, facts: DataFrame, sheet: str, rectangle: tuple[int, int, int, int]) -> DataFrame:
    """What the formulas inside a rectangle read, with what each read cell or range shows: one value, or the number of cells."""
    row_lo, row_hi, col_lo, col_hi = rectangle
    inside = cells.where((F.col("sheet") == sheet) & F.col("row").between(row_lo, row_hi) & F.col("col").between(col_lo, col_hi))
    found = model.edges_of_cells(inside, facts).where("target_sheet IS NOT NULL")
    shown = cells.select("workbook_id", F.col("sheet").alias("target_sheet"), F.col("row").alias("r"), F.col("col").alias("c"), "display")
    met = found.join(shown, ["workbook_id", "target_sheet"]).where("r BETWEEN row_lo AND row_hi AND c BETWEEN col_lo AND col_hi")
    keys = ["workbook_id", "sheet", "row", "col", "formula", "target_sheet", "row_lo", "row_hi", "col_lo", "col_hi", "kind"]
    return met.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.min_by("display", F.struct("r", "c")).alias("first_display"))
