"""From cells, regions and facts to the chunks that are searched: one select a kind, then a union. The structure table is operators.structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.functions.a1 import to_a1
from quartzgrid.functions.text import node_id, version_key
from quartzgrid.operators import model

CHUNK = ["workbook_id", "version", "node_id", "sheet_name", "a1_range", "chunk_type", "title", "content", "headers", "version_key"]
GROUPS, LEAST = 8, 50


def _key(kind: str, key: Column) -> Column:
    return node_id(F.col("workbook_id"), F.col("version"), F.lit(kind), key)


def _chunk(df: DataFrame, kind: str, key: Column, sheet: Column, a1: Column, title: Column, content: Column, headers: Column | None = None) -> DataFrame:
    headers = headers if headers is not None else F.array().cast("array<string>")
    return df.select("workbook_id", "version", _key(kind, key).alias("node_id"), sheet.alias("sheet_name"), a1.alias("a1_range"), F.lit(kind).alias("chunk_type"), title.alias("title"), content.alias("content"), headers.alias("headers"), version_key(F.col("workbook_id"), F.col("version")).alias("version_key"))


def chunks(cells: DataFrame, regions: DataFrame, facts: DataFrame) -> DataFrame:
    """cells(workbook_id, version, sheet, row, col, kind, display, formula), regions as operators.regions gives them, with version.

    facts as sources.workbook gives them. A workbook, its sheets, regions, columns, row groups, formula clusters, objects,
    defined names and macro sheets each give a chunk. Their number doesn't
    grow with the rows: at most eight row groups a region, one chunk a pattern of formulas.
    """
    where = F.lit(None).cast("string")
    books = cells.groupBy("workbook_id", "version").agg(F.array_sort(F.collect_set("sheet")).alias("sheets"), F.count("formula").alias("n_formulas"), F.count("*").alias("n_cells"))
    book = _chunk(books, "workbook", F.col("workbook_id"), where, where, F.col("workbook_id"), F.concat(F.lit("Sheets: "), F.array_join("sheets", ", "), F.lit("\nCells: "), "n_cells", F.lit("; formulas: "), "n_formulas"))
    used = cells.groupBy("workbook_id", "version", "sheet").agg(F.struct(F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col").alias("col_lo"), F.max("col").alias("col_hi")).alias("span"), F.count("*").alias("n_cells"))
    sheet = _chunk(used, "sheet", F.col("sheet"), F.col("sheet"), to_a1(F.col("span")), F.col("sheet"), F.concat(F.lit("Used range "), to_a1(F.col("span")), F.lit("; cells: "), "n_cells"))
    at = F.concat(F.col("sheet"), F.lit("!"), F.col("a1"))
    region = _chunk(regions, "region", at, F.col("sheet"), F.col("a1"), F.concat("sheet", F.lit(" "), "kind", F.lit(" "), "a1"), F.concat_ws("\n", F.nullif("title", F.lit("")), F.concat(F.lit("Columns: "), F.array_join("headers", ", ")), F.concat(F.lit("Rows: "), "n_rows")), F.col("headers"))
    tables = regions.where("kind = 'table'")
    columns = tables.select("*", F.posexplode(F.arrays_zip(F.col("headers").alias("header"), F.col("units").alias("unit"), F.col("types").alias("type"))).alias("ix", "column"))
    column = _chunk(columns, "column", F.concat(at, F.lit("!"), F.col("ix")), F.col("sheet"), F.col("a1"), F.col("column.header"), F.concat_ws("\n", F.concat(F.lit("Type: "), "column.type"), F.when(F.col("column.unit") != "", F.concat(F.lit("Unit: "), "column.unit"))), F.array("column.header"))
    group = row_groups(cells, tables)
    from quartzgrid.operators import structure

    known, versions = model.of_workbooks(facts), cells.select("workbook_id", "version").distinct()
    rest = [structure.formula_chunks(cells, known), structure.object_chunks(known, versions), structure.name_chunks(known, versions), structure.macro_sheet_chunks(known, versions)]
    return reduce(DataFrame.unionByName, [book, sheet, region, column, group, *rest])


def row_groups(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """At most eight chunks a table: its rows' displayed values, row by row. A row belongs to the table of its sheet that spans it."""
    spans = tables.select("workbook_id", "sheet", "a1", "headers", F.col("row_lo").alias("lo"), F.col("row_hi").alias("hi"), "col_lo", "col_hi")
    held = cells.join(spans, ["workbook_id", "sheet"]).where("row BETWEEN lo AND hi AND col BETWEEN col_lo AND col_hi")
    keys = ["workbook_id", "version", "sheet", "a1", "headers"]
    rows = held.groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "display"))), lambda x: x["display"]), " | ").alias("line"))
    n, rn = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy("row"))
    size = F.greatest(F.lit(LEAST), F.ceil(F.col("n") / GROUPS))
    grouped = rows.withColumn("n", n).withColumn("rn", rn).withColumn("group", F.floor((F.col("rn") - 1) / size)).groupBy(*keys, "group").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return _chunk(grouped, "row_group", F.concat("sheet", F.lit("!"), "a1", F.lit("!rows"), "group"), F.col("sheet"), F.col("a1"), F.concat("sheet", F.lit(" rows "), "first", F.lit("-"), "last"), F.col("lines"), F.col("headers"))
