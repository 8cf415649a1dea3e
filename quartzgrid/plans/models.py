"""Queries over workbooks with names, tables, arrays, objects, dates, errors and macro sheets: one for each region, built in code.

Their SQL twins are the rows that the spreadsheet rules give for the fixed cells below, for each region.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from quartzgrid.catalog import Catalog, table
from quartzgrid.formulas.references import Edge
from quartzgrid.operators import documents, evaluate, model, regions, render, session, structure, whatif
from quartzgrid.plans import expected
from quartzgrid.sources.workbook import cells_frame, facts_frame
from quartzgrid.sources.write_xlsx import PERCENT, Formula, Styled, table_of, workbook

CATALOG = Catalog()

ITEMS = [("Bolt", 3.0, 2.5), ("Nut", 4.0, 1.5), ("Gear", 5.0, 10.0)]
#: Formula, saved value, extent of the Calc sheet's first column, from the first row on.
CALC = [
    ("=Rate*100", 10.0), ("=SUM(Sales!B2:B4)", 12.0), ("=Local+1", 1.2), ('=INDIRECT("A1")', 10.0), ("=SUM(Jan:Mar!A1)", 6.0), ("=[Other.xlsx]S!A1", 7.0), ("=Mac!A1", 7.0), ("=Sales!B2:B4*2", 6.0, "A8:A10"), 8.0, 10.0,
    ("=SUM(A8#)", 24.0), ("=YEAR(Inputs!B3)", 2024.0), ("=IF(Inputs!B4,1,2)", 1.0), ("=Inputs!B5+1", "#DIV/0!"), ("=A16", 0.0), ("=A15", 0.0), ("=LET(x,A1,x*2)", 20.0), ("=SUM(Sales!B:B)", 24.0), ("=SUM(Sales!2:3)", 24.5), ("=NOSUCH(1)", 1.0), ("=SUM(Orders[Total])", 63.5), ("=Nowhere!A1", "#REF!"),
]
#: Formulas over the Sales sheet and what they come to: numbers, or text.
FUNCTIONS = [
    ('=SUMIFS(Sales!D2:D4,Sales!B2:B4,">3",Sales!C2:C4,"<5")', 6.0), ('=COUNTIFS(Sales!B2:B4,">=4")', 2.0), ('=AVERAGEIFS(Sales!C2:C4,Sales!B2:B4,"<5")', 2.0), ("=MAXIFS(Sales!C2:C4,Sales!B2:B4,\"<5\")", 2.5),
    ('=XLOOKUP("Gear",Sales!A2:A4,Sales!C2:C4)', 10.0), ('=XLOOKUP("Cog",Sales!A2:A4,Sales!C2:C4,"none")', "none"), ("=XLOOKUP(4.5,Sales!B2:B4,Sales!A2:A4,,-1)", "Nut"), ('=VLOOKUP("Nut",Sales!A2:D4,3,FALSE)', 1.5), ('=HLOOKUP("Price",Sales!A1:D4,4,FALSE)', 10.0), ("=INDEX(Sales!A2:D4,3,1)", "Gear"), ('=MATCH("Nut",Sales!A2:A4,0)', 2.0),
    ("=IFS(1>2,10,2>1,20)", 20.0), ('=SWITCH(3,1,"a",3,"c","z")', "c"), ("=CHOOSE(2,5,6,7)", 6.0), ('=IFERROR(1/0,"bad")', "bad"), ("=ROUNDUP(2.11,1)", 2.2), ("=ROUNDDOWN(-2.19,1)", -2.1), ("=ROUND(2.5,0)", 3.0), ("=CEILING(7,4)", 8.0), ("=MOD(-3,5)", 2.0), ("=0^0", "#NUM!"), ("=-2^2", 4.0), ("=50%^2", 0.25),
    ("=MEDIAN(Sales!B2:B4)", 4.0), ("=LARGE(Sales!C2:C4,1)", 10.0), ("=SMALL(Sales!C2:C4,1)", 1.5), ("=RANK(4,Sales!B2:B4)", 2.0), ("=PERCENTILE(Sales!B2:B4,0.25)", 3.5), ("=VAR(Sales!B2:B4)", 1.0), ("=SUMPRODUCT(Sales!B2:B4,Sales!C2:C4)", 63.5), ("=SUMPRODUCT((Sales!B2:B4>3)*Sales!C2:C4)", 11.5),
    ("=EOMONTH(DATE(2024,1,31),1)", 45351.0), ("=EDATE(DATE(2024,1,31),1)", 45351.0), ("=WEEKDAY(DATE(2024,5,1),2)", 3.0), ("=DATEDIF(DATE(2020,1,15),DATE(2024,3,5),\"M\")", 49.0), ("=DAYS(DATE(2024,3,1),DATE(2024,2,1))", 29.0), ("=NETWORKDAYS(DATE(2024,3,1),DATE(2024,3,31))", 21.0),
    ('=TEXT(1234.567,"#,##0.00")', "1,234.57"), ('=TEXT(0.256,"0.0%")', "25.6%"), ('=TEXT(DATE(2024,3,5),"yyyy-mm-dd")', "2024-03-05"), ('=VALUE("12%")', 0.12), ('=SUBSTITUTE("aXbX","X","-",2)', "aXb-"), ('=TEXTJOIN("-",TRUE,Sales!A2:A4)', "Bolt-Nut-Gear"), ('=FIND("l",Sales!A2)', 3.0), ('=PROPER("two words")', "Two Words"), ('=LEFT("abc",2)&RIGHT("xyz",1)', "abz"),
    ("=SUM({1,2;3,4})", 10.0), ("=SUM(Sales!B2:B4*2)", 24.0), ('=ISNA(MATCH("x",Sales!A2:A4,0))', True), ("=ISNUMBER(Sales!A2)", False), ("=NPV(0.1,11,12.1)", 20.0), ("=SUBTOTAL(9,Sales!B2:B4)", 12.0), ("=ROWS(Sales!A2:D4)", 3.0), ("=ROW(Sales!A7)", 7.0), ("=COUNTBLANK(Sales!F1:F3)", 3.0),
]


def book() -> bytes:
    sales = [["Item", "Qty", "Price", "Total"]] + [[n, q, p, Formula("=Orders[[#This Row],[Qty]]*Orders[[#This Row],[Price]]", q * p)] for n, q, p in ITEMS] + [["Sum", Formula("=SUM(Orders[Qty])", 12.0), None, Formula("=SUM(Orders[Total])", 63.5)]]
    inputs = [["Rate", Styled(0.1, PERCENT)], ["Local", 0.2], ["Start", datetime(2024, 5, 1)], ["Flag", True], ["Bad", "#DIV/0!"]]
    calc = [[Formula(*c) if isinstance(c, tuple) else c] for c in CALC]
    tests = [[Formula(f, v)] for f, v in FUNCTIONS]
    months = {m: [[float(k)]] for k, m in enumerate(("Jan", "Feb", "Mar"), 1)}
    return workbook(
        {"Sales": sales, "Inputs": inputs, "Calc": calc, **months, "Tests": tests}, names={"Rate": "Inputs!$B$1", ("Calc", "Local"): "Inputs!$B$2", "Loose": "SUM(Inputs!$B$1:$B$2)"},
        tables=[table_of("Orders", "Sales", "A1:D5", ["Item", "Qty", "Price", "Total"], totals_rows=1)], charts={"Sales": [["Sales!$B$2:$B$4"]]}, validations={"Inputs": [("B4", "Sales!$A$2:$A$4")]}, hidden={"Mar"}, macro_sheets=["Mac"],
    )


def _files(spark, sf_dir):
    def build(frames):
        content = book()
        for frame in frames:
            yield pd.DataFrame({"path": frame["r_name"] + ".xlsx", "content": [content] * len(frame)})

    files = table(spark, sf_dir, "region").select("r_name").mapInPandas(build, "path string, content binary")
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content")


def _cells(spark, sf_dir):
    cells = cells_frame(_files(spark, sf_dir))
    return cells.select("*", F.col("path").alias("workbook_id"), F.lit(1).alias("version"), structure.shown().alias("display"))


def _facts(spark, sf_dir):
    return facts_frame(_files(spark, sf_dir))


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def _values(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL: the rows for each region's workbook; columns name their SQL types."""
    listed = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    typed = ", ".join(f'CAST(v."{c}" AS {kind}) AS "{c}"' for c, kind in columns.items())
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT r_name || '.xlsx' AS workbook_id, {typed} FROM region CROSS JOIN (VALUES {listed}) v({names})"


# ---- facts and what formulas read ---------------------------------------------------


@CATALOG.query(
    "workbook_facts",
    _values({"fact": "VARCHAR", "n": "BIGINT", "named": "VARCHAR"}, [("sheet", 7, "Calc, Feb, Inputs, Jan, Mar, Sales, Tests"), ("macro_sheet", 1, "Mac"), ("object", 2, "chart1, validation B4"), ("array", 1, "A8"), ("table", 1, "Orders"), ("name", 3, "Local, Loose, Rate"), ("warning", 1, "")]),
)
def workbook_facts(spark, sf_dir):
    facts = _facts(spark, sf_dir).groupBy(F.col("path").alias("workbook_id"), "fact")
    return facts.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("named"))


#: (row of Calc, sheet, rows, columns, kind) or (row of Calc, text, reason).
_EDGES: list[tuple[int, Edge]] = [
    (r, Edge(*e)) for r, *e in (
        (1, "Inputs", 1, 1, 2, 2, "named_range"), (2, "Sales", 2, 4, 2, 2, "range"), (3, "Inputs", 2, 2, 2, 2, "named_range"), (5, "Jan", 1, 1, 1, 1, "cell"), (5, "Feb", 1, 1, 1, 1, "cell"), (5, "Mar", 1, 1, 1, 1, "cell"), (8, "Sales", 2, 4, 2, 2, "range"),
        (11, "Calc", 8, 10, 1, 1, "spill"), (12, "Inputs", 3, 3, 2, 2, "cell"), (13, "Inputs", 4, 4, 2, 2, "cell"), (14, "Inputs", 5, 5, 2, 2, "cell"), (15, "Calc", 16, 16, 1, 1, "cell"), (16, "Calc", 15, 15, 1, 1, "cell"), (17, "Calc", 1, 1, 1, 1, "cell"),
        (18, "Sales", 1, 5, 2, 2, "range"), (19, "Sales", 2, 3, 1, 4, "range"), (21, "Sales", 2, 4, 4, 4, "table_column"),
    )
]
_GAPS = [(4, "INDIRECT", "indirect"), (6, "[Other.xlsx]S!A1", "external_link"), (7, "Mac!A1", "macro_sheet"), (22, "Nowhere!A1", "malformed")]
_SPAN = {"row_lo": "INTEGER", "row_hi": "INTEGER", "col_lo": "INTEGER", "col_hi": "INTEGER"}
_THIS_ROW = [("Sales", r, 4, "Sales", r, r, c, c, "cell", None, None) for r in (2, 3, 4) for c in (2, 3)] + [("Sales", 5, c, "Sales", 2, 4, c, c, "table_column", None, None) for c in (2, 4)]


@CATALOG.query(
    "workbook_edges",
    _values(
        {"sheet": "VARCHAR", "row": "INTEGER", "col": "INTEGER", "target_sheet": "VARCHAR", **_SPAN, "kind": "VARCHAR", "reference_text": "VARCHAR", "reason": "VARCHAR"},
        [("Calc", r, 1, *e, None, None) for r, e in _EDGES] + [("Calc", r, 1, *[None] * 6, t, why) for r, t, why in _GAPS] + _THIS_ROW,
    ),
)
def workbook_edges(spark, sf_dir):
    found = model.edges_of_cells(_cells(spark, sf_dir).where("sheet <> 'Tests'"), _facts(spark, sf_dir))
    return found.select("workbook_id", "sheet", "row", "col", "target_sheet", *_SPAN, "kind", "reference_text", "reason")


@CATALOG.query(
    "workbook_objects",
    _values({"sheet": "VARCHAR", "object_kind": "VARCHAR", "name": "VARCHAR", "anchor": "VARCHAR", "target_sheet": "VARCHAR", **_SPAN}, [("Sales", "chart", "chart1", "", "Sales", 2, 4, 2, 2), ("Inputs", "data_validation", "validation B4", "B4", "Sales", 2, 4, 1, 1)]),
)
def workbook_objects(spark, sf_dir):
    return model.objects(_facts(spark, sf_dir)).select("workbook_id", "sheet", "object_kind", "name", "anchor", "target_sheet", *_SPAN)


@CATALOG.query(
    "workbook_names",
    _values(
        {"name": "VARCHAR", "scope_sheet": "VARCHAR", "resolved": "BOOLEAN", "target_sheet": "VARCHAR", **_SPAN, "detail": "VARCHAR"},
        [("Local", "Calc", True, "Inputs", 2, 2, 2, 2, None), ("Rate", None, True, "Inputs", 1, 1, 2, 2, None), ("Loose", None, False, None, None, None, None, None, "not a static range")],
    ),
)
def workbook_names(spark, sf_dir):
    return model.names(_facts(spark, sf_dir)).select("workbook_id", "name", "scope_sheet", "resolved", "target_sheet", *_SPAN, "detail")


@CATALOG.query(
    "inspect_summary",
    _values(
        {"sheet": "VARCHAR", "is_macro": "BOOLEAN", "visibility": "VARCHAR", "n_cells": "BIGINT", "n_formulas": "BIGINT", "n_tables": "BIGINT", "n_names": "BIGINT", "n_arrays": "BIGINT", "n_objects": "BIGINT"},
        [("Sales", False, "visible", 19, 5, 1, 0, 0, 1), ("Inputs", False, "visible", 10, 0, 0, 0, 0, 1), ("Calc", False, "visible", len(CALC), sum(isinstance(c, tuple) for c in CALC), 0, 1, 1, 0), ("Mac", True, "visible", 0, 0, 0, 0, 0, 0), ("Tests", False, "visible", len(FUNCTIONS), len(FUNCTIONS), 0, 0, 0, 0)]
        + [(m, False, "hidden" if m == "Mar" else "visible", 1, 0, 0, 0, 0, 0) for m in ("Jan", "Feb", "Mar")],
    ),
)
def inspect_summary(spark, sf_dir):
    found = model.summary(_cells(spark, sf_dir), _facts(spark, sf_dir))
    return found.select("workbook_id", "sheet", "is_macro", "visibility", "n_cells", "n_formulas", "n_tables", "n_names", "n_arrays", "n_objects")


# ---- values --------------------------------------------------------------------------

#: The Sales and Inputs cells that the what-if query sets, and what follows: (sheet, row, col, status, kind, number, text, reason).
CHANGES = {"Inputs!B1": "50%", "inputs!B3": "2025-01-02", "'Inputs'!B4": "false", "Sales!B2": "10"}
_RESULT = {"sheet": "VARCHAR", "row": "INTEGER", "col": "INTEGER", "status": "VARCHAR", "kind": "VARCHAR", "num": "DOUBLE", "str": "VARCHAR", "reason": "VARCHAR"}
_AFTER = (
    [("Inputs", 1, 2, "changed", "number", 0.5, None, None), ("Inputs", 3, 2, "changed", "date", 45659.0, "2025-01-02T00:00:00", None), ("Inputs", 4, 2, "changed", "boolean", 0.0, "FALSE", None), ("Sales", 2, 2, "changed", "number", 10.0, None, None)]
    + [("Calc", r, 1, "recalculated", "number", v, None, None) for r, v in ((1, 50.0), (2, 19.0), (8, 20.0), (9, 8.0), (10, 10.0), (11, 38.0), (12, 2025.0), (13, 2.0), (17, 100.0), (18, 38.0), (19, 49.0), (21, 81.0))]
    + [("Calc", r, 1, "saved", "number", v, None, None) for r, v in ((3, 1.2), (5, 6.0), (6, 7.0), (7, 7.0), (15, 0.0), (16, 0.0), (20, 1.0))]
    + [("Calc", 14, 1, "saved", "error", None, "#DIV/0!", None), ("Calc", 22, 1, "saved", "error", None, "#REF!", None), ("Calc", 4, 1, "unknown", "unknown", None, None, "indirect (INDIRECT)")]
    + [("Sales", 2, 4, "recalculated", "number", 25.0, None, None), ("Sales", 3, 4, "saved", "number", 6.0, None, None), ("Sales", 4, 4, "saved", "number", 50.0, None, None), ("Sales", 5, 2, "recalculated", "number", 19.0, None, None), ("Sales", 5, 4, "recalculated", "number", 81.0, None, None)]
)


@CATALOG.query("whatif_values", _values(_RESULT, _AFTER))
def whatif_values(spark, sf_dir):
    """Changes go to each workbook by its own name: dates, logical values and percentages among them."""
    given = whatif.parse_changes(CHANGES, ["Sales", "Inputs"])
    books = [r.r_name + ".xlsx" for r in table(spark, sf_dir, "region").select("r_name").collect()]  # five
    changes = whatif.changes_frame(spark, {b: given for b in books})
    found = whatif.recalculate(_cells(spark, sf_dir).where("sheet <> 'Tests'"), changes, _facts(spark, sf_dir))
    return found.select("workbook_id", *_RESULT)


_UNKNOWN = [(4, "indirect (INDIRECT)"), (6, "external_link ([Other.xlsx]S!A1)"), (7, "macro_sheet (Mac!A1)"), (15, "a circular reference, or reads one"), (16, "a circular reference, or reads one"), (20, "function NOSUCH"), (22, "malformed (Nowhere!A1)")]
_REASONS = [("a circular reference, or reads one", 2), ("external_link", 1), ("function NOSUCH", 1), ("indirect", 1), ("macro_sheet", 1), ("malformed", 1)]


@CATALOG.query("check_saved", _values({"sheet": "VARCHAR", "row": "INTEGER", "differs": "BOOLEAN", "reason": "VARCHAR"}, [("Calc", r, False, why) for r, why in _UNKNOWN]))
def check_saved(spark, sf_dir):
    """Formulas that don't come to their saved value, or to none."""
    found = whatif.check_saved(_cells(spark, sf_dir), _facts(spark, sf_dir))
    return found.where("differs OR status = 'unknown'").select("workbook_id", "sheet", "row", "differs", "reason")


@CATALOG.query("unknown_reasons", "SELECT reason, CAST(n * r AS BIGINT) AS n FROM (VALUES " + ", ".join(f"({_sql(w)}, {n})" for w, n in _REASONS) + ") v(reason, n) CROSS JOIN (SELECT count(*) AS r FROM region)")
def unknown_reasons(spark, sf_dir):
    return whatif.unknown_reasons(whatif.check_saved(_cells(spark, sf_dir), _facts(spark, sf_dir)))


def _expected(k: int, value) -> tuple:
    if isinstance(value, bool):
        return (k, "boolean", float(value), str(value).upper())
    if isinstance(value, str):
        return (k, "error" if value.startswith("#") else "text", None, value)
    return (k, "number", value, None)


@CATALOG.query("formula_functions", _values({"row": "INTEGER", "kind": "VARCHAR", "num": "DOUBLE", "str": "VARCHAR"}, [_expected(k, v) for k, (_, v) in enumerate(FUNCTIONS, 1)]))
def formula_functions(spark, sf_dir):
    """Every function of the Tests sheet, evaluated anew. Numbers are rounded to nine places."""
    found = whatif.recalculate(_cells(spark, sf_dir), None, _facts(spark, sf_dir), everything=True).where("sheet = 'Tests'")
    return found.select("workbook_id", "row", "kind", F.round("num", 9).alias("num"), "str")


# ---- documents -----------------------------------------------------------------------


def _documents(spark, sf_dir):
    cells = _cells(spark, sf_dir).where("sheet <> 'Tests'")
    return cells, regions.regions(cells).withColumn("version", F.lit(1)), _facts(spark, sf_dir).where("sheet IS NULL OR sheet <> 'Tests'")


def _without_book(name: str):
    return F.regexp_replace(name, r"^[^:]*:v1:", "").alias(name)


_NODE = {"node_id": "VARCHAR", "node_type": "VARCHAR", "a1_range": "VARCHAR", "parent_id": "VARCHAR", "formula": "VARCHAR", "display_value": "VARCHAR", "table_name": "VARCHAR", "column_name": "VARCHAR", "reads": "VARCHAR", "gaps": "VARCHAR", "n_children": "INTEGER"}
_CHUNK = {"chunk_type": "VARCHAR", "node_id": "VARCHAR", "a1_range": "VARCHAR", "title": "VARCHAR", "content": "VARCHAR"}


@CATALOG.query("build_structure", _values(_NODE, expected.NODES))
def build_structure(spark, sf_dir):
    nodes = structure.structure(*_documents(spark, sf_dir))
    reads = F.array_join(F.transform("references", lambda r: F.concat(r["sheet"], F.lit("!"), r["a1"], F.lit(" "), r["kind"])), ", ").alias("reads")
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat(g["text"], F.lit(" "), g["reason"])), ", ").alias("gaps")
    own = F.when(F.col("node_type") == "workbook", "workbook").otherwise(F.regexp_replace("node_id", r"^[^:]*:v1:", "")).alias("node_id")
    parent = F.when(F.contains("parent_id", F.lit(":workbook:")), "workbook").otherwise(F.regexp_replace("parent_id", r"^[^:]*:v1:", "")).alias("parent_id")
    return nodes.select("workbook_id", own, "node_type", "a1_range", parent, "formula", "display_value", "table_name", "column_name", reads, gaps, F.size("child_ids").alias("n_children"))


@CATALOG.query("build_chunks", _values(_CHUNK, expected.CHUNKS))
def build_chunks(spark, sf_dir):
    """The chunks of each workbook but the one of the workbook itself, whose text names it."""
    found = documents.chunks(*_documents(spark, sf_dir)).where("chunk_type <> 'workbook'")
    return found.select("workbook_id", "chunk_type", _without_book("node_id"), "a1_range", "title", "content")


@CATALOG.query("render_workbook", _values({"detail": "VARCHAR", "complete": "BOOLEAN", "line": "INTEGER", "text": "VARCHAR"}, expected.LINES))
def render_workbook(spark, sf_dir):
    """A small budget: schemas without rows. Line by line, without the first, which names the workbook."""
    cells, _, facts = _documents(spark, sf_dir)
    shown = render.workbook_text(cells, facts, 620)
    lines = shown.select("workbook_id", "detail", "complete", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.where("line > 0")


@CATALOG.query("render_clipped", _values({"detail": "VARCHAR", "complete": "BOOLEAN", "n_lines": "INTEGER", "last": "VARCHAR"}, [("clipped", False, 4, "(Rendering clipped to the token budget.)")]))
def render_clipped(spark, sf_dir):
    """A budget that not even the overview fits: cut at a line's end."""
    cells, _, facts = _documents(spark, sf_dir)
    shown = render.workbook_text(cells, facts, 60)
    lines = F.split("text", "\n", -1)
    return shown.select("workbook_id", "detail", "complete", F.size(lines).alias("n_lines"), lines[F.size(lines) - 2].alias("last"))


# ---- reading --------------------------------------------------------------------------


@CATALOG.query(
    "saved_values",
    _values(
        {"row": "INTEGER", "kind": "VARCHAR", "num": "DOUBLE", "str": "VARCHAR", "ts": "TIMESTAMP", "display": "VARCHAR", "is_percentage": "BOOLEAN"},
        [(1, "number", 0.1, None, None, "0.1", True), (2, "number", 0.2, None, None, "0.2", False), (3, "date", None, None, "2024-05-01 00:00:00", "2024-05-01 00:00:00", False), (4, "boolean", 1.0, None, None, "TRUE", False), (5, "error", None, "#DIV/0!", None, "#DIV/0!", False)],
    ),
)
def saved_values(spark, sf_dir):
    """Numbers, dates, logical values and errors as they were saved."""
    found = _cells(spark, sf_dir).where("sheet = 'Inputs' AND col = 2")
    return found.select("workbook_id", "row", "kind", "num", "str", "ts", "display", "is_percentage")


_TEXT = "\ufeffid;Región;Importe;Activo;Nota\n007;Norte;1200,5;TRUE;\"a;b\"\n8;Sur;980;false;\n9;Este;1.5e3;x;3/4\n"


@CATALOG.query(
    "csv_cells",
    _values(
        {"row": "INTEGER", "col": "INTEGER", "kind": "VARCHAR", "num": "DOUBLE", "str": "VARCHAR"},
        [(1, c, "text", None, v) for c, v in enumerate(("id", "Región", "Importe", "Activo", "Nota"), 1)]
        + [(2, 1, "text", None, "007"), (2, 2, "text", None, "Norte"), (2, 3, "number", 1200.5, None), (2, 4, "boolean", 1.0, None), (2, 5, "text", None, "a;b"), (3, 1, "number", 8.0, None), (3, 2, "text", None, "Sur"), (3, 3, "number", 980.0, None), (3, 4, "boolean", 0.0, None)]
        + [(4, 1, "number", 9.0, None), (4, 2, "text", None, "Este"), (4, 3, "number", 1500.0, None), (4, 4, "text", None, "x"), (4, 5, "text", None, "3/4")],
    ).replace(".xlsx'", ".csv'"),
)
def csv_cells(spark, sf_dir):
    """Delimited text with a byte order mark, decimal commas, quotes, leading zeros and an empty field."""
    files = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".csv")).alias("path"), F.encode(F.lit(_TEXT), "UTF-8").alias("content"))
    cells = cells_frame(files.select("path", F.sha2("content", 256).alias("sha256"), "content"))
    return cells.select(F.col("path").alias("workbook_id"), "row", "col", "kind", "num", "str")


_BLOCKS = [["Revenue", "Cost"], ["USD", "usd."], [1.0, 2.0], [3.0, 4.0], ["Notebook", 5.0], ["Sources: ledger", None], [], ["Legend"], ["All amounts are rounded."]]


@CATALOG.query(
    "detect_notes",
    _values({"kind": "VARCHAR", "a1": "VARCHAR", "n_rows": "INTEGER", "headers": "VARCHAR", "units": "VARCHAR"}, [("table", "A1:B5", 3, "Revenue, Cost", "USD, usd."), ("notes", "A6:B6", 1, "", ""), ("notes", "A8:B9", 2, "", "")]),
)
def detect_notes(spark, sf_dir):
    """A units row, a data row that only begins like a note, a note under the table, a block of notes."""
    content = workbook({"S": _BLOCKS})
    files = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".xlsx")).alias("path"), F.lit(content).cast("binary").alias("content"))
    cells = cells_frame(files.select("path", F.sha2("content", 256).alias("sha256"), "content")).withColumn("workbook_id", F.col("path"))
    return regions.regions(cells).select("workbook_id", "kind", "a1", "n_rows", F.array_join("headers", ", ").alias("headers"), F.array_join("units", ", ").alias("units"))


# ---- questions about a model --------------------------------------------------------------


@CATALOG.query("range_read", _values({"row": "INTEGER", "col": "INTEGER", "display": "VARCHAR", "next_row": "INTEGER"}, [(2, 2, "3", None), (2, 3, "2.5", None), (3, 2, "4", None), (3, 3, "1.5", None)]))
def range_read(spark, sf_dir):
    return render.read_range(_cells(spark, sf_dir).where("sheet = 'Sales'"), 2, 3, 2, 3).select("workbook_id", "row", "col", "display", "next_row")


@CATALOG.query(
    "range_readers",
    _values({"kind": "VARCHAR", "sheet": "VARCHAR", "at": "VARCHAR"}, [("formula", "Sales", "D3"), ("formula", "Sales", "B5"), ("formula", "Calc", "A2"), ("formula", "Calc", "A8"), ("formula", "Calc", "A18"), ("formula", "Calc", "A19"), ("chart", "Sales", "chart1")]),
)
def range_readers(spark, sf_dir):
    """Who reads Sales!B3: formulas by name, table, column, row and range, and a chart."""
    return session.readers(_cells(spark, sf_dir).where("sheet <> 'Tests'"), _facts(spark, sf_dir), "Sales", (3, 3, 2, 2))


@CATALOG.query(
    "range_reads",
    _values(
        {"row": "INTEGER", "target_sheet": "VARCHAR", "n_cells": "BIGINT", "first_display": "VARCHAR"},
        [(1, "Inputs", 1, "0.1"), (2, "Sales", 3, "3"), (3, "Inputs", 1, "0.2"), (5, "Jan", 1, "1"), (5, "Feb", 1, "2"), (5, "Mar", 1, "3")],
    ),
)
def range_reads(spark, sf_dir):
    """What Calc!A1:A5 reads, with the first value of each."""
    return session.reads(_cells(spark, sf_dir), _facts(spark, sf_dir), "Calc", (1, 5, 1, 1)).select("workbook_id", "row", "target_sheet", "n_cells", "first_display")


@CATALOG.query("find_everywhere", "SELECT r_name || '.xlsx' AS workbook_id, v.place, CAST(3 * c AS BIGINT) AS total FROM region CROSS JOIN (SELECT count(*) AS c FROM region) CROSS JOIN (VALUES ('Inputs!A1'), ('Calc!A1'), ('Rate')) v(place)")
def find_everywhere(spark, sf_dir):
    """Cells and defined names that hold `RATE` in any case: a label, a formula, a name."""
    cells = _cells(spark, sf_dir).where("sheet IN ('Inputs', 'Calc')")
    return session.find_everywhere(cells, model.names(_facts(spark, sf_dir)).where("name <> 'Loose'"), "rate").select("workbook_id", "place", "total")


@CATALOG.query(
    "diff_reads",
    """WITH o AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS target FROM lineitem WHERE l_linenumber < 4), n AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS target FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5),
    a AS (SELECT * FROM o WHERE k IN (SELECT k FROM n)), b AS (SELECT * FROM n WHERE k IN (SELECT k FROM o))
    SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def diff_reads(spark, sf_dir):
    from quartzgrid.operators import diff

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("target"), "l_linenumber")
    return diff.reads_changed(lines.where("l_linenumber < 4").drop("l_linenumber"), lines.where("l_linenumber BETWEEN 2 AND 5").drop("l_linenumber"), ["k"])


# ---- evaluation --------------------------------------------------------------------------

#: The best five chunks of this corpus for each question, and whether they cite what the case expects: (case, first relevant rank).
_CHUNKS = [
    ("wb", "wb:v1:region:s!a1", "S", "A1:B9", "Tax table", "rate by year", ["Year"]), ("wb", "wb:v1:region:s!d1", "S", "D1:E9", "Staff", "people and pay", ["Name"]), ("wb", "wb:v1:sheet:s", "S", "A1:Z99", "Sheet S", "tax staff rate", []),
    ("wb", "wb:v1:region:t!a1", "T", "A1:B9", "Tax other", "rate", []), ("other", "other:v1:region:s!a1", "S", "A1:B9", "Tax table", "rate by year", ["Year"]),
]
_CASES = [("tax", "Which tax rate?", "wb", [("S", "B2:B3")]), ("staff", "How many people?", "wb", [("S", "E5"), ("T", "A1")]), ("none", "Unheard words", "wb", [("S", "A1")])]


@CATALOG.query("evaluation_run", "SELECT * FROM (VALUES ('tax', 1, 1, 1), ('staff', 2, 1, 1), ('none', 1, NULL, 0)) v(case_id, n_expected, first_rank, covered_5)")
def evaluation_run(spark, sf_dir):
    """All cases in one plan: hits of the case's workbook only; a sheet's summary cites nothing; half of what `staff` expects is found."""
    chunks = spark.createDataFrame(_CHUNKS, "workbook_id string, node_id string, sheet_name string, a1_range string, title string, content string, headers array<string>")
    cases = spark.createDataFrame(_CASES, f"case_id string, question string, workbook_id string, expected {evaluate.EXPECTED}")
    _, results = evaluate.run(cases, evaluate.lexical_hits(cases, chunks, 5), [5])
    return results.select("case_id", F.col("n_expected").cast("int").alias("n_expected"), "first_rank", F.col("covered_5").cast("int").alias("covered_5"))
