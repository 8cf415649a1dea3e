"""Reading files, regions, documents, rendering."""

import struct
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quartzgrid.operators import regions, render
from quartzgrid.sources.workbook import WorkbookError, moved, read_cells, read_delimited, read_ooxml, records, sheet_name
from quartzgrid.sources.write_xlsx import workbook


def grid(rows, merged=()):
    cells = {}
    for r, row in enumerate(rows, 1):
        for c, v in enumerate(row, 1):
            if v is not None:
                cells[r, c] = ("text" if isinstance(v, str) else "number", v)
    return regions.detect(cells, list(merged))


def test_two_tables_on_one_sheet():
    found = grid([["Quarterly Report", None, None], [], ["Region", "Q1", "Q2"], ["North", 1, 2], ["South", 3, 4], [], ["Product", "Units"], ["A", 5], ["B", 6]], ["A1:C1"])
    assert [(r.kind, r.a1) for r in found] == [("title", "A1:C1"), ("table", "A3:C5"), ("table", "A7:C9")]
    assert found[1].headers == ["Region", "Q1", "Q2"] and found[2].headers == ["Product", "Units"]


def test_merged_headers_name_their_columns():
    found = grid([["Sales", None, "Costs", None], ["Q1", "Q2", "Q1", "Q2"], [1, 2, 3, 4], [5, 6, 7, 8]], ["A1:B1", "C1:D1"])
    assert found[-1].header_rows == (1, 2) and found[-1].headers == ["Sales / Q1", "Sales / Q2", "Costs / Q1", "Costs / Q2"]


def test_units_and_notes():
    found = grid([["Revenue", "Cost"], ["USD", "USD"], [1, 2], [3, 4], [], [], ["Notes:"], ["Revenue is reported in constant currency."]])
    assert [(r.kind, r.n_rows) for r in found] == [("table", 2), ("notes", 2)] and found[0].units == ["USD", "USD"]


def test_delimited_text():
    book = read_delimited("﻿id;Región;Importe;Activo;Nota\n007;Norte;1200,5;TRUE;=SUM(A1:A3)\n8;Sur;980;false;\n9;Este;1.5e3;TRUE;3/4\n".encode(), "dir/q[1]:2.csv")
    cells = {(c.row, c.col): (c.kind, c.value) for c in book.sheets[0].cells}
    assert book.sheets[0].name == "q_1__2" and cells[2, 1] == ("text", "007") and cells[2, 3] == ("number", 1200.5) and cells[4, 3] == ("number", 1500.0)
    assert (3, 5) not in cells and cells[2, 5] == ("text", "=SUM(A1:A3)") and cells[4, 5] == ("text", "3/4") and cells[3, 4] == ("boolean", False)
    assert {(c.row, c.col): c.value for c in read_delimited(b'a,b\n"2,5",1', "x.csv").sheets[0].cells}[2, 1] == "2,5"
    assert sheet_name("") == "Sheet1" and len(sheet_name("x" * 40)) == 31


def test_ooxml():
    book = read_ooxml(workbook({"Data": [["a", 1.5, True, "#DIV/0!", ("=B1*2", 3)]], "Other": [[None, "x & y"]]}, {"Data": ["A1:B1"]}, {"Rate": "Data!$B$1"}))
    assert [(c.kind, c.value, c.formula) for c in book.sheets[0].cells] == [("text", "a", None), ("number", 1.5, None), ("boolean", True, None), ("error", "#DIV/0!", None), ("number", 3.0, "=B1*2")]
    assert book.names == {(None, "Rate"): "Data!$B$1"} and book.sheets[0].merged == ["A1:B1"] and book.sheets[1].cells[0].value == "x & y"


def test_hostile_files_are_refused():
    for data in (b"no workbook", b""):
        with pytest.raises(WorkbookError):
            read_ooxml(data)
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("xl/workbook.xml", '<!DOCTYPE x [<!ENTITY a "b">]><workbook>&a;</workbook>')
    with pytest.raises(WorkbookError):
        read_ooxml(out.getvalue())


def test_binary_records():
    body = struct.pack("<I", 3)
    assert list(records(bytes([0x00, 4]) + body + bytes([0x9C, 0x03, 0]))) == [(0, body), (0x19C | 0x200 if False else 0x39C, b"")]


def test_filled_formulas_follow():
    assert moved("A1*$B$2+SUM(C$1:D4)", 2, 1) == "B3*$B$2+SUM(D$1:E6)" and moved("A1", -1, 0) == "#REF!"


def test_files_to_cells_to_text(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"Data": [["Item", "Value"]] + [[f"row {k}", k] for k in range(100)] + [["Sum", ("=SUM(B2:B101)", 4950)]]}))
    (tmp_path / "b.csv").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "bad.xlsx").write_bytes(b"broken")
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    cells = read_cells(spark, str(tmp_path)).cache()
    assert {(r.path.rsplit("/", 1)[1], r["count"]) for r in cells.where("error IS NULL").groupBy("path").count().collect()} == {("a.xlsx", 204), ("b.csv", 4)}
    assert cells.where("error IS NOT NULL").count() == 1
    shown = cells.where("error IS NULL").select(F.col("path").alias("workbook_id"), "sheet", "row", "col", "kind", "formula", F.coalesce("str", F.col("num").cast("string")).alias("display"))
    text = {r.workbook_id.rsplit("/", 1)[1]: r for r in render.render(shown, ["workbook_id", "sheet"], 200).collect()}
    assert len(text["a.xlsx"].text) <= 600 and "rows omitted" in text["a.xlsx"].text and text["b.csv"].rung == 0
    asked = {r.question: r.a1 for r in render.mine_cases(shown).collect()}
    assert asked["How is Sum calculated?"] == "B102" and asked["What is the row 7?"] == "B9"


def test_objects_of_a_sheet():
    from quartzgrid.formulas.references import Context
    from quartzgrid.sources.objects import object_edges, sheet_objects
    from quartzgrid.sources.workbook import Package

    rel = lambda *targets: "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{t}"/>' for k, t in enumerate(targets)) + "</Relationships>"
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("xl/worksheets/sheet1.xml", '<worksheet><dataValidations><dataValidation type="list" sqref="C2:C5"><formula1>Data!$A$2:$A$5</formula1></dataValidation><dataValidation sqref="E2"><formula1>"a,b"</formula1></dataValidation></dataValidations></worksheet>')
        package.writestr("xl/worksheets/_rels/sheet1.xml.rels", rel("../drawings/d.xml", "../pivotTables/p.xml", "../pivotTables/q.xml"))
        package.writestr("xl/drawings/_rels/d.xml.rels", rel("../charts/chart1.xml"))
        package.writestr("xl/charts/chart1.xml", '<c:chart xmlns:c="x"><c:ser><c:tx><c:f>Data!$B$1</c:f></c:tx><c:val><c:f>Data!$B$2:$B$5</c:f></c:val></c:ser></c:chart>')
        package.writestr("xl/pivotTables/p.xml", '<pivotTableDefinition name="P"><location ref="A3:B9"/></pivotTableDefinition>')
        package.writestr("xl/pivotTables/_rels/p.xml.rels", rel("../pivotCache/c.xml"))
        package.writestr("xl/pivotCache/c.xml", '<d><cacheSource type="worksheet"><worksheetSource ref="A1:B5" sheet="Data"/></cacheSource></d>')
        package.writestr("xl/pivotTables/q.xml", '<pivotTableDefinition name="Q"><location ref="D3"/></pivotTableDefinition>')
    found, warnings = sheet_objects(Package(out.getvalue()), "xl/worksheets/sheet1.xml")
    context = Context(sheet="Data", sheets=["Data"])
    read = {o.key: ([(e.row_lo, e.row_hi, e.col_lo, e.col_hi) for e in object_edges(o, context)[0]], [g.reason for g in object_edges(o, context)[1]]) for o in found}
    assert not warnings and read == {"chart1": ([(1, 1, 2, 2), (2, 5, 2, 2)], []), "P": ([(1, 5, 1, 2)], []), "Q": ([], ["external_link"]), "validation C2:C5": ([(2, 5, 1, 1)], [])}


def test_catalogue_and_sandbox(spark, tmp_path):
    from quartzgrid.sources.catalogue import resolved, workbooks

    for name in ("b.xlsx", "a.csv", "~$b.xlsx", "note.md"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in workbooks(spark, str(tmp_path)).collect()] == ["a.csv", "b.xlsx"]
    assert resolved(str(tmp_path / "a.csv"), [str(tmp_path)])
    with pytest.raises(PermissionError):
        resolved(str(tmp_path / ".." / "x"), [str(tmp_path)])


def test_questions_about_cells(spark):
    from quartzgrid.operators import formulas, session

    cells = spark.createDataFrame([("S", 1, 1, "Rate", None), ("S", 1, 2, "5", None), ("S", 2, 2, "10", "=B1*2"), ("S", 3, 2, "15", "=SUM(B1:B2)")], "sheet string, row int, col int, display string, formula string")
    edges = formulas.edges(cells.where("formula IS NOT NULL").select("sheet", "formula"), ["S"]).cache()
    assert [(r.row, r.total) for r in session.find(cells, "rate").collect()] == [(1, 1)]
    assert [r.row for r in session.dependents(cells, edges, "S", (1, 1, 2, 2)).collect()] == [2, 3]
    assert {(r.row, r.row_lo, r.row_hi) for r in session.precedents(cells.where("formula IS NOT NULL"), edges, "S", (2, 3, 1, 9)).collect()} == {(2, 1, 1), (3, 1, 2)}
    changes = spark.createDataFrame([(7, "S", 2, 2)], "change_id int, sheet string, row int, col int")
    assert [(r.change_id, r.formula) for r in session.readers_of_changes(changes, edges).collect()] == [(7, "=SUM(B1:B2)")]
    assert [(r.pattern, r.n_cells) for r in formulas.clusters(cells).orderBy("pattern").collect()] == [("=B#*2", 1), ("=SUM(B#:B#)", 1)]
