"""Workbooks as models: facts, what-if inputs, structure, rendering, ingestion, evaluation, reports, the command line."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quartzgrid import reports
from quartzgrid.__main__ import main
from quartzgrid.formulas.evaluator import Error
from quartzgrid.operators import evaluate, ingest, render, whatif
from quartzgrid.operators.store import TableStore, VersionedStore
from quartzgrid.sources import sample
from quartzgrid.sources.workbook import WorkbookError, cells_of, facts_of, read_delimited, read_ooxml
from quartzgrid.sources.write_xlsx import workbook


def test_facts_of_a_package():
    book = workbook({"A": [["x", 1]], "B": [[2]]}, names={"N": "A!$B$1", ("B", "L"): "A!$B$1"}, hidden={"B"}, macro_sheets=["M"], dimensions={"A": "A1:XFD1048576"}, merged={"A": ["A1:B1"]})
    found = [(r[2], r[3], r[5], r[6]) for r in facts_of("p", "d", book)]
    assert ("macro_sheet", "M", "M", "") in found and ("name", "B", "L", "A!$B$1") in found and ("merged", "A", None, "A1:B1") in found and found[-1][0] == "macros" or ("warning", None, None, None) in found
    assert read_ooxml(book).sheets[0].dimension_is_false and not read_ooxml(book).sheets[1].dimension_is_false
    assert [r[2] for r in facts_of("p.xlsx", "d", b"broken")] == ["error"]


def test_broken_files_are_rows_with_their_error():
    for data in (b"PK\x03\x04 broken", b""):
        rows = list(cells_of("a.xlsx", "d", data))
        assert len(rows) == 1 and rows[0][-1]
    assert len(list(cells_of("a.csv", "d", b'a,"' + b"x" * 200_000))[1][8]) == 200_000  # longer than the module's own limit
    with pytest.raises(WorkbookError):
        read_delimited(b",".join(b"x" for _ in range(16_385)), "wide.csv")
    quoted = read_delimited(b'"a;b;c;d",1\n"e;f;g;h",2\n', "q.csv").sheets[0].cells
    assert (quoted[0].value, quoted[1].value) == ("a;b;c;d", 1.0)


def test_what_users_write():
    assert whatif.parse_target("'my sheet'!$B$2:C4", ["My Sheet"]) == ("My Sheet", (2, 4, 2, 3))
    assert [whatif.typed(x) for x in ("7%", "1,200", "true", "#n/a", "", "2024-05-01", "text", 5)] == [0.07, 1200.0, True, Error("#N/A"), None, datetime(2024, 5, 1), "text", 5]
    for bad in ({"B2": "1"}, {"No!B2": "1"}, {"S!A1:A2": "1"}, {"S!A1": "=1"}):
        with pytest.raises(whatif.InputError):
            whatif.parse_changes(bad, ["S"])


def test_changes_of_one_workbook_leave_others_alone(spark, tmp_path):
    from quartzgrid.sources.workbook import cells_frame, facts_frame, workbook_files

    for name in ("a", "b"):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook({"S": [[2, ("=A1*Factor", 6.0)], [None, ("=C1+1", 1.0)]]}, names={"Factor": "S!$A$3"} if name == "a" else {"Factor": "S!$A$4"}))
    files = workbook_files(spark, str(tmp_path))
    book = F.regexp_replace("path", r"^.*/|\.xlsx$", "")
    cells, facts = ingest.cells_of_files(cells_frame(files), book), facts_frame(files).withColumn("workbook_id", book)
    changes = whatif.changes_frame(spark, {"a": {("S", 3, 1): 10.0, ("S", 1, 3): 5.0}})
    got = {(r.workbook_id, r.row, r.col): (r.status, r.num) for r in whatif.recalculate(cells, changes, facts).collect()}
    assert got["a", 1, 2] == ("recalculated", 20.0) and got["a", 2, 2] == ("recalculated", 6.0) and got["b", 1, 2] == ("saved", 6.0) and got["b", 2, 2] == ("saved", 1.0)


def test_rendering_pins_headers_and_lists_loose_cells():
    number = lambda v: {"kind": "number", "num": float(v), "str": None, "ts": None, "formula": None, "is_percentage": False}
    label = lambda v: number(0) | {"kind": "text", "str": v}
    cells = {(1, 1): label("Item"), (1, 2): label("Share")} | {(r, 1): label(f"row | {r}") for r in range(2, 60)} | {(r, 2): number(r / 7) | {"is_percentage": True} for r in range(2, 60)}
    region = render.Region("table", 1, 59, 1, 2, headers=["Item", "Share"], units=["", ""], types=["text", "number"], header_rows=(1,), cols=[1, 2])
    sheet = render._Sheet("S", cells | {(70, 5): number(3)}, [region], [], [], "visible", False)
    detail, tokens, complete, text = render.rendered("wb", [sheet], {"names": [], "warnings": [], "macros": False}, 400)
    assert detail == "rows-8" and not complete and tokens <= 400
    assert "| 1 | Item | Share |" in text and "rows 10-56 omitted (47 rows with data)" in text and "| 59 | row \\| 59 | 842.857142857% |" in text and "Other cells: E70 = 3" in text
    clipped = render.clip("one\ntwo\nthree" * 40, 30)
    assert clipped.startswith("one\n") and clipped.endswith("(Rendering clipped to the token budget.)\n") and render.count_tokens(clipped) <= 30
    with pytest.raises(ValueError):
        render.rendered("wb", [sheet], {"names": [], "warnings": [], "macros": False}, 10)


def test_ingestion_evaluation_and_command_line(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "planning.xlsx").write_bytes(sample.planning_workbook())
    text = main(["inspect", str(folder)], spark)
    assert "| planning.xlsx | Assumptions |" in text or "Assumptions" in text and "Headcount" in text
    assert "Revenue forecast 2027" in main(["render", str(folder)], spark)
    assert "0 different, 0 unknown" in main(["check", str(folder)], spark)
    assert "Forecast!B4" in main(["calc", str(folder), "--set", "Assumptions!B4=7%"], spark)
    written = main(["index", str(folder), "--store", str(tmp_path / "store"), "--scope", "finance"], spark)
    assert written.startswith("planning.xlsx: ")
    chunks = VersionedStore(spark, str(tmp_path / "store")).read("chunks").withColumn("workbook_id", F.lit(sample.PLANNING))
    assert chunks.where("acl_scope[0] = 'finance' AND size(embedding) = 768").count() == chunks.count() > 20
    cases = sample.cases(spark)
    hits = evaluate.lexical_hits(cases, chunks, 10)
    measured, results = evaluate.run(cases, hits, [1, 5, 10])
    row = measured.first()
    assert row.n_cases == 16 and row.hit_5 >= 0.5 and results.where("first_rank IS NULL").count() < 8
    assert "hit_5" in evaluate.report({"lexical": {k: v for k, v in row.asDict().items()}}, {"lexical": ["payroll"]})
    evaluate.save_cases(cases, str(tmp_path / "cases"))
    assert evaluate.read_cases(spark, str(tmp_path / "cases")).count() == 16
    (tmp_path / "bad.jsonl").write_text('# comment\n\n{"question": "q", "workbook_id": "w", "expected": []}\n')
    with pytest.raises(evaluate.CaseFileError):
        evaluate.read_cases(spark, str(tmp_path / "bad.jsonl"))


def test_bench_corpus_is_the_same_each_time(spark):
    made = sample.bench_corpus(spark, 1, 2, 20, 5)
    assert {k: df.count() for k, df in made.items()} == {"chunks": 10, "structure": 40, "edges": 16}
    assert sorted(map(str, made["chunks"].collect())) == sorted(map(str, sample.bench_corpus(spark, 1, 2, 20, 5)["chunks"].collect()))


def test_table_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.ensure("t", "id string, n int")
    store.ensure("t", "id string, n int")
    store.bulk("t", spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, n int"))
    store.put("t", {"id": "a", "n": 9})
    assert store.get("t", "a") == {"id": "a", "n": 9} and store.get("t", "z") is None and store.count("t") == 3 and store.count("t", F.col("n") > 5) == 1
    assert [r.id for r in store.mget("t", ["c", "z", "a"]).collect()] == ["c", "a"] and [r.id for r in store.search("t", F.col("n") > 0, 1, ["id"]).collect()] == ["a"]
    assert store.delete("t", F.col("n") < 5) == 1 and sorted(r.id for r in store.table("t").collect()) == ["a", "c"]
    store.drop("t")
    assert not store.exists("t")


def test_reports(spark):
    rows = spark.createDataFrame([(1, "a|b", float("nan")), (2, None, 1.5)], "n int, s string, x double").collect()
    assert json.loads(reports.as_json(rows)) == [{"n": 1, "s": "a|b", "x": None}, {"n": 2, "s": None, "x": 1.5}]
    assert "| 1 | a\\|b |  |" in reports.as_markdown(rows, "T") and reports.as_markdown([]) == "(nothing)"
