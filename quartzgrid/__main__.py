"""python -m quartzgrid inspect|render|calc|check|index|questions PATH ...: the engine at the command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quartzgrid import reports
from quartzgrid.functions.a1 import column_letter
from quartzgrid.operators import ingest, model, render, whatif
from quartzgrid.sources.workbook import cells_frame, facts_frame, workbook_files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quartzgrid", description="Workbooks as tables: inspect, render, recalculate, index.")
    commands = out.add_subparsers(dest="command", required=True)
    for name, text in (("inspect", "numbers of each sheet"), ("render", "a workbook as text"), ("calc", "set cells and recalculate"), ("check", "recalculate everything against saved values"), ("index", "write chunks and structure to a store"), ("questions", "questions with known answers, as JSON lines")):
        own = commands.add_parser(name, help=text)
        own.add_argument("path")
        if name == "render":
            own.add_argument("--budget", type=int, default=8000)
        if name == "calc":
            own.add_argument("--set", action="append", default=[], metavar="Sheet!A1=value")
        if name == "index":
            own.add_argument("--store", required=True)
            own.add_argument("--version", type=int, default=1)
            own.add_argument("--scope", action="append", default=[])
    return out


def main(arguments: list[str], spark: SparkSession | None = None) -> str:
    """The text that the command prints."""
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quartzgrid").getOrCreate()
    files = workbook_files(spark, given.path)
    name = F.regexp_replace("path", r"^.*/", "")
    cells, facts = ingest.cells_of_files(cells_frame(files), name), facts_frame(files).withColumn("workbook_id", name)
    a1 = F.concat(column_letter(F.col("col")), "row")
    if given.command == "inspect":
        return reports.as_markdown(model.summary(cells, facts).orderBy("workbook_id", "sheet_ix").collect(), "Sheets")
    if given.command == "render":
        return "\n".join(r.text for r in render.workbook_text(cells, facts, given.budget).orderBy("workbook_id").collect())
    if given.command == "questions":
        return reports.as_json(render.mine_cases(cells).collect())
    if given.command == "calc":
        pairs = dict(x.rsplit("=", 1) for x in getattr(given, "set"))
        sheets = [r.sheet for r in facts.where("fact = 'sheet'").select("sheet").distinct().collect()]
        books = [r.workbook_id for r in facts.select("workbook_id").distinct().collect()]
        changed = whatif.parse_changes(pairs, sheets)
        out = whatif.recalculate(cells, whatif.changes_frame(spark, dict.fromkeys(books, changed)), facts)
        return reports.calculation(out.where("status <> 'saved'").withColumn("a1", a1).orderBy("workbook_id", "sheet", "row", "col").collect())
    if given.command == "check":
        found = whatif.check_saved(cells, facts).cache()
        return reports.check(whatif.checked(found).orderBy("workbook_id").collect(), whatif.unknown_reasons(found).collect(), found.where("differs").withColumn("a1", a1).orderBy("sheet", "row", "col").collect())
    written = ingest.index(spark, given.store, cells, facts, given.version, given.scope)
    return "\n".join(f"{book}: {n} documents" for book, n in sorted(written.items()))


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    print(main(sys.argv[1:]))
