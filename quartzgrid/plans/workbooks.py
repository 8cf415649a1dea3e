"""Queries over workbooks generated from the driver's tables, and over events as a stream's batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzgrid.catalog import Catalog, table
from quartzgrid.functions.embed import hash_embedder
from quartzgrid.operators import regions, render, structure, whatif
from quartzgrid.sources.workbook import cells_frame, facts_frame
from quartzgrid.sources.write_xlsx import workbook
from quartzgrid.streaming import events as streams

CATALOG = Catalog()


@CATALOG.query("hash_embed")
def hash_embed(spark, sf_dir):
    embed = hash_embedder(64)
    return table(spark, sf_dir, "documents").select("doc_id", embed("text").alias("embedding"))


def _files(spark, sf_dir):
    """A workbook for each region: its nations, a formula a row, a total."""
    import pandas as pd

    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n_nationkey")
        rows = [["Nation", "Key", "Twice"]] + [[n, int(k), (f"=B{r}*2", 2 * int(k))] for r, (n, k) in enumerate(zip(frame["n_name"], frame["n_nationkey"]), 2)]
        rows.append(["Total", (f"=SUM(B2:B{len(rows)})", int(frame["n_nationkey"].sum())), (f"=B{len(rows) + 1}*Rate", int(frame["n_nationkey"].sum()) * 2)])
        return pd.DataFrame({"path": [f"{frame['r_name'].iloc[0]}.xlsx"], "content": [workbook({"Data": rows}, names={"Rate": "Data!$E$1"})]})

    files = nations.groupBy("r_regionkey").applyInPandas(build, "path string, content binary")
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content")


def _cells(spark, sf_dir):
    cells = cells_frame(_files(spark, sf_dir))
    return cells.select("*", F.col("path").alias("workbook_id"), F.lit(1).alias("version"), structure.shown().alias("display"))


_NATIONS = "SELECT r_name || '.xlsx' AS workbook_id, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) + 1 AS r FROM nation JOIN region ON n_regionkey = r_regionkey"


@CATALOG.query("read_workbook", f"SELECT workbook_id, count(*) * 3 + 6 AS n_cells, count(*) + 2 AS n_formulas, CAST(sum(n_nationkey) * 5 + sum(n_nationkey) AS DOUBLE) AS total FROM ({_NATIONS}) GROUP BY workbook_id")
def read_workbook(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("workbook_id").agg(F.count("*").alias("n_cells"), F.count("formula").alias("n_formulas"), F.sum("num").alias("total"))


@CATALOG.query("detect_regions", f"SELECT workbook_id, 'table' AS kind, 'A1:C' || (count(*) + 2) AS a1, 'Nation, Key, Twice' AS headers, 'text, mixed, formula' AS types FROM ({_NATIONS}) GROUP BY workbook_id")
def detect_regions(spark, sf_dir):
    found = regions.regions(_cells(spark, sf_dir))
    return found.select("workbook_id", "kind", "a1", F.array_join("headers", ", ").alias("headers"), F.array_join("types", ", ").alias("types"))


@CATALOG.query(
    "calc_graph_eval",
    f"""SELECT workbook_id, r AS "row", 3 AS col, CASE WHEN r = 2 THEN 'recalculated' ELSE 'saved' END AS status, CAST(CASE WHEN r = 2 THEN 200 ELSE n_nationkey * 2 END AS DOUBLE) AS num FROM ({_NATIONS})
    UNION ALL SELECT workbook_id, 2, 2, 'changed', 100 FROM ({_NATIONS}) WHERE r = 2 UNION ALL SELECT workbook_id, max(r) + 1, 2, 'recalculated', sum(CASE WHEN r = 2 THEN 100 ELSE n_nationkey END) FROM ({_NATIONS}) GROUP BY workbook_id
    UNION ALL SELECT workbook_id, max(r) + 1, 3, 'recalculated', 3 * sum(CASE WHEN r = 2 THEN 100 ELSE n_nationkey END) FROM ({_NATIONS}) GROUP BY workbook_id""",
)
def calc_graph_eval(spark, sf_dir):
    given = whatif.parse_changes({"Data!B2": "100", "data!E1": 3.0}, ["Data"])
    books = [r.r_name + ".xlsx" for r in table(spark, sf_dir, "region").select("r_name").collect()]  # five
    found = whatif.recalculate(_cells(spark, sf_dir), whatif.changes_frame(spark, {b: given for b in books}), facts_frame(_files(spark, sf_dir)))
    return found.where("NOT (row = 1 AND col = 5)").select("workbook_id", F.col("row").cast("long").alias("row"), "col", "status", "num")


@CATALOG.query("render_grid", f"SELECT workbook_id, 'Data' AS sheet, 5 AS rung, '1 A:Nation | B:Key | C:Twice' || chr(10) || '… ' || (count(*) + 1) || ' rows omitted …' AS text FROM ({_NATIONS}) GROUP BY workbook_id")
def render_grid(spark, sf_dir):
    return render.render(_cells(spark, sf_dir), ["workbook_id", "sheet"], 60)


@CATALOG.query("mine_cases", f"SELECT workbook_id, count(*) + 1 AS n FROM ({_NATIONS}) GROUP BY workbook_id")
def mine_cases(spark, sf_dir):
    found = render.mine_cases(_cells(spark, sf_dir).where("col < 3"), 10_000)
    return found.groupBy("workbook_id").agg(F.count("*").alias("n"))


@CATALOG.query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    counted = streams.windowed(table(spark, sf_dir, "events"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
