"""A sample planning workbook with questions whose answers are known, and a synthetic corpus for benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzgrid.sources.write_xlsx import PERCENT, Formula, Styled, workbook

PLANNING = "planning"
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun")
_REGIONS = ("North", "South", "East", "West")
#: Question, and the sheet and rectangle that a right answer cites.
QUESTIONS = (
    ("growth-rate", "What growth rate does the plan assume?", "Assumptions", "A3:B7"), ("tax", "Which tax rate is applied to profit?", "Assumptions", "A3:B7"), ("fx", "What exchange rate converts euros to dollars?", "Assumptions", "A3:B7"),
    ("revenue-by-region", "Revenue by region per month", "Actuals", "A1:E25"), ("units", "How many units were sold?", "Actuals", "E1:E25"), ("forecast-revenue", "How is projected revenue calculated?", "Forecast", "A3:E7"),
    ("ebitda", "What is the EBITDA for each quarter?", "Forecast", "D3:D7"), ("net-income", "net income after tax", "Forecast", "E3:E7"), ("currency", "What currency are the amounts in?", "Forecast", "A10:A12"),
    ("staff", "How many people work in engineering?", "Headcount", "A1:C5"), ("pay", "average pay by department", "Headcount", "A1:C5"), ("payroll", "What does each team cost in wages?", "Headcount", "A1:C5"),
    ("profit-outlook", "What profit do we expect next year?", "Forecast", "A3:E7"), ("es-currency", "¿En qué moneda están los importes?", "Forecast", "A10:A12"), ("fr-headcount", "Combien d'employés par département ?", "Headcount", "A1:C5"), ("de-growth", "Welche Wachstumsrate wird angenommen?", "Assumptions", "A3:B7"),
)


def planning_workbook() -> bytes:
    """Four sheets: assumptions with names, 24 months of actuals, a forecast of formulas with notes, headcount."""
    assumptions = [["Planning assumptions"], [], ["Parameter", "Value"], ["Growth rate", Styled(0.05, PERCENT)], ["Tax rate", Styled(0.21, PERCENT)], ["EUR/USD exchange rate", 1.08], ["Discount rate", Styled(0.08, PERCENT)]]
    revenue = [[m, r, 1000 + 150 * j + 40 * i] for i, m in enumerate(_MONTHS) for j, r in enumerate(_REGIONS)]
    actuals = [["Month", "Region", "Revenue", "Cost", "Units sold"]] + [[m, r, x, round(0.62 * x), 20 + _REGIONS.index(r)] for m, r, x in revenue]
    total, cost = sum(x for *_, x in revenue), sum(row[3] for row in actuals[1:])
    forecast: list[list] = [["Revenue forecast 2027"], [], ["Quarter", "Revenue", "Cost", "EBITDA", "Net income"]]
    for k in range(1, 5):
        row, growth = k + 3, 1.05**k
        a, b = total / 2 * growth, cost / 2 * growth
        forecast.append([f"Q{k}", Formula(f"=SUM(Actuals!C2:C25)/2*(1+GrowthRate)^{k}", a), Formula(f"=SUM(Actuals!D2:D25)/2*(1+GrowthRate)^{k}", b), Formula(f"=B{row}-C{row}", a - b), Formula(f"=D{row}*(1-TaxRate)", (a - b) * 0.79)])
    forecast += [[], [], ["Notes:"], ["All amounts are reported in US dollars at constant currency."], ["Quarterly revenue grows by the planning growth rate."]]
    headcount = [["Department", "Employees", "Average salary"], ["Engineering", 42, 98000], ["Sales", 25, 72000], ["Finance", 8, 81000], ["Operations", 15, 64000]]
    return workbook({"Assumptions": assumptions, "Actuals": actuals, "Forecast": forecast, "Headcount": headcount}, names={"GrowthRate": "Assumptions!$B$4", "TaxRate": "Assumptions!$B$5"})


def cases(spark: SparkSession) -> DataFrame:
    """CASES of the sample's questions."""
    return spark.createDataFrame([(i, q, PLANNING, [(s, a)]) for i, q, s, a in QUESTIONS], "case_id string, question string, workbook_id string, expected array<struct<sheet:string,a1:string>>")


def bench_corpus(spark: SparkSession, workbooks: int = 3, sheets: int = 4, cells: int = 2500, chunks: int = 180, seed: int = 20261009) -> dict[str, DataFrame]:
    """chunks, structure and edges of synthetic workbooks; the same for the same arguments, and made where they are used.

    Each sheet has a chain of formulas, f0 to f5, and a cycle of two nodes.
    """
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(500)).cast("string"))
    book = lambda per: F.concat(F.lit("bench"), F.floor(F.col("id") / (sheets * per)).cast("string"))
    sheet = lambda per: F.concat(F.lit("Sheet"), F.pmod(F.floor(F.col("id") / per), F.lit(sheets)).cast("string"))
    base = lambda per: spark.range(workbooks * sheets * per).select("id", book(per).alias("workbook_id"), sheet(per).alias("sheet_name"), F.pmod("id", F.lit(per)).cast("int").alias("k"))
    made = base(chunks).select("id", "workbook_id", F.concat("workbook_id", F.lit(":v1")).alias("version_key"), "sheet_name", F.concat(word(0), F.lit(" "), word(1)).alias("title"), F.array_join(F.array(*(word(k) for k in range(2, 14))), " ").alias("content"), F.array(word(14)).alias("headers"), F.lit("region").alias("chunk_type"))
    nodes = base(cells).select("workbook_id", F.concat("workbook_id", F.lit(":v1")).alias("version_key"), "sheet_name", F.concat("workbook_id", F.lit(":v1:cell:"), F.lower("sheet_name"), F.lit("!"), F.col("k").cast("string")).alias("node_id"), (F.floor(F.col("k") / 10) + 1).cast("int").alias("row_lo"), (F.floor(F.col("k") / 10) + 1).cast("int").alias("row_hi"), (F.pmod("k", F.lit(10)) + 1).cast("int").alias("col_lo"), (F.pmod("k", F.lit(10)) + 1).cast("int").alias("col_hi"), "k")
    target = F.when(F.col("k") < 6, F.col("k") + 1).when(F.col("k") == 7, 8).when(F.col("k") == 8, 7)
    reads = nodes.where(target.isNotNull()).select(F.col("node_id").alias("src"), F.concat(F.regexp_replace("node_id", r"!\d+$", "!"), target.cast("string")).alias("dst"), "workbook_id", "version_key", "sheet_name")
    return {"chunks": made.withColumn("id", F.concat("workbook_id", F.lit(":"), "sheet_name", F.lit(":"), F.col("id").cast("string"))), "structure": nodes.drop("k"), "edges": reads}
