"""Retrieval quality: case files, relevance of hits, runs over many questions at once, hit@k, recall@k, MRR, gates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.functions.a1 import intersects, parse_a1
from quartzgrid.functions.text import node_kind, tokens

#: Kinds of nodes that summarise: their chunks cite nothing.
SUMMARIES = ("workbook", "sheet")
EXPECTED = "array<struct<sheet:string,a1:string>>"
CASES = f"id string, question string, workbook_id string, expected {EXPECTED}"


class CaseFileError(ValueError):
    """A line of a case file is no case."""


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, question, workbook_id, expected) of JSON lines; blank lines and those that begin with # are skipped.

    A line that isn't a case with a question, a workbook and one rectangle at least is refused, with its text.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    parsed = lines.select("line", F.from_json("line", CASES, {"mode": "PERMISSIVE"}).alias("c"))
    sound = F.col("c.question").isNotNull() & F.col("c.workbook_id").isNotNull() & (F.size("c.expected") > 0) & F.forall("c.expected", lambda e: e["sheet"].isNotNull() & parse_a1(e["a1"]).isNotNull())
    bad = parsed.where(~F.coalesce(sound, F.lit(False))).select("line").limit(3).collect()
    if bad:
        raise CaseFileError(f"{path}: no valid case: {[r.line for r in bad]}")
    return parsed.select(F.coalesce("c.id", F.concat(F.lit("case-"), F.substring(F.sha2("line", 256), 1, 12))).alias("case_id"), "c.question", "c.workbook_id", "c.expected")


def save_cases(cases: DataFrame, path: str) -> None:
    """Cases as JSON lines that read_cases reads again."""
    cases.select(F.col("case_id").alias("id"), "question", "workbook_id", "expected").write.mode("overwrite").json(path)


def expectations(cases: DataFrame) -> DataFrame:
    """A row for each rectangle that a case expects."""
    return cases.select("case_id", "question", "workbook_id", F.posexplode("expected").alias("expected", "e")).select("case_id", "question", "workbook_id", "expected", F.col("e.sheet").alias("sheet"), parse_a1(F.col("e.a1")).alias("span"))


def lexical_hits(cases: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """All questions at once: (case_id, node_id, sheet_name, a1_range, workbook_id, score, rank), the best chunks of the case's workbook.

    Score: fields that share a token with the question. Questions and chunks meet on (workbook, token), so no question
    is compared with chunks that share nothing with it; common tokens are counted once a chunk and field.
    """
    asked = cases.select("case_id", "workbook_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("token"))
    held = None
    for name, text in (("title", F.col("title")), ("content", F.col("content")), ("headers", F.array_join("headers", " "))):
        part = chunks.select("workbook_id", "node_id", F.lit(name).alias("field"), F.explode(tokens(text)).alias("token"))
        held = part if held is None else held.unionByName(part)
    met = asked.join(held, ["workbook_id", "token"]).groupBy("case_id", "workbook_id", "node_id").agg(F.count_distinct("field").alias("score"))
    order = Window.partitionBy("case_id").orderBy(F.col("score").desc(), "node_id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return best.join(chunks.select("workbook_id", "node_id", "sheet_name", "a1_range"), ["workbook_id", "node_id"])


def relevant(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, expected, rank): hits that cite an expected rectangle, of the case's workbook and sheet; summaries cite nothing."""
    cited = hits.where(~node_kind(F.col("node_id")).isin(*SUMMARIES)).select("case_id", "workbook_id", F.col("sheet_name").alias("sheet"), "rank", parse_a1(F.col("a1_range")).alias("at"))
    return cited.join(expectations(cases), ["case_id", "workbook_id", "sheet"]).where(intersects(F.col("at"), F.col("span"))).select("case_id", "expected", "rank")


def case_results(cases: DataFrame, hits: DataFrame, ks: list[int]) -> DataFrame:
    """cases(case_id, expected), one row for each expectation; hits(case_id, expected, rank), one row for each relevant hit.

    -> (case_id, n_expected, first_rank, covered_<k>...).
    """
    totals = cases.groupBy("case_id").agg(F.count_distinct("expected").alias("n_expected"))
    covered = [F.count_distinct(F.when(F.col("rank") <= k, F.col("expected"))).alias(f"covered_{k}") for k in ks]
    found = hits.groupBy("case_id").agg(F.min("rank").alias("first_rank"), *covered)
    return totals.join(found, "case_id", "left").fillna(0, [f"covered_{k}" for k in ks])


def metrics(results: DataFrame, ks: list[int]) -> DataFrame:
    """One row; no cases give 0 everywhere."""
    parts = [F.count("*").alias("n_cases"), F.coalesce(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        parts.append(F.coalesce(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"hit_{k}"))
        parts.append(F.coalesce(F.avg(F.col(f"covered_{k}") / F.col("n_expected")), F.lit(0.0)).alias(f"recall_{k}"))
    return results.agg(*parts)


def run(cases: DataFrame, hits: DataFrame, ks: list[int]) -> tuple[DataFrame, DataFrame]:
    """(metrics, results by case) of one configuration's hits."""
    results = case_results(expectations(cases), relevant(hits, cases), ks)
    return metrics(results, ks), results


def latencies(times: DataFrame, by: str, value: Column) -> DataFrame:
    """Nearest-rank percentiles and the mean of each group's times."""
    at = lambda p: F.call_function("approx_percentile", value, F.lit(p), F.lit(100_000))
    return times.groupBy(by).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.avg(value).alias("mean"))


def failed_gates(measured: dict[str, dict[str, float]], thresholds: list[str]) -> list[str]:
    """Thresholds [configuration:]metric=value that aren't met; one for a configuration that is missing fails."""
    failed = []
    for threshold in thresholds:
        left, _, value = threshold.partition("=")
        configuration, _, metric = left.rpartition(":")
        named = [configuration] if configuration else list(measured)
        if not value or not named or any(metric not in measured.get(c, {}) or measured[c][metric] < float(value) for c in named):
            failed.append(threshold)
    return failed


def report(measured: dict[str, dict[str, float]], misses: dict[str, list[str]] | None = None) -> str:
    """A table in plain text, a line a configuration, and below it the cases without a relevant hit."""
    names = list(dict.fromkeys(m for own in measured.values() for m in own))
    rows = [["configuration", *names]] + [[c, *(f"{own.get(m, 0):.3f}" if m != "n_cases" else str(int(own.get(m, 0))) for m in names)] for c, own in measured.items()]
    widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in rows]
    lines.insert(1, "  ".join("-" * w for w in widths))
    for configuration, missing in (misses or {}).items():
        if missing:
            lines += ["", f"{configuration}: no relevant hit for", *(f"  - {x}" for x in missing)]
    return "\n".join(lines)
