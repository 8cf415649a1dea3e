"""Queries on versions, formulas, recalculation and saved values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzgrid.catalog import Catalog, table
from quartzgrid.operators import calc, diff, formulas, profile, store

CATALOG = Catalog()

#: The second version of the orders grid: some rows gone, some new, some changed.
_OLD = "SELECT o_orderkey AS k, o_orderstatus AS sheet, CASE WHEN o_orderkey % 2 = 0 THEN '=B' || o_orderkey || '*2' END AS formula, o_totalprice AS result, o_totalprice AS value FROM orders WHERE o_orderkey % 13 <> 0"
_NEW = """SELECT o_orderkey AS k, o_orderstatus AS sheet, CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '=1' END WHEN o_orderkey % 2 = 0 THEN '=B' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '*3' ELSE '*2' END END AS formula,
CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS result, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 17 <> 0"""
_CHANGES = f"""SELECT k, sheet, change FROM (SELECT coalesce(o.k, n.k) AS k, coalesce(o.sheet, n.sheet) AS sheet, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN (o.formula IS NULL) <> (n.formula IS NULL) THEN 'kind'
WHEN o.formula IS DISTINCT FROM n.formula THEN 'formula' WHEN n.formula IS NOT NULL AND o.result IS DISTINCT FROM n.result THEN 'result' WHEN o.value IS DISTINCT FROM n.value THEN 'value' END AS change FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.k = n.k AND o.sheet = n.sheet) WHERE change IS NOT NULL"""


def _grids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    even = k % 2 == 0
    formula = F.when(even, F.concat(F.lit("=B"), k, F.lit("*2")))
    changed = F.when(k % 11 == 0, F.when(~even, "=1")).when(even, F.concat(F.lit("=B"), k, F.when(k % 7 == 0, "*3").otherwise("*2")))
    old = orders.where(k % 13 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("sheet"), formula.alias("formula"), price.alias("result"), price.alias("value"))
    new = orders.where(k % 17 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("sheet"), changed.alias("formula"), F.when(k % 5 == 0, price + 1).otherwise(price).alias("result"), F.when(k % 3 == 0, price * 2).otherwise(price).alias("value"))
    return old, new


@CATALOG.query("diff_cells", _CHANGES)
def diff_cells(spark, sf_dir):
    return diff.changes(*_grids(spark, sf_dir), ["k", "sheet"]).select("k", "sheet", "change")


@CATALOG.query("diff_counts", f"SELECT sheet, change, count(*) AS n FROM ({_CHANGES}) GROUP BY ALL")
def diff_counts(spark, sf_dir):
    return diff.change_counts(diff.changes(*_grids(spark, sf_dir), ["k", "sheet"]), ["sheet"])


@CATALOG.query("diff_impact", f"SELECT k, count(*) AS n_readers, array_to_string(list_slice(list(r ORDER BY r), 1, 20), ',') AS readers FROM (SELECT DISTINCT c.k, l_partkey AS r FROM ({_CHANGES}) c JOIN lineitem ON l_orderkey = c.k WHERE change = 'value') GROUP BY k")
def diff_impact(spark, sf_dir):
    changed = diff.changes(*_grids(spark, sf_dir), ["k", "sheet"]).where("change = 'value'")
    readers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("r"))
    return diff.impact(changed, readers, "k", "r").select("k", "n_readers", F.array_join(F.transform("readers", lambda x: x.cast("string")), ",").alias("readers"))


@CATALOG.query(
    "names_diff",
    """SELECT name, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS change, old_target, new_target FROM (SELECT p_name || '#' || p_partkey AS name, p_brand AS old_target, 1 AS o FROM part WHERE p_partkey % 5 <> 0) FULL JOIN
    (SELECT p_name || '#' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS new_target, 1 AS n FROM part WHERE p_partkey % 7 <> 0) USING (name) WHERE o IS NULL OR n IS NULL OR old_target IS DISTINCT FROM new_target""",
)
def names_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit("#"), "p_partkey"))
    old = part.where("p_partkey % 5 <> 0").select("name", F.col("p_brand").alias("target"))
    new = part.where("p_partkey % 7 <> 0").select("name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("target"))
    return diff.names_diff(old, new, "name", "target")


@CATALOG.query("sheets_added_removed", "SELECT 'added' AS change, p_brand AS sheet FROM (SELECT DISTINCT p_brand FROM part WHERE p_retailprice > 1000 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size < 4) UNION ALL SELECT 'removed', p_brand FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 4 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_retailprice > 1000)")
def sheets_added_removed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old, new = part.where("p_size < 4").select(F.col("p_brand").alias("sheet")).distinct(), part.where("p_retailprice > 1000").select(F.col("p_brand").alias("sheet")).distinct()
    return new.join(old, "sheet", "left_anti").select(F.lit("added").alias("change"), "sheet").unionByName(old.join(new, "sheet", "left_anti").select(F.lit("removed").alias("change"), "sheet"))


_FORMULAS = "SELECT l_orderkey AS k, l_linenumber AS line, l_returnflag AS sheet, '=SUM(B' || (1 + l_orderkey % 9) || ':C' || (5 + l_orderkey % 9) || ')*(1-$D' || (1 + l_linenumber) || ')+Rate' || l_linenumber || '*LOG10(E' || (2 + l_orderkey % 4) || ')' AS formula FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)"


def _formula_rows(spark, sf_dir):
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    formula = F.concat(F.lit("=SUM(B"), 1 + k % 9, F.lit(":C"), 5 + k % 9, F.lit(")*(1-$D"), 1 + line, F.lit(")+Rate"), line, F.lit("*LOG10(E"), 2 + k % 4, F.lit(")"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct().select(k.alias("k"), line.alias("line"), F.col("l_returnflag").alias("sheet"), formula.alias("formula"))


@CATALOG.query(
    "formula_pattern",
    f"""SELECT sheet, pattern, count(*) AS n, min(k) AS first, max(k) AS last FROM (SELECT *, '=SUM(B#:C#)*(1-$D#)+Rate' || line || '*LOG10(E#)' AS pattern FROM ({_FORMULAS})) GROUP BY ALL""",
)
def formula_pattern(spark, sf_dir):
    rows = _formula_rows(spark, sf_dir)
    patterns = formulas.patterns(rows.select("formula").distinct(), "formula")
    return rows.join(patterns, "formula").groupBy("sheet", "pattern").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


@CATALOG.query(
    "formula_edges",
    f"""SELECT row_lo, row_hi, col_lo, col_hi, count(*) AS n FROM (SELECT 1 + k % 9 AS row_lo, 5 + k % 9 AS row_hi, 2 AS col_lo, 3 AS col_hi FROM ({_FORMULAS}) UNION ALL SELECT 1 + line, 1 + line, 4, 4 FROM ({_FORMULAS})
    UNION ALL SELECT 2 + k % 4, 2 + k % 4, 5, 5 FROM ({_FORMULAS})) GROUP BY ALL""",
)
def formula_edges(spark, sf_dir):
    rows = _formula_rows(spark, sf_dir)
    edges = formulas.edges(rows.select("sheet", "formula").distinct(), ["A", "N", "R"])
    joined = rows.join(edges, ["sheet", "formula"]).where("reason IS NULL")
    return joined.select(*(F.col(c).cast("long" if c.startswith("row") else "int").alias(c) for c in ("row_lo", "row_hi", "col_lo", "col_hi"))).groupBy("row_lo", "row_hi", "col_lo", "col_hi").agg(F.count("*").alias("n"))


@CATALOG.query(
    "arith_excel",
    """SELECT err, count(*) AS n, round(sum(num), 4) AS total FROM (SELECT CASE WHEN tax = 0 AND e = 0 THEN '#NUM!' WHEN tax = 0 AND e < 0 THEN '#DIV/0!' WHEN d = 0 THEN '#DIV/0!' END AS err,
    CASE WHEN NOT (tax = 0 AND e = 0) AND NOT (tax = 0 AND e < 0) AND d <> 0 THEN pow(tax, e) + (q / d) / 100 END AS num FROM (SELECT l_tax * 100 AS tax, l_linenumber - 3 AS e, l_quantity AS q, round(l_discount * 100) AS d FROM lineitem)) GROUP BY err""",
)
def arith_excel(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_tax") * 100).alias("tax"), (F.col("l_linenumber") - 3).alias("e"), F.col("l_quantity").alias("q"), F.round(F.col("l_discount") * 100).alias("d"))
    power = calc.binary("^", calc.number(F.col("tax")), calc.number(F.col("e")))
    value = calc.binary("+", power, calc.percent(calc.binary("/", calc.number(F.col("q")), calc.number(F.col("d")))))
    return rows.select(value.alias("v")).groupBy(F.col("v.err").alias("err")).agg(F.count("*").alias("n"), F.round(F.sum("v.num"), 4).alias("total"))


@CATALOG.query("calc_running_balance", "SELECT o_orderkey, round(100 + sum(CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 4) AS balance, CASE WHEN max(CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN CASE WHEN o_orderkey % 10 = 3 THEN 'changed' ELSE 'recalculated' END ELSE 'saved' END AS status FROM orders")
def calc_running_balance(spark, sf_dir):
    from pyspark.sql.window import Window

    changed = F.col("o_orderkey") % 10 == 3
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    out = calc.running_balance(rows, ["o_custkey"], "o_orderkey", F.when(changed, 0.0).otherwise(F.col("o_totalprice")), F.lit(100.0))
    dirty = F.max(changed).over(before)
    return out.withColumn("dirty", dirty).select("o_orderkey", F.round("balance", 4).alias("balance"), calc.provenance(changed, F.lit(False), F.col("dirty"), F.lit(True)).alias("status"))


@CATALOG.query("check_mismatch", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT *, l_extendedprice * (1 - l_discount) AS computed, CASE WHEN l_partkey % 9 = 0 THEN l_extendedprice ELSE l_extendedprice * (1 - l_discount) END AS saved FROM lineitem) WHERE abs(saved - computed) > greatest(1e-9 * greatest(abs(saved), abs(computed)), 1e-9) GROUP BY ALL")
def check_mismatch(spark, sf_dir):
    computed = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").withColumn("computed", computed).withColumn("saved", F.when(F.col("l_partkey") % 9 == 0, F.col("l_extendedprice")).otherwise(computed))
    return calc.mismatches(rows, "saved", "computed").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@CATALOG.query("pctl_nearest_rank", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def pctl_nearest_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")
    means = rows.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 6).alias("mean"))
    ranks = profile.nearest_ranks(rows, "l_returnflag", "l_extendedprice", ["l_orderkey", "l_linenumber"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return ranks.join(means, "l_returnflag")


@CATALOG.query("run_gc", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey = 3 AND c_custkey % 4 <> 1)")
def run_gc(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("run"), F.col("c_custkey") % 4).alias("ingest_run"))
    return store.without_other_runs(rows, F.col("c_nationkey") == 3, "run1").select("c_custkey", "c_nationkey")


@CATALOG.query("store_counts", "SELECT 'chunks' AS index_name, count(*) AS n FROM documents UNION ALL SELECT 'structure', count(*) FROM part")
def store_counts(spark, sf_dir):
    return store.counts({"chunks": table(spark, sf_dir, "documents"), "structure": table(spark, sf_dir, "part")})


@CATALOG.query("store_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_brand END AS p_brand FROM part UNION ALL SELECT -1, 'new'")
def store_upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    fresh = part.where("p_partkey % 4 = 0").select("p_partkey", F.lit("new").alias("p_brand")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("new").alias("p_brand")))
    return store.upserted(part, fresh, "p_partkey")


@CATALOG.query("latest_versions", "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def latest_versions(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "events"), "user_id", F.struct("ts", "event_id"), "event_type")
