"""Queries on coordinates, spans, graphs and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzgrid.catalog import Catalog, table
from quartzgrid.functions import a1, text
from quartzgrid.operators import graph, profile, spatial

CATALOG = Catalog()
_LETTER = """CASE WHEN {0} <= 26 THEN chr(64 + {0}) WHEN {0} <= 702 THEN chr(64 + ({0} - 1) // 26) || chr(65 + ({0} - 1) % 26)
ELSE chr(64 + ({0} - 703) // 676 + 1) || chr(65 + (({0} - 703) % 676) // 26) || chr(65 + ({0} - 703) % 26) END"""


@CATALOG.query("a1_roundtrip", f"SELECT p_partkey, n, {_LETTER.format('n')} AS letters, n AS back FROM (SELECT p_partkey, CAST(1 + (p_partkey * 7) % 18278 AS INT) AS n FROM part)")
def a1_roundtrip(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_partkey") * 7 % 18278).cast("int").alias("n")).withColumn("letters", a1.column_letter(F.col("n")))
    return parts.withColumn("back", a1.column_index(F.col("letters")))


@CATALOG.query(
    "a1_parse",
    f"""SELECT p_partkey, a1, CASE WHEN ok THEN r1 END AS row_lo, CASE WHEN ok THEN r2 END AS row_hi, CASE WHEN ok THEN c1 END AS col_lo, CASE WHEN ok THEN c2 END AS col_hi, CASE WHEN ok THEN CAST(r2 - r1 + 1 AS BIGINT) * (c2 - c1 + 1) END AS n_cells
    FROM (SELECT *, r1 <= r2 AND c1 <= c2 AS ok, '$' || {_LETTER.format('c1')} || r1 || ':' || lower({_LETTER.format('c2')}) || '$' || r2 AS a1 FROM (SELECT p_partkey, CAST(1 + p_partkey % 50 AS INT) AS r1, CAST(1 + (p_partkey * 3) % 70 AS INT) AS r2, CAST(1 + p_partkey % 30 AS INT) AS c1, CAST(1 + (p_partkey * 5) % 800 AS INT) AS c2 FROM part))""",
)
def a1_parse(spark, sf_dir):
    k = F.col("p_partkey")
    letters = lambda n: a1.column_letter(n.cast("int"))
    written = F.concat(F.lit("$"), letters(1 + k % 30), (1 + k % 50), F.lit(":"), F.lower(letters(1 + k * 5 % 800)), F.lit("$"), (1 + k * 3 % 70))
    spans = table(spark, sf_dir, "part").select("p_partkey", written.alias("a1")).withColumn("span", a1.parse_a1(F.col("a1")))
    return spans.select("p_partkey", "a1", "span.*", a1.cell_count(F.col("span")).alias("n_cells"))


_ORDER_SPANS = """SELECT o_custkey, min(CAST(epoch(o_orderdate) // 86400 AS BIGINT)) AS row_lo, max(CAST(epoch(o_orderdate) // 86400 AS BIGINT)) AS row_hi, min(o_orderkey) AS col_lo, max(o_orderkey) AS col_hi FROM orders GROUP BY o_custkey"""


def _day(column: str):
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / 86400).cast("long")


def _order_spans(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(_day("o_orderdate")).alias("row_lo"), F.max(_day("o_orderdate")).alias("row_hi"), F.min("o_orderkey").alias("col_lo"), F.max("o_orderkey").alias("col_hi"))


@CATALOG.query("range_intersect", f"SELECT * FROM ({_ORDER_SPANS}) WHERE row_lo <= 9300 AND row_hi >= 9200 AND col_lo <= 900 AND col_hi >= 100 ORDER BY o_custkey LIMIT 500")
def range_intersect(spark, sf_dir):
    return spatial.range_query(_order_spans(spark, sf_dir), F.lit(True), 9200, 9300, 100, 900).orderBy("o_custkey").limit(500)


_ITEM_SPANS = "SELECT l_orderkey, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS lo, CAST(epoch(l_shipdate) // 86400 AS BIGINT) + CAST(floor(l_quantity) AS BIGINT) AS hi FROM lineitem"
_MONTHS = "SELECT DISTINCT CAST(epoch(o_orderdate) // 86400 // 30 AS BIGINT) * 30 AS w_lo, CAST(epoch(o_orderdate) // 86400 // 30 AS BIGINT) * 30 + 29 AS w_hi FROM orders"


def _item_spans(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", _day("l_shipdate").alias("lo"), (_day("l_shipdate") + F.floor("l_quantity")).alias("hi"))


def _months(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.floor(_day("o_orderdate") / 30) * 30).alias("w_lo")).distinct().withColumn("w_hi", F.col("w_lo") + 29)


@CATALOG.query("range_join_many", f"SELECT w_lo, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM ({_ITEM_SPANS}) JOIN ({_MONTHS}) ON lo <= w_hi AND hi >= w_lo GROUP BY w_lo")
def range_join_many(spark, sf_dir):
    met = spatial.interval_join(_item_spans(spark, sf_dir), _months(spark, sf_dir), ("lo", "hi"), ("w_lo", "w_hi"), 30)
    return met.groupBy("w_lo").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@CATALOG.query("dependents_semi", "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey BETWEEN 50 AND 90)")
def dependents_semi(spark, sf_dir):
    readers = table(spark, sf_dir, "lineitem").where("l_partkey BETWEEN 50 AND 90").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(readers, "o_orderkey", "left_semi")


@CATALOG.query(
    "region_parent_first",
    f"""SELECT o_custkey, coalesce(min(ix), -1) AS parent FROM ({_ORDER_SPANS}) LEFT JOIN (SELECT k AS ix, 8000 + k * 150 AS r_lo, 8000 + k * 150 + 99 AS r_hi FROM range(20) t(k)) ON row_lo <= r_hi AND row_hi >= r_lo GROUP BY o_custkey""",
)
def region_parent_first(spark, sf_dir):
    regions = spark.range(20).select(F.col("id").alias("ix"), (8000 + F.col("id") * 150).alias("lo"), (8099 + F.col("id") * 150).alias("hi"))
    spans = _order_spans(spark, sf_dir).select("o_custkey", F.col("row_lo").alias("lo"), F.col("row_hi").alias("hi"))
    return spatial.parents(spans, regions, "o_custkey", "ix", 100, F.lit(-1).cast("long"))


@CATALOG.query("containment_join", f"SELECT l_orderkey, w_lo, count(*) AS n FROM ({_ITEM_SPANS}) JOIN ({_MONTHS}) ON w_lo <= lo AND hi <= w_hi GROUP BY ALL")
def containment_join(spark, sf_dir):
    met = spatial.interval_join(_item_spans(spark, sf_dir), _months(spark, sf_dir), ("lo", "hi"), ("w_lo", "w_hi"), 30)
    return met.where("w_lo <= lo AND hi <= w_hi").groupBy("l_orderkey", "w_lo").agg(F.count("*").alias("n"))


_EDGES = "SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem"


def _edges(spark, sf_dir):
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    bought = table(spark, sf_dir, "orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"))
    return bought.unionByName(table(spark, sf_dir, "lineitem").select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst")))


def _seeds(spark, n=10):
    return spark.range(n).select(F.concat(F.lit("c"), F.col("id")).alias("node"))


_REACHED = f"WITH RECURSIVE edges AS ({_EDGES}), walk(node, depth) AS (SELECT 'c' || k, 0 FROM range(10) t(k) UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 2), reached AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"


@CATALOG.query("expand_depth2", f"{_REACHED} SELECT node, CAST(depth AS INT) AS depth FROM reached")
def expand_depth2(spark, sf_dir):
    return graph.expand(_seeds(spark), _edges(spark, sf_dir), 2)


@CATALOG.query(
    "expand_budget",
    f"""{_REACHED}, over AS (SELECT greatest(count(*) - 50, 0) AS dropped FROM reached WHERE depth > 0)
    SELECT node, CAST(depth AS INT) AS depth, depth = 0 OR row_number() OVER (PARTITION BY depth = 0 ORDER BY depth, node) <= 50 AS kept, dropped, CASE WHEN dropped > 0 THEN 'max_related_nodes' END AS reason FROM reached CROSS JOIN over""",
)
def expand_budget(spark, sf_dir):
    return graph.within_budget(graph.expand(_seeds(spark), _edges(spark, sf_dir), 2), 50)


@CATALOG.query("expand_cycle", "WITH RECURSIVE walk(node, depth) AS (SELECT 1, 0 UNION SELECT (node * 2) % 25, depth + 1 FROM walk WHERE depth < 30) SELECT CAST(node AS INT) AS node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node")
def expand_cycle(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") * 2 % 25).alias("dst"))
    return graph.expand(spark.range(1, 2).select(F.col("id").cast("int").alias("node")), edges, 30)


@CATALOG.query("calc_dirty", f"WITH RECURSIVE edges AS ({_EDGES}), walk(node) AS (SELECT 'c' || k FROM range(5) t(k) UNION SELECT dst FROM walk JOIN edges ON src = node) SELECT DISTINCT node FROM walk")
def calc_dirty(spark, sf_dir):
    return graph.closure(_seeds(spark, 5), _edges(spark, sf_dir))


@CATALOG.query("bands_islands", "SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM (SELECT DISTINCT l_orderkey AS v FROM lineitem)) GROUP BY g")
def bands_islands(spark, sf_dir):
    return profile.bands(table(spark, sf_dir, "lineitem"), "l_orderkey")


@CATALOG.query("leading_run", "SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'error' OR event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events) WHERE f = 0")
def leading_run(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("run", profile.leading_run(~F.col("event_type").isin("error", "purchase"), ["user_id"], ["ts", "event_id"])).where("run").select("event_id", "user_id")


@CATALOG.query("trailing_run", "SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'error' OR event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM events) WHERE f = 0")
def trailing_run(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("run", profile.trailing_run(~F.col("event_type").isin("error", "purchase"), ["user_id"], ["ts", "event_id"])).where("run").select("event_id", "user_id")


_PROFILE = """SELECT '{0}' AS column_name, count(*) AS n_distinct, CASE WHEN bool_and(regexp_matches(v, '^[+-]?\\d+(\\.\\d*)?$')) THEN 'number' WHEN bool_or(regexp_matches(v, '^[+-]?\\d+(\\.\\d*)?$')) THEN 'mixed' ELSE 'text' END AS inferred_type,
array_to_string(list_slice(list(v ORDER BY k, v), 1, 5), '|') AS examples FROM (SELECT v, min(k) AS k FROM (SELECT CAST({0} AS VARCHAR) AS v, p_partkey AS k FROM part) WHERE v IS NOT NULL GROUP BY v)"""
_PROFILED = ("p_brand", "p_type", "p_size", "p_name")


@CATALOG.query("column_profile", " UNION ALL ".join(_PROFILE.format(c) for c in _PROFILED))
def column_profile(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("display")) for c in _PROFILED))).alias("cell")).select("row", "cell.*")
    found = profile.column_profile(parts, ["column_name"], "row", "display", text.csv_kind(F.col("display")), F.lit(False), F.lit(False))
    return found.select("column_name", "n_distinct", "inferred_type", F.array_join("examples", "|").alias("examples"))


_KIND = "CASE WHEN f IS NULL OR trim(f) = '' THEN 'empty' WHEN upper(trim(f)) IN ('TRUE', 'FALSE') THEN 'boolean' WHEN regexp_matches(trim(f), '^[+-]?0\\d+$') THEN 'text' WHEN regexp_matches(trim(f), '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'number' ELSE 'text' END"


@CATALOG.query("csv_typing", f"SELECT event_id, f AS field, {_KIND} AS kind FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN regexp_extract(props, ': *(\\d+)', 1) WHEN 1 THEN '00' || event_id WHEN 2 THEN event_type ELSE ' true ' END AS f FROM events)")
def csv_typing(spark, sf_dir):
    k = F.col("event_id") % 4
    field = F.when(k == 0, F.regexp_extract("props", r": *(\d+)", 1)).when(k == 1, F.concat(F.lit("00"), F.col("event_id"))).when(k == 2, F.col("event_type")).otherwise(" true ")
    return table(spark, sf_dir, "events").select("event_id", field.alias("field")).withColumn("kind", text.csv_kind(F.col("field")))


@CATALOG.query("row_groups", 'SELECT o_orderstatus, CAST(g AS INT) AS "group", min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM (SELECT *, (rn - 1) // greatest(50, CAST(ceil(c / 8.0) AS BIGINT)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders)) GROUP BY ALL')
def row_groups(spark, sf_dir):
    return profile.row_groups(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey")


@CATALOG.query("header_path", "SELECT n_nationkey, concat_ws(' / ', r_name, nullif(CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END, '')) AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def header_path(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    lower = F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name"))
    return joined.select("n_nationkey", text.header_path(F.array("r_name", lower), F.lit("Column")).alias("path"))


_GRID = "SELECT l_orderkey AS \"row\", l_linenumber AS col, max(l_quantity) AS v FROM lineitem GROUP BY ALL"


@CATALOG.query("merge_cover", f'SELECT coalesce(c."row", s."row") AS "row", coalesce(c.col, s.col) AS col, coalesce(s.v, c.v) AS v FROM ({_GRID}) c FULL JOIN (SELECT g."row", k.i AS col, g.v FROM ({_GRID}) g, (SELECT unnest([1, 2, 3]) AS i) k WHERE g.col = 1 AND g."row" % 5 = 0) s ON c."row" = s."row" AND c.col = s.col')
def merge_cover(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max("l_quantity").alias("v")).withColumn("sheet", F.lit("s"))
    merges = cells.where("row % 5 = 0").select("sheet", F.col("row").alias("row_lo"), F.col("row").alias("row_hi"), F.lit(1).alias("col_lo"), F.lit(3).alias("col_hi")).distinct()
    return spatial.cover(cells, merges, "v").select("row", "col", "v")


@CATALOG.query("label_left_asof", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label FROM events")
def label_left_asof(spark, sf_dir):
    label = spatial.label_before(["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"))


@CATALOG.query("find_capped", "SELECT doc_id, count(*) OVER () AS total FROM documents WHERE contains(lower(text), 'idiot') ORDER BY doc_id LIMIT 50")
def find_capped(spark, sf_dir):
    return profile.find_capped(table(spark, sf_dir, "documents").select("doc_id", "text"), "Idiot", F.col("text"), "doc_id").select("doc_id", "total")


@CATALOG.query("head_tail_window", "SELECT o_custkey, o_orderkey, place, greatest(c - 11, 0) AS omitted FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders) WHERE place <= 8 OR place > c - 3")
def head_tail_window(spark, sf_dir):
    return profile.head_tail(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 8, 3).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"), "omitted")


@CATALOG.query("detail_ladder", "SELECT doc_id, CAST(CASE WHEN ceil(n / 3.0) <= 500 THEN 0 WHEN ceil(least(n, 1500) / 3.0) <= 400 THEN 1 WHEN ceil(least(n, 600) / 3.0) <= 500 THEN 2 END AS INT) AS rung FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)")
def detail_ladder(spark, sf_dir):
    whole = F.length(F.coalesce("text", F.lit("")))
    size = lambda n: F.ceil(n / 3)
    sizes = [(0, size(whole)), (1, size(F.least(whole, F.lit(1500))) + 100), (2, size(F.least(whole, F.lit(600))))]
    return table(spark, sf_dir, "documents").select("doc_id", profile.first_fitting(sizes, 500).alias("rung"))


@CATALOG.query("chunk_text", "SELECT p_partkey, p_name || chr(10) || 'Brand: ' || p_brand || '; type: ' || p_type || '; size ' || p_size AS chunk, CAST(ceil(length(p_name || chr(10) || 'Brand: ' || p_brand || '; type: ' || p_type || '; size ' || p_size) / 3.0) AS BIGINT) AS tokens, 'wb:v1:region:' || regexp_replace(lower(trim(p_name)), '[^a-z0-9_.!$:-]+', '_', 'g') AS node FROM part")
def chunk_text(spark, sf_dir):
    content = F.concat(F.lit("Brand: "), F.col("p_brand"), F.lit("; type: "), F.col("p_type"), F.lit("; size "), F.col("p_size"))
    chunk = text.chunk_text(F.col("p_name"), content)
    return table(spark, sf_dir, "part").select("p_partkey", chunk.alias("chunk"), text.approx_tokens(chunk).alias("tokens"), text.node_id(F.lit("wb"), F.lit(1), F.lit("region"), F.col("p_name")).alias("node"))
