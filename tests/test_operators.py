"""Operators on small tables with known answers."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quartzgrid.engine import Caller, Engine, RequestError, SearchRequest
from quartzgrid.functions import a1, text
from quartzgrid.functions.embed import hashed_vector
from quartzgrid.operators import diff, evaluate, graph, predicates, profile, retrieve, spatial, store
from quartzgrid.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_a1(spark):
    assert [one(spark, a1.column_index(F.lit(x))) for x in ("A", "Z", "AA", "XFD")] == [1, 26, 27, 16384]
    assert [one(spark, a1.column_letter(F.lit(n))) for n in (1, 26, 27, 702, 703, 16384, 18278, 18279)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD", "ZZZ", None]
    assert one(spark, a1.parse_a1(F.lit("$B2:D40"))) == Row(row_lo=2, row_hi=40, col_lo=2, col_hi=4)
    assert one(spark, a1.parse_a1(F.lit("D4:B2"))) is None and one(spark, a1.parse_a1(F.lit("A0"))) is None


def test_text(spark):
    assert one(spark, text.typed_input(F.lit("7%"))).num == pytest.approx(0.07) and one(spark, text.typed_input(F.lit("1,200"))).num == 1200
    assert one(spark, text.qualified(F.lit("My 'Sheet"), F.lit("A1"))) == "'My ''Sheet'!A1" and one(spark, text.qualified(F.lit("Región"), F.lit("A1"))) == "Región!A1"
    assert one(spark, text.label(F.lit(" Tax rate: "))) == "Tax rate" and one(spark, text.label(F.lit("12"))) is None


def test_fusion(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, score double")
    got = {r.id: r.score for r in retrieve.fuse({"lexical": frame([("a", 3.0), ("b", 2.0)]), "vector": frame([("b", 0.9), ("c", 0.8), ("b", 0.1)])}, "id").collect()}
    assert sorted(got, key=lambda k: (-got[k], k)) == ["b", "a", "c"] and got["b"] == pytest.approx(1 / 62 + 1 / 61)
    assert one(spark, F.array_join(retrieve.matched_fields("2026 prevision", {"title": F.lit("Q1-2026"), "content": F.lit("previsión")}, F.lit(True)), ",")) == "title,embedding"


def test_query_language(spark):
    rows = spark.createDataFrame([(1, "North sales", ["a", "b"], 1, 5, [Row(k="x", n=1)]), (2, None, ["c"], 6, 9, [Row(k="y", n=5)]), (3, "south", None, None, None, None)], "id int, title string, tags array<string>, span_lo int, span_hi int, refs array<struct<k:string,n:int>>")
    ids = lambda q: [r.id for r in predicates.search(rows, q, "id", 10).collect()]
    assert ids({"match_all": {}}) == [1, 2, 3] and ids({"match": {"title": "SALES of"}}) == [1] and ids({"term": {"tags": "c"}}) == [2]
    assert ids({"range": {"span": {"gte": 5, "lte": 6}}}) == [1, 2] and ids({"nested": {"path": "refs", "query": {"range": {"refs.n": {"gt": 3}}}}}) == [2]
    assert ids({"bool": {"should": [{"term": {"id": 3}}, {"terms": {"id": [2, 3]}}]}}) == [3, 2] and ids({"bool": {"must_not": [{"term": {"title": "south"}}]}}) == [1, 2]
    with pytest.raises(predicates.UnsupportedQuery):
        ids({"fuzzy": {"title": "x"}})


def test_interval_join_is_the_theta_join(spark):
    import random

    rng = random.Random(1)
    make = lambda n: [(k, (a := rng.randrange(-500, 100_000)), a + rng.choice([-1, 0, 3, 40, 9000, 70_000])) for k in range(n)]
    left, right = make(80), make(80)
    got = spatial.interval_join(spark.createDataFrame(left, "i int, a int, b int"), spark.createDataFrame(right, "j int, c int, d int"), ("a", "b"), ("c", "d"), 10)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, a, b in left for j, c, d in right if a <= b and c <= d and a <= d and b >= c)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), (None, "e"), ("a", None)], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,)], "node string")
    assert {(r.node, r.depth) for r in graph.expand(seeds, edges, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.node for r in graph.closure(seeds, edges).collect()} == {"a", "b", "c", "d"}
    assert graph.take_by_bytes([("a", 5), ("b", 50), ("c", 4), ("d", 1)], 2, 10) == (["a", "c"], {"max_related_nodes": 1, "max_payload_bytes": 1})


def test_runs_and_groups(spark):
    values = spark.createDataFrame([(v,) for v in (3, 1, 2, 7, 9, 8, 7, None)], "v int")
    assert sorted((r.lo, r.hi, r.n) for r in profile.bands(values, "v").collect()) == [(1, 3, 3), (7, 9, 3)]
    keyed = spark.range(500).select(F.lit("s").alias("k"), "id")
    assert profile.row_groups(keyed, ["k"], "id").count() == 8
    assert profile.head_tail(keyed, ["k"], "id", 8, 3).select("omitted").distinct().head().omitted == 489


def test_diff(spark):
    schema = "k int, value string, formula string, result string"
    old = spark.createDataFrame([(1, "a", None, None), (2, "b", "=A1", "1"), (3, "c", "=A1", "1"), (4, "d", None, None), (5, "e", "=A2", "1"), (6, "same", None, None)], schema)
    new = spark.createDataFrame([(1, "x", None, None), (2, "b", "=A2", "1"), (3, "c", "=A1", "2"), (5, "e", None, None), (6, "same", None, None), (7, "n", None, None)], schema)
    assert {(r.k, r.change) for r in diff.changes(old, new, ["k"]).collect()} == {(1, "value"), (2, "formula"), (3, "result"), (4, "removed"), (5, "kind"), (7, "added")}


def test_metrics(spark):
    cases = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "case_id int, expected string")
    hits = spark.createDataFrame([(1, "a", 2), (3, "d", 1)], "case_id int, expected string, rank int")
    got = evaluate.metrics(evaluate.case_results(cases, hits, [1, 2]), [1, 2]).head()
    assert got.hit_1 == pytest.approx(1 / 3) and got.hit_2 == pytest.approx(2 / 3) and got.recall_2 == pytest.approx(0.5) and got.mrr == pytest.approx(0.5)
    assert evaluate.failed_gates({"lexical": {"mrr": 0.4}}, ["mrr=0.3", "lexical:mrr=0.5", "rrf:mrr=0.1"]) == ["lexical:mrr=0.5", "rrf:mrr=0.1"]


def test_store_replaces_versions(spark, tmp_path):
    held = store.VersionedStore(spark, str(tmp_path))
    docs = spark.createDataFrame([("n1", "text")], "node_id string, content string")
    held.write("wb", 1, {"chunks": docs, "structure": docs}, "r1")
    held.write("wb", 2, {"chunks": docs.unionByName(docs), "structure": docs}, "r2")
    assert held.versions() == {"wb": 2} and held.read("chunks", ["wb"]).count() == 2 and {r.ingest_run for r in held.read("chunks").collect()} == {"r2"}
    with pytest.raises(store.TooManyDocuments):
        held.write("wb", 3, {"chunks": docs}, "r3", most=0)
    with pytest.raises(KeyError):
        held.read("chunks", ["unknown"])


def test_engine(spark):
    chunks = spark.createDataFrame(
        [("c1", "wb", "wb:v1", "n1", "S", "region", "Revenue", "north revenue", ["Region"], [1.0, 0.0], "m", ["finance"]), ("c2", "wb", "wb:v1", "n2", "S", "region", "Staff", "people", ["Name"], [0.0, 1.0], "m", ["hr"]), ("c3", "wb", "wb:v2", "n3", "S", "region", "Revenue", "stale", [], [1.0, 0.0], "m", ["finance"])],
        "id string, workbook_id string, version_key string, node_id string, sheet_name string, chunk_type string, title string, content string, headers array<string>, embedding array<double>, embedding_model string, acl_scope array<string>",
    )
    reference = "array<struct<target_node_id:string,sheet:string,a1:string,kind:string>>"
    reads = {"n1": [("n2", "S", "A2", "cell"), ("n4", "S", "A4", "cell"), ("n9", "S", "A9", "cell")]}
    nodes = spark.createDataFrame(
        [(f"n{k}", "wb", "wb:v1", "S", k, k + 2, 1, 3, "region", f"A{k}", None, None, None, None, None, reads.get(f"n{k}", []), [("INDIRECT", "indirect")] if k == 4 else [], [s]) for k, s in ((1, "finance"), (2, "hr"), (4, "finance"))],
        f"node_id string, workbook_id string, version_key string, sheet_name string, row_lo int, row_hi int, col_lo int, col_hi int, node_type string, a1_range string, display_value string, formula string, table_name string, column_name string, named_range string, references {reference}, gaps array<struct<text:string,reason:string>>, acl_scope array<string>",
    )
    edges = spark.createDataFrame([("n1", "n2", "S", 2, 2, 1, 1), ("n1", "n4", "S", 4, 4, 1, 1)], "src string, dst string, sheet_name string, row_lo int, row_hi int, col_lo int, col_hi int")
    engine = Engine(chunks, nodes, edges, spark.createDataFrame([("wb", 1)], "workbook_id string, active_version int"))
    caller = Caller(frozenset(["finance"]))
    found = engine.search(SearchRequest("revenue people", depth=1), caller)
    assert [(r.id, r["rank"], r.related_node_ids) for r in found.hits.collect()] == [("c1", 1, ["n4"])] and {(r.node_id, r.depth) for r in found.nodes.collect()} == {("n1", 0), ("n4", 1)}
    assert sorted((r.text, r.reason) for r in found.gaps.collect()) == [("INDIRECT", "indirect"), ("n9", "malformed")]
    cut = found.truncation.first()
    assert (cut.truncated, cut.dropped_nodes, cut.denied_nodes) == (False, 0, 1) and cut.bytes_returned > 100
    few = engine.search(SearchRequest("revenue people", depth=1, max_related_nodes=0), caller).truncation.first()
    assert (few.reason, few.dropped_nodes) == ("max_related_nodes", 1)
    short = engine.search(SearchRequest("revenue people", max_bytes=10), caller)
    assert short.nodes.count() == 0 and short.truncation.first().reason == "max_payload_bytes"
    again = engine.search(SearchRequest("north people", rerank=True), caller).hits.first()
    assert (again.id, again.score, again.score_kind) == ("c1", 0.5, "rerank")
    hits = engine.search(SearchRequest("nothing alike", vector=[1.0, 0.1], model="m"), caller).hits
    assert [(r.id, r.matched) for r in hits.collect()] == [("c1", ["embedding"])]
    assert {r.index_name: r.n for r in engine.counts(caller).collect()} == {"chunks": 1, "structure": 2}
    assert engine.get("n2", caller).count() == 0 and engine.get("n1", caller).count() == 1
    assert [r.node_id for r in engine.range("wb", "S", (3, 4, 1, 1), caller).collect()] == ["n1", "n4"]
    assert [r.node_id for r in engine.dependents("wb", "S", (4, 9, 1, 2), caller).collect()] == ["n1"]
    for bad in (lambda: SearchRequest(" "), lambda: engine.range("wb", "S", (4, 3, 1, 1), caller), lambda: engine.structure_of("no", caller), lambda: caller.scopes_for(["hr"])):
        with pytest.raises(RequestError):
            bad()


def test_hashed_vectors():
    import numpy as np

    assert np.isclose(np.linalg.norm(hashed_vector("a b a", 16)), 1) and (hashed_vector(None, 8) == np.eye(8)[7]).all()


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, id % 5 AS user_id, 'click' AS event_type, timestamp '2026-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts, 1.0D AS value FROM range(300)")
    rows.write.parquet(str(tmp_path / "in"))
    query = events.windowed(events.event_stream(spark, str(tmp_path / "in"), rows.schema)).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.n for r in spark.table("counted").collect()} == {60}


def test_every_query_has_its_own_name_and_known_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 60
