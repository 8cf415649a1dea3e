"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzgrid.catalog import Catalog, table
from quartzgrid.functions.text import tokens
from quartzgrid.operators import evaluate, predicates, retrieve

CATALOG = Catalog()
QUERY = "The reading of threat, idiot and que"
SCOPES = ["en", "de"]


def _tokens_sql(text: str) -> str:
    return "regexp_extract_all(lower(coalesce(" + text + r", '')), '[\p{L}\p{N}_]+')"


_ASKED = _tokens_sql(f"'{QUERY}'")


def _hit_sql(text: str) -> str:
    return f"CAST(list_has_any({_tokens_sql(text)}, {_ASKED}) AS INT)"


def _fields():
    return {"title": F.col("source"), "content": F.col("text"), "headers": F.col("lang")}


def _lexical(spark, sf_dir):
    held = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", F.array("lang").alias("acl_scope")).where(retrieve.visible(SCOPES))
    return retrieve.match_count(held, QUERY, _fields())


_SCORED = f"SELECT doc_id, {' + '.join(_hit_sql(c) for c in ('source', 'text', 'lang'))} AS score FROM documents WHERE lang IN ('en', 'de')"


@CATALOG.query("lex_match_topk", f"SELECT doc_id, CAST(score AS INT) AS score FROM ({_SCORED}) WHERE score >= 1 ORDER BY score DESC, doc_id LIMIT 50")
def lex_match_topk(spark, sf_dir):
    return retrieve.top_k(_lexical(spark, sf_dir).select("doc_id", "score"), 50, "doc_id")


_BM25 = f"""
WITH words AS (SELECT doc_id, {_tokens_sql('text')} AS w FROM documents),
rows AS (SELECT doc_id, len(w) AS length, unnest(w) AS token FROM words),
totals AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
counts AS (SELECT doc_id, length, token, count(*) AS tf FROM rows WHERE token IN (SELECT unnest({_ASKED})) GROUP BY ALL),
spread AS (SELECT token, count(*) AS df FROM counts GROUP BY token)
SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
FROM counts JOIN spread USING (token), totals GROUP BY doc_id"""


@CATALOG.query("lex_bm25_topk", f"SELECT doc_id, round(score, 6) AS score FROM ({_BM25}) ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def lex_bm25_topk(spark, sf_dir):
    scored = retrieve.bm25(table(spark, sf_dir, "documents"), QUERY, "doc_id", "text").withColumn("score", F.round("score", 6))
    return retrieve.top_k(scored, 50, "doc_id")


def _query_vector(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").head()
    return [float(x) for x in found[0]]


_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"
_KNN = "SELECT vec_id, round((1 + " + _COSINE + ") / 2, 6) AS score FROM embeddings WHERE label IN (0, 2, 4, 6, 8)"


@CATALOG.query("knn_exact_topk", f"{_KNN} ORDER BY 2 DESC, vec_id LIMIT 50")
def knn_exact_topk(spark, sf_dir):
    near = retrieve.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 200, "vec_id", "embedding", F.col("label").isin(0, 2, 4, 6, 8))
    return retrieve.top_k(near.select("vec_id", F.round("score", 6).alias("score")), 50, "vec_id")


@CATALOG.query("knn_model_filter", f"SELECT vec_id, label, round((1 + {_COSINE}) / 2, 6) AS score FROM embeddings WHERE label = 3 ORDER BY 3 DESC, vec_id LIMIT 20")
def knn_model_filter(spark, sf_dir):
    near = retrieve.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 100, "vec_id", "embedding", F.col("label") == 3)
    return retrieve.top_k(near.select("vec_id", "label", F.round("score", 6).alias("score")), 20, "vec_id")


_LISTS = f"""
lexical AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, CAST(score AS INT) AS score FROM ({_SCORED}) WHERE score >= 1 ORDER BY score DESC, doc_id LIMIT 50)),
vector AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, round((1 + {_COSINE}) / 2, 6) AS score FROM embeddings ORDER BY 2 DESC, vec_id LIMIT 50)),
fused AS (SELECT doc_id, lexical.rank AS lexical_rank, vector.rank AS vector_rank, coalesce(1.0 / (60 + lexical.rank), 0) + coalesce(1.0 / (60 + vector.rank), 0) AS score FROM lexical FULL JOIN vector USING (doc_id))"""


def _fused(spark, sf_dir):
    lexical = retrieve.top_k(_lexical(spark, sf_dir).select("doc_id", "score"), 50, "doc_id")
    near = retrieve.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 200, "vec_id", "embedding")
    near = retrieve.top_k(near.select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score")), 50, "doc_id")
    return retrieve.fuse({"lexical": lexical, "vector": near}, "doc_id")


@CATALOG.query("hybrid_rrf", f"WITH {_LISTS} SELECT doc_id, lexical_rank, vector_rank, round(score, 6) AS score FROM fused")
def hybrid_rrf(spark, sf_dir):
    return _fused(spark, sf_dir).select("doc_id", F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), F.round("score", 6).alias("score"))


_OVERLAP = f"CAST(len(list_intersect(list_distinct({_tokens_sql('text')}), list_distinct({_ASKED}))) AS DOUBLE) / len(list_distinct({_ASKED}))"


@CATALOG.query(
    "hybrid_rrf_rerank",
    f"""WITH {_LISTS}, placed AS (SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS old_rank FROM fused),
    scored AS (SELECT p.doc_id, old_rank, CASE WHEN old_rank <= 20 THEN 0 ELSE 1 END AS segment, CASE WHEN old_rank <= 20 THEN round(coalesce({_OVERLAP}, 0), 9) ELSE score END AS score FROM placed p LEFT JOIN documents d USING (doc_id))
    SELECT doc_id, CAST(segment AS INT) AS segment, round(score, 6) AS score, row_number() OVER (ORDER BY segment, score DESC, doc_id) AS place FROM scored""",
)
def hybrid_rrf_rerank(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    fused = _fused(spark, sf_dir).withColumn("score", F.round("score", 9)).join(texts, "doc_id", "left")
    again = retrieve.rerank_head(fused, "doc_id", 20, F.round(retrieve.overlap_ratio(QUERY, F.col("text")), 9))
    return again.select("doc_id", F.col("segment").cast("int").alias("segment"), F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@CATALOG.query(
    "matched_fields",
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN list_has_any({_tokens_sql(c)}, {_ASKED}) THEN '{n}' END" for n, c in (("title", "source"), ("content", "text"), ("headers", "lang"))) + "], lambda x: x IS NOT NULL), ',') AS fields FROM documents",
)
def matched_fields(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(retrieve.matched_fields(QUERY, _fields()), ",").alias("fields"))


@CATALOG.query("token_sets", f"SELECT doc_id, CAST(len(list_distinct({_tokens_sql('text')})) AS INT) AS n_tokens, md5(array_to_string(list_sort(list_distinct({_tokens_sql('text')})), ' ')) AS digest FROM documents")
def token_sets(spark, sf_dir):
    found = F.array_sort(tokens(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("digest"))


@CATALOG.query("facet_filter", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') ORDER BY o_orderkey LIMIT 200")
def facet_filter(spark, sf_dir):
    query = {"bool": {"filter": [{"terms": {"o_orderstatus": ["F", "O"]}}, {"terms": {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}}]}}
    return predicates.search(table(spark, sf_dir, "orders"), query, "o_orderkey", 200, ["o_orderkey", "o_orderstatus", "o_orderpriority"]).drop("score")


@CATALOG.query(
    "bool_should_min",
    """SELECT p_partkey, CAST(a + b + c AS DOUBLE) AS score FROM (SELECT *, CAST(p_size >= 10 AND p_size < 30 AS INT) AS a, CAST(p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#1', 'Brand#2') AS INT) AS b, CAST(p_retailprice >= 950 AS INT) AS c FROM part)
    WHERE a + b + c >= 2 AND NOT (p_size = 15) ORDER BY score DESC, p_partkey LIMIT 100""",
)
def bool_should_min(spark, sf_dir):
    query = {"bool": {"should": [{"range": {"p_size": {"gte": 10, "lt": 30}}}, {"terms": {"p_brand": ["Brand#11", "Brand#12", "Brand#13", "Brand#1", "Brand#2"]}}, {"range": {"p_retailprice": {"gte": 950}}}], "minimum_should_match": 2, "must_not": [{"term": {"p_size": 15}}]}}
    return predicates.search(table(spark, sf_dir, "part"), query, "p_partkey", 100, ["p_partkey"])


@CATALOG.query("nested_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45 AND l_returnflag = 'R')")
def nested_exists(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("items"))
    query = {"nested": {"path": "items", "query": {"bool": {"filter": [{"range": {"items.l_quantity": {"gte": 45}}}, {"term": {"items.l_returnflag": "R"}}]}}}}
    predicate, _ = predicates.QueryCompiler(items).compile(query)
    return table(spark, sf_dir, "orders").select("o_orderkey").join(items.where(predicate).select("o_orderkey"), "o_orderkey", "left_semi")


@CATALOG.query(
    "scope_version_pin",
    """SELECT c_custkey, concat('wb', c_nationkey, ':v', c_custkey % 3) AS version_key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND EXISTS
    (SELECT 1 FROM (SELECT concat('wb', n_nationkey, ':v', n_nationkey % 3) AS k FROM nation) WHERE k = concat('wb', c_nationkey, ':v', c_custkey % 3))""",
)
def scope_version_pin(spark, sf_dir):
    key = F.concat(F.lit("wb"), F.col("c_nationkey"), F.lit(":v"), F.col("c_custkey") % 3)
    held = table(spark, sf_dir, "customer").withColumn("acl_scope", F.array("c_mktsegment")).where(retrieve.visible(["BUILDING", "MACHINERY"])).select("c_custkey", key.alias("version_key"))
    versions = table(spark, sf_dir, "nation").select(F.concat(F.lit("wb"), F.col("n_nationkey"), F.lit(":v"), F.col("n_nationkey") % 3).alias("version_key"))
    return retrieve.active_only(held, versions).select("c_custkey", "version_key")


@CATALOG.query(
    "mget_classify",
    """SELECT k AS c_custkey, CAST(ordinal AS BIGINT) AS ordinal, CASE WHEN c.c_custkey IS NULL THEN 'missing' WHEN c_mktsegment = 'BUILDING' THEN 'visible' ELSE 'denied' END AS status
    FROM (SELECT k, min(i) AS ordinal FROM (SELECT i, (i * 37) % 2000 AS k FROM range(300) t(i)) GROUP BY k) LEFT JOIN customer c ON c.c_custkey = k""",
)
def mget_classify(spark, sf_dir):
    asked = spark.range(300).select((F.col("id") * 37 % 2000).alias("c_custkey"), F.col("id").alias("ordinal"))
    return retrieve.classify(asked, table(spark, sf_dir, "customer"), "c_custkey", F.col("c_mktsegment") == "BUILDING").select("c_custkey", F.col("ordinal").cast("long").alias("ordinal"), "status")


_RELEVANT = """
relevant AS (SELECT item_id AS case_id, doc_id AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text[:60])),
hits AS (SELECT case_id, expected, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, expected) AS rank FROM relevant JOIN documents ON doc_id = expected),
results AS (SELECT case_id, count(DISTINCT expected) AS n_expected, min(rank) AS first_rank, count(DISTINCT CASE WHEN rank <= 1 THEN expected END) AS covered_1, count(DISTINCT CASE WHEN rank <= 3 THEN expected END) AS covered_3 FROM hits WHERE expected % 3 <> 1 OR rank > 1 GROUP BY case_id)"""


@CATALOG.query(
    "eval_metrics",
    f"""WITH {_RELEVANT}, totals AS (SELECT case_id, count(DISTINCT expected) AS n FROM relevant GROUP BY case_id)
    SELECT count(*) AS n_cases, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(coalesce(covered_1, 0) * 1.0 / n), 6) AS recall_1,
    round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(coalesce(covered_3, 0) * 1.0 / n), 6) AS recall_3 FROM totals LEFT JOIN results USING (case_id)""",
)
def eval_metrics(spark, sf_dir):
    from pyspark.sql.window import Window

    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    # An item's first 60 characters are its question, as the survey has it. A text that holds them holds their longest inner word
    # as a word of its own: an equi-join on that word (on an empty one, if there is none), then the exact test.
    needles = items.select(F.col("item_id").alias("case_id"), F.substring("text", 1, 60).alias("needle")).withColumn("inner", F.split("needle", " ", -1))
    longest = F.aggregate(F.slice("inner", F.lit(2), F.greatest(F.size("inner") - 2, F.lit(0))), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    words = F.explode(F.array_distinct(F.concat(F.split("text", " ", -1), F.array(F.lit(""))))).alias("word")
    near = documents.select("doc_id", words).join(needles.select("case_id", longest.alias("word")), "word").select("doc_id", "case_id").distinct()
    texts = documents.select("doc_id", "text", "n_chars").join(near, "doc_id").join(needles.select("case_id", "needle"), "case_id")
    found = texts.where(F.contains("text", F.col("needle"))).select("case_id", F.col("doc_id").alias("expected"), "n_chars")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("n_chars").desc(), "expected"))
    hits = found.withColumn("rank", rank).where("expected % 3 <> 1 OR rank > 1")
    out = evaluate.metrics(evaluate.case_results(found.select("case_id", "expected"), hits, [1, 3]), [1, 3])
    return out.select("n_cases", *(F.round(c, 6).alias(c) for c in out.columns if c != "n_cases"))
