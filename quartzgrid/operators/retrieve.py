"""Hybrid retrieval: lexical scores, exact vector search, rank fusion, reranking, explanation of matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.functions.text import TOKEN, tokens

RRF_K, WINDOW_LEAST, WINDOW_MOST = 60, 50, 500
K1, B = 1.2, 0.75


def candidate_window(top_k: int) -> int:
    return min(max(5 * top_k, WINDOW_LEAST), WINDOW_MOST)


def visible(scopes: list[str], scope_column: str = "acl_scope") -> Column:
    """Rows that a caller with these scopes may see; null scopes are visible to nobody."""
    return F.coalesce(F.arrays_overlap(F.col(scope_column), F.array(*map(F.lit, scopes))), F.lit(False)) if scopes else F.lit(False)


def match_count(df: DataFrame, query: str, fields: dict[str, Column]) -> DataFrame:
    """Rows with a field that shares a token with the query, and the number of such fields as score."""
    asked = tokens(F.lit(query))
    hits = [F.arrays_overlap(tokens(c), asked).cast("int") for c in fields.values()]
    return df.withColumn("score", reduce(lambda a, b: a + b, hits)).where("score >= 1")


def top_k(df: DataFrame, k: int, id_column: str) -> DataFrame:
    return df.orderBy(F.col("score").desc(), F.col(id_column)).limit(k)


def bm25(df: DataFrame, query: str, id_column: str, text_column: str) -> DataFrame:
    """(id, score) of the rows with a query token: BM25 with k1 1.2 and b 0.75, statistics over all rows.

    Only tokens of the query leave the scan; one aggregation gives the corpus figures, which are a row.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text_column, F.lit(""))), F.lit(TOKEN), F.lit(0))
    rows = df.select(F.col(id_column), words.alias("words")).select(id_column, F.size("words").alias("length"), F.filter("words", lambda w: F.array_contains(tokens(F.lit(query)), w)).alias("hits"))
    total = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    counts = rows.select(id_column, "length", F.explode("hits").alias("token")).groupBy(id_column, "length", "token").agg(F.count("*").alias("tf"))
    spread = counts.groupBy("token").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = weight * F.col("tf") / (F.col("tf") + K1 * ((1 - B) + B * F.col("length") / F.col("mean")))
    # `spread` has a row for each token of the query, `total` one row: both may be broadcast.
    return counts.join(F.broadcast(spread), "token").join(F.broadcast(total)).groupBy(id_column).agg(F.sum(gain).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def knn(df: DataFrame, query: list[float], k: int, id_column: str, vector_column: str, where: Column | None = None) -> DataFrame:
    """Exact: filter first, then the k best by (1 + cosine) / 2, ties to the smaller id. Null, zero and other-sized vectors are out."""
    held = df if where is None else df.where(where)
    vector = F.col(vector_column)
    score = (1 + cosine(vector, F.array(*(F.lit(float(x)) for x in query)))) / 2
    return top_k(held.where(F.size(vector) == len(query)).withColumn("score", score).where("score IS NOT NULL"), k, id_column)


def ranked(df: DataFrame, id_column: str) -> DataFrame:
    """(id, score, rank): a repeated id keeps its best place. Meant for candidate lists, which are bounded by their window."""
    best = df.groupBy(id_column).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(id_column))))


def fuse(lists: dict[str, DataFrame], id_column: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (id, score, in_<name>...) with score the sum of 1 / (k + rank) over the lists."""
    parts = [ranked(df, id_column).select(id_column, "rank", F.lit(name).alias("list")) for name, df in lists.items()]
    flags = [F.max(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(id_column).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), *flags)


def overlap_ratio(query: str, text: Column) -> Column:
    asked = tokens(F.lit(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, tokens(text))) / F.size(asked))


def rerank_head(df: DataFrame, id_column: str, head: int, rescored: Column) -> DataFrame:
    """The first `head` rows in the order of the new score, the others after them in their old order: adds segment and place."""
    old = Window.orderBy(F.col("score").desc(), F.col(id_column))
    cut = df.withColumn("old_rank", F.row_number().over(old)).withColumn("segment", F.when(F.col("old_rank") <= head, 0).otherwise(1))
    cut = cut.withColumn("score", F.when(F.col("segment") == 0, rescored).otherwise(F.col("score")))
    return cut.withColumn("place", F.row_number().over(Window.orderBy("segment", F.col("score").desc(), F.col(id_column))))


def matched_fields(query: str, fields: dict[str, Column], by_vector: Column | None = None) -> Column:
    """Names of the fields that share a token with the query, `embedding` last if the vector matched."""
    asked = tokens(F.lit(query))
    names = [F.when(F.arrays_overlap(tokens(c), asked), F.lit(name)) for name, c in fields.items()]
    if by_vector is not None:
        names.append(F.when(by_vector, F.lit("embedding")))
    return F.array_compact(F.array(*names))


def classify(ids: DataFrame, nodes: DataFrame, id_column: str, sees: Column) -> DataFrame:
    """Each asked id once, in its first place, as visible, denied or missing."""
    first = ids.groupBy(id_column).agg(F.min("ordinal").alias("ordinal"))
    held = nodes.select(id_column, F.lit(True).alias("present"), sees.alias("sees"))
    status = F.when(F.col("present").isNull(), "missing").when(F.col("sees"), "visible").otherwise("denied")
    return first.join(held, id_column, "left").select(id_column, "ordinal", status.alias("status"))


def active_only(df: DataFrame, versions: DataFrame, key: str = "version_key") -> DataFrame:
    """Rows of active versions: a semi-join on the version key."""
    return df.join(versions.select(key).distinct(), key, "left_semi")
