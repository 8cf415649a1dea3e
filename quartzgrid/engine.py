"""The engine's requests: search, structure, range, dependents, counts. Inputs are checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.functions.a1 import overlaps
from quartzgrid.operators import answer, graph, retrieve, store


class RequestError(ValueError):
    """A request that is refused; `status` is what a service would answer."""

    def __init__(self, message: str, status: int = 400) -> None:
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Caller:
    """Who asks: requests can narrow the scopes held, never widen them."""

    scopes: frozenset[str]

    def scopes_for(self, asked: list[str] | None) -> list[str]:
        if asked is None:
            return sorted(self.scopes)
        if foreign := set(asked) - self.scopes:
            raise RequestError(f"scopes not held: {sorted(foreign)}", 403)
        return sorted(set(asked))


@dataclass(frozen=True)
class SearchRequest:
    query: str
    top_k: int = 10
    workbook_ids: list[str] | None = None
    scopes: list[str] | None = None
    sheet_names: list[str] = field(default_factory=list)
    chunk_types: list[str] = field(default_factory=list)
    depth: int = 0
    vector: list[float] | None = None
    model: str | None = None
    max_related_nodes: int = graph.MAX_NODES
    max_bytes: int = graph.MAX_BYTES
    rerank: bool = False

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise RequestError("the query is blank")
        if not 1 <= self.top_k <= 100:
            raise RequestError("top_k must be from 1 to 100")
        if not 0 <= self.depth <= graph.MAX_DEPTH:
            raise RequestError(f"depth must be from 0 to {graph.MAX_DEPTH}")
        if not 0 <= self.max_related_nodes <= graph.MAX_NODES or not 1 <= self.max_bytes <= graph.MAX_BYTES:
            raise RequestError(f"at most {graph.MAX_NODES} related nodes and {graph.MAX_BYTES} bytes")


#: Hits that a reranker sees, at least.
RERANK_WINDOW = 50


@dataclass(frozen=True)
class Answer:
    """hits with score, kind of score, rank, matched fields and related nodes; nodes with depth; gaps; one row of truncation."""

    hits: DataFrame
    nodes: DataFrame
    gaps: DataFrame
    truncation: DataFrame


class Engine:
    """chunks, structure and edges as operators.documents and the store hold them; versions(workbook_id, active_version)."""

    def __init__(self, chunks: DataFrame, structure: DataFrame, edges: DataFrame, versions: DataFrame) -> None:
        key = F.concat(F.col("workbook_id"), F.lit(":v"), F.col("active_version"))
        self.chunks, self.structure, self.edges, self.versions = chunks, structure, edges, versions.select("workbook_id", key.alias("version_key"))

    def _scoped(self, df: DataFrame, caller: Caller, workbook_ids: list[str] | None, asked: list[str] | None = None) -> DataFrame:
        """The one place where scope and version are applied; every read goes through it."""
        versions = self.versions
        if workbook_ids is not None:
            versions = versions.where(F.col("workbook_id").isin(*workbook_ids))
            known = {r.workbook_id for r in versions.select("workbook_id").distinct().collect()}  # at most the ids asked for
            if missing := set(workbook_ids) - known:
                raise RequestError(f"unknown workbooks: {sorted(missing)}", 404)
        return retrieve.active_only(df.where(retrieve.visible(caller.scopes_for(asked))), versions)

    def search(self, request: SearchRequest, caller: Caller) -> Answer:
        """Candidates by words, and by vector if there is one; fused, reranked if asked, and expanded along what their nodes read."""
        held = self._scoped(self.chunks, caller, request.workbook_ids, request.scopes)
        for column, values in (("sheet_name", request.sheet_names), ("chunk_type", request.chunk_types)):
            held = held.where(F.col(column).isin(*values)) if values else held
        fields = {"title": F.col("title"), "content": F.col("content"), "headers": F.array_join("headers", " ")}
        window = retrieve.candidate_window(request.top_k)
        lexical = retrieve.top_k(retrieve.match_count(held, request.query, fields), window, "id").select("id", "score")
        by_vector, kind = F.lit(False), "lexical"
        if request.vector is not None and request.model:
            near = retrieve.knn(held.where(F.col("embedding_model") == request.model), request.vector, window, "id", "embedding").select("id", "score")
            ranked, kind = retrieve.fuse({"lexical": lexical, "vector": near}, "id"), "rrf"
            by_vector = F.col("vector_rank").isNotNull()
        else:
            ranked = retrieve.ranked(lexical, "id").withColumnRenamed("rank", "lexical_rank")
        if request.rerank:
            head = max(request.top_k, RERANK_WINDOW)
            texts = held.select("id", F.concat_ws("\n", "title", "content").alias("chunk_text"))
            rescored = ranked.join(texts, "id").withColumn("overlap", retrieve.overlap_ratio(request.query, F.col("chunk_text")))
            ranked = retrieve.rerank_head(rescored, "id", head, F.col("overlap")).drop("chunk_text", "overlap")
            best, kind = ranked.orderBy("place").limit(request.top_k), "rerank"
        else:
            best = retrieve.top_k(ranked, request.top_k, "id").withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))
        # The result is bounded by top_k, so ranks over it are cheap and it may be broadcast.
        hits = held.join(F.broadcast(best), "id").withColumn("score_kind", F.lit(kind)).withColumn("matched", retrieve.matched_fields(request.query, fields, by_vector)).withColumnRenamed("place", "rank").drop("embedding").cache()
        visible = self._scoped(self.structure, caller, request.workbook_ids, request.scopes)
        seeds = [r.node_id for r in hits.select("node_id", "rank").orderBy("rank").collect()]  # at most top_k
        found = answer.expand(seeds, visible, retrieve.active_only(self.structure, self.versions), request.depth, request.max_related_nodes, request.max_bytes)
        nodes = found.nodes(visible)
        return Answer(answer.related_ids(hits, nodes), nodes, found.gap_rows(hits.sparkSession), found.summary(hits.sparkSession))

    def counts(self, caller: Caller) -> DataFrame:
        """Documents of each table that the caller may see, in active versions."""
        return store.counts({name: self._scoped(df, caller, None) for name, df in (("chunks", self.chunks), ("structure", self.structure))})

    def get(self, node_id: str, caller: Caller) -> DataFrame:
        """The node, or no row: whether it isn't there or isn't the caller's to see is not said."""
        return self._scoped(self.structure, caller, None).where(F.col("node_id") == node_id)

    def structure_of(self, workbook_id: str, caller: Caller, node_types: list[str] | None = None, limit: int = 200) -> DataFrame:
        held = self._scoped(self.structure, caller, [workbook_id])
        held = held.where(F.col("node_type").isin(*node_types)) if node_types else held
        return held.orderBy("node_id").limit(min(limit, 2000))

    def range(self, workbook_id: str, sheet: str, rectangle: tuple[int, int, int, int], caller: Caller, limit: int = 50) -> DataFrame:
        row_lo, row_hi, col_lo, col_hi = rectangle
        if row_lo > row_hi or col_lo > col_hi:
            raise RequestError("the range is inverted")
        meets = overlaps(F.col("row_lo"), F.col("row_hi"), F.lit(row_lo), F.lit(row_hi)) & overlaps(F.col("col_lo"), F.col("col_hi"), F.lit(col_lo), F.lit(col_hi))
        return self._scoped(self.structure, caller, [workbook_id]).where((F.col("sheet_name") == sheet) & meets).orderBy("node_id").limit(min(limit, 500))

    def dependents(self, workbook_id: str, sheet: str, rectangle: tuple[int, int, int, int], caller: Caller, limit: int = 50) -> DataFrame:
        """Nodes with an edge that meets the rectangle: a semi-join, so each comes once."""
        row_lo, row_hi, col_lo, col_hi = rectangle
        meets = overlaps(F.col("row_lo"), F.col("row_hi"), F.lit(row_lo), F.lit(row_hi)) & overlaps(F.col("col_lo"), F.col("col_hi"), F.lit(col_lo), F.lit(col_hi))
        readers = self.edges.where((F.col("sheet_name") == sheet) & meets).select(F.col("src").alias("node_id"))
        return self._scoped(self.structure, caller, [workbook_id]).join(readers, "node_id", "left_semi").orderBy("node_id").limit(min(limit, 500))
