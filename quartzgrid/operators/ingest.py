"""From files to the store: cells and facts to regions, chunks, structure, vectors, and a version written as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzgrid.functions.embed import hash_embedder
from quartzgrid.functions.text import chunk_text
from quartzgrid.operators import documents, regions, structure
from quartzgrid.operators.store import VersionedStore


def cells_of_files(cells: DataFrame, workbook: Column, version: int = 1) -> DataFrame:
    """The reader's cells with workbook_id, version and display; rows of refused files are left out."""
    return cells.where("error IS NULL").withColumns({"workbook_id": workbook, "version": F.lit(version), "display": structure.shown()})


def embedded(chunks: DataFrame, embed, model: str) -> DataFrame:
    """Chunks with a vector of their title and content, and the name of the model that made it."""
    return chunks.withColumns({"embedding": embed(chunk_text(F.col("title"), F.col("content"))), "embedding_model": F.lit(model)})


def tables(cells: DataFrame, facts: DataFrame, scopes: list[str], embed=None, model: str = "hashing") -> dict[str, DataFrame]:
    """chunks and structure of all workbooks of the cells, ready to be written: ids, scopes, vectors."""
    found = regions.regions(cells).join(cells.select("workbook_id", "version").distinct(), "workbook_id")
    scope = F.array(*map(F.lit, scopes)).cast("array<string>")
    chunks = documents.chunks(cells, found, facts).withColumns({"id": F.concat("node_id", F.lit("#"), "chunk_type"), "acl_scope": scope})
    return {"chunks": embedded(chunks, embed or hash_embedder(), model), "structure": structure.structure(cells, found, facts).withColumn("acl_scope", scope)}


def index(spark: SparkSession, path: str, cells: DataFrame, facts: DataFrame, version: int, scopes: list[str], embed=None, most: int | None = None) -> dict[str, int]:
    """Writes a version of each workbook; (workbook -> number of documents). A workbook with too many is refused before anything of it is written."""
    store, run = VersionedStore(spark, path), uuid.uuid4().hex
    cells = cells.withColumn("version", F.lit(version)).cache()
    out = {}
    for row in cells.select("workbook_id").distinct().orderBy("workbook_id").collect():  # one row a file
        own = cells.where(F.col("workbook_id") == row.workbook_id)
        made = tables(own, facts.where(F.col("workbook_id") == row.workbook_id), scopes, embed)
        store.write(row.workbook_id, version, made, run, **({} if most is None else {"most": most}))
        out[row.workbook_id] = sum(store.read(name, [row.workbook_id]).count() for name in made)
    cells.unpersist()
    return out
