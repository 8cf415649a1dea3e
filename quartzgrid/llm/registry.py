"""The queries opN over the driver's tables, with the parameters meant for production."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from quartzgrid.catalog import Catalog, table
from quartzgrid.llm import decontamination, line_dedup, neighbours, packing, quality_classifier, secret_scan, sharding, simhash, sql, substring_dedup, token_counts
from quartzgrid.storage import shared_folder

CATALOG = Catalog()


@CATALOG.query("op1_packing")
def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@CATALOG.query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@CATALOG.query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    machine = quality_classifier.train(documents, table(spark, sf_dir, "labels"))
    return quality_classifier.score(documents, machine).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@CATALOG.query("op10_simhash")
def op10_simhash(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))


@CATALOG.query("op3_neighbours", sql.NEIGHBOURS)
def op3_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@CATALOG.query("op4_substring_dedup", sql.PASSAGES)
def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_passages(table(spark, sf_dir, "documents"))


def _of_kind(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@CATALOG.query("op7_secret_scan", sql.SECRETS)
def op7_secret_scan(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = secret_scan.scan(documents, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    live = F.size(F.filter("base", lambda s: s["live"])).cast("long")
    return found.select("doc_id", *(_of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"), live.alias("n_live"))


@CATALOG.query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_removed"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@CATALOG.query("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    leaks = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(F.col("id").alias("doc_id"), "item_id", "start", "n_words", "similarity")


@CATALOG.query("op9_sharding", sql.SHARDS)
def op9_sharding(spark, sf_dir):
    store = sharding.ShardStore(spark, f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}")
    store.drop_at_exit()
    store.append(table(spark, sf_dir, "documents"), sharding.arrivals(F.col("doc_id")))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
