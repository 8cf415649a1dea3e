"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. `run` writes each stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quartzgrid.llm import decontamination, line_dedup, near_copies, packing, quality_classifier
from quartzgrid.storage import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.3 go.

    Null ids are judged like others, null and empty texts by their statistics, repeated rows alike, very long texts whole.
    Without labels all documents score the same and stay. An empty table stays empty; columns of any name stay as they are.
    """
    machine = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, machine, 0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly so, go from the texts; the documents stay, and n_chars follows.

    Null texts stay null and rows with a null id stay as they are; empty texts and empty lines stay; of equal lines the one
    of the smallest id, then of the smallest line number, stays. Repeated rows are changed alike. Very long lines and texts are
    taken whole. An empty table stays empty; other columns may have any name.
    """
    return line_dedup.dedup_lines(docs, length_column="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of repeated rows one.

    Rows with a null id stay; texts without words are copies of each other, null ones too; documents with equal ids and other
    texts are documents of their own. Very long texts are compared whole. An empty table stays empty; columns may have any name.
    """
    return near_copies.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go.

    Null and empty texts hold none; rows with null ids, equal ids and repeated rows are judged by their own text, whole
    however long. Items without words match nothing. Empty tables on either side leave all rows; columns may have any name.
    """
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, as pieces of documents.

    Null and empty texts are documents of one token; null ids stay null; repeated rows are documents of their own; long ones
    are cut. An empty table gives no rows; other columns are not read, whatever their names.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: The stages use a trained model, edit distances and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
