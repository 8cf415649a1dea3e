"""Which workbooks there are below the folders that may be read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("xlsx", "xlsm", "xltx", "xltm", "xlsb", "csv", "tsv")
MOST = 200


def workbooks(spark: SparkSession, root: str, most: int = MOST) -> DataFrame:
    """(path, modified, bytes), by path; lock files are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    return files.where(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy("path").limit(most)


def resolved(path: str, roots: list[str]) -> str:
    """The real path, which must lie below one of the roots; links out of them are refused."""
    real = os.path.realpath(path)
    if not any(os.path.commonpath([real, os.path.realpath(root)]) == os.path.realpath(root) for root in roots):
        raise PermissionError(f"{path} is outside the folders that may be read")
    return real
