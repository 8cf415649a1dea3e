"""The document store as tables: versioned partitions, a manifest that names the active version, upserts and clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DOCUMENTS = 200_000


class TooManyDocuments(ValueError):
    """A workbook gives more documents than the store takes; nothing has been written."""


def upserted(held: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """`fresh` rows replace those of equal key."""
    return held.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def without_other_runs(df: DataFrame, scope: Column, run: str) -> DataFrame:
    """In the scope only rows of this run stay; elsewhere all."""
    return df.where(~(F.coalesce(scope, F.lit(False)) & ~F.col("ingest_run").eqNullSafe(F.lit(run))))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("index_name"), "n") for name, df in tables.items()])


def latest(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("n"))


class VersionedStore:
    """chunks and structure as Parquet tables partitioned by version key, and a manifest table.

    A version is written whole before the manifest names it; the version before is dropped after. Readers join the
    manifest, so they see the old version or the new one. One writer for a workbook at a time.
    """

    TABLES = ("chunks", "structure")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> dict[str, int]:
        """The manifest: one row a workbook."""
        fs, path = self._fs("versions")
        if not fs.exists(path):
            return {}
        rows = self.spark.read.json(f"{self.path}/versions", schema="workbook_id string, active_version int, at double")
        return {r.workbook_id: r.active_version for r in rows.groupBy("workbook_id").agg(F.max_by("active_version", "at").alias("active_version")).collect()}

    def write(self, workbook_id: str, version: int, tables: dict[str, DataFrame], run: str, most: int = MAX_DOCUMENTS) -> None:
        n = sum(df.count() for df in tables.values())
        if n > most:
            raise TooManyDocuments(f"{n} documents, at most {most}")
        before = self.versions().get(workbook_id)
        for name, df in tables.items():
            df.withColumn("ingest_run", F.lit(run)).write.mode("overwrite").parquet(self._partition(name, workbook_id, version))
        import time

        self.spark.createDataFrame([(workbook_id, version, time.time())], "workbook_id string, active_version int, at double").coalesce(1).write.mode("append").json(f"{self.path}/versions")
        if before is not None and before != version:
            for name in tables:
                fs, path = self._fs(f"{name}/version_key={workbook_id}_v{before}")
                fs.delete(path, True)

    def _partition(self, name: str, workbook_id: str, version: int) -> str:
        return f"{self.path}/{name}/version_key={workbook_id}_v{version}"

    def read(self, name: str, workbook_ids: list[str] | None = None) -> DataFrame:
        """Rows of active versions: only their partitions are listed."""
        active = {w: v for w, v in self.versions().items() if workbook_ids is None or w in workbook_ids}
        if missing := set(workbook_ids or ()) - set(active):
            raise KeyError(f"unknown workbooks: {sorted(missing)}")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(self._partition(name, w, v) for w, v in sorted(active.items())))


class TableStore:
    """Named tables that take single and bulk writes, deletes by predicate and searches. A write makes a new copy of the table; a
    reader takes the newest complete one. For small control tables (cases, settings, manifests): large ones belong in VersionedStore.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self, name: str) -> list[int]:
        fs, path = self._hadoop(f"{self.path}/{name}")
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        complete = [n for n in found if n.startswith("v") and fs.exists(self._hadoop(f"{self.path}/{name}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in complete)

    def _put(self, name: str, df: DataFrame) -> None:
        have = self._versions(name)
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v{have[-1] + 1 if have else 1}")
        for old in have[:-1]:  # the one before stays for readers that have begun
            fs, path = self._hadoop(f"{self.path}/{name}/v{old}")
            fs.delete(path, True)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def ensure(self, name: str, schema: str) -> None:
        """Creates the table if it isn't there; doing so again changes nothing."""
        if not self.exists(name):
            self._put(name, self.spark.createDataFrame([], schema))

    def drop(self, name: str) -> None:
        fs, path = self._hadoop(f"{self.path}/{name}")
        fs.delete(path, True)

    def table(self, name: str) -> DataFrame:
        have = self._versions(name)
        if not have:
            raise KeyError(f"no table {name!r}")
        return self.spark.read.parquet(f"{self.path}/{name}/v{have[-1]}")

    def bulk(self, name: str, rows: DataFrame, key: str = "id") -> None:
        """Rows replace those of equal key; of rows with equal keys in one bulk, one stays."""
        fresh = rows.dropDuplicates([key])
        self._put(name, upserted(self.table(name), fresh.select(*self.table(name).columns), key))

    def put(self, name: str, row: dict, key: str = "id") -> None:
        held = self.table(name)
        self.bulk(name, self.spark.createDataFrame([tuple(row.get(c) for c in held.columns)], held.schema), key)

    def delete(self, name: str, where: Column) -> int:
        """Deletes the rows that the predicate holds for, and says how many; rows for which it is null stay."""
        held, gone = self.table(name), F.coalesce(where, F.lit(False))
        n = held.where(gone).count()
        if n:
            self._put(name, held.where(~gone))
        return n

    def get(self, name: str, value, key: str = "id") -> dict | None:
        found = self.table(name).where(F.col(key) == F.lit(value)).limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def mget(self, name: str, values: list, key: str = "id") -> DataFrame:
        """In the order asked for; what isn't there is skipped."""
        held = self.table(name)
        asked = self.spark.createDataFrame(list(enumerate(values)), f"ordinal int, {key} {held.schema[key].dataType.simpleString()}").groupBy(key).agg(F.min("ordinal").alias("ordinal"))
        return held.join(F.broadcast(asked), key).orderBy("ordinal").drop("ordinal")

    def search(self, name: str, where: Column, size: int = 10, columns: list[str] | None = None, key: str = "id") -> DataFrame:
        found = self.table(name).where(where).orderBy(key).limit(size)
        return found.select(*columns) if columns else found

    def count(self, name: str, where: Column | None = None) -> int:
        held = self.table(name)
        return (held if where is None else held.where(where)).count()
