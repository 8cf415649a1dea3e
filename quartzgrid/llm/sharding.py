"""Sharding by size-tiered compaction: arrivals become small immutable shards, similar sizes merge, a manifest names what holds.

A store is a folder: `data` with Parquet files that never change, `manifests` with one JSON file for each version. A
version exists once its manifest has been renamed into place; the rename fails if another writer was first, and then the
commit is tried again on top of that version. Readers take the newest manifest and see whole versions only; files that
no manifest names (of writers that died) are never read. Nothing here runs Python on executors.

A manifest names the shards that are not yet of target size one by one, and the finished ones by parts: immutable files
in `parts` of PART_SHARDS names each, written once and named from then on. So a commit reads and writes what has arrived
and not been merged, and one name for each PART_SHARDS finished shards: for 100 TB in shards of 128 MB about 800 names of parts.

Rows stay as they are, whatever they hold: nulls in any column, repeated rows, very long texts and columns of any name. An
append of no rows commits a version with the table's columns.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzgrid.storage import free_name

#: Bytes of a shard that is large enough; sizes within a factor of FANOUT are of one tier; so many of a tier merge.
TARGET_BYTES, FANOUT = 128 << 20, 4
#: Merges, each written by one task, that one job makes.
MERGES_AT_ONCE = 64
#: Finished shards that one part of the manifest names.
PART_SHARDS = 1000


class ShardStore:
    """Appends, compacts and reads one table. The number of shards named in a manifest is the table's bytes over the target, plus what has just arrived."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list[tuple[str, int]]:
        """(name in the store, bytes) of the files below a folder."""
        folder = self._path(name)
        if not self.fs.exists(folder):
            return []
        root, found = self.fs.makeQualified(self._path("")).toString() + "/", []
        files = self.fs.listFiles(folder, True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString().removeprefix(root), status.getLen()))
        return sorted(found)

    def versions(self) -> list[int]:
        return sorted(int(n.rsplit("/", 1)[1].removesuffix(".json")) for n, _ in self._list("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; of a store without versions, an empty one of version 0."""
        have = self.versions()
        if version is None and not have:
            return {"version": 0, "schema": None, "shards": [], "parts": []}
        return {"parts": []} | self._read_json(f"manifests/{have[-1] if version is None else version:010d}.json")

    def _read_json(self, name: str):
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_json(self, name: str, content) -> None:
        out = self.fs.create(self._path(name), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def shards(self, manifest: dict) -> list[dict]:
        """All shards of a version: those named in it and those of its parts."""
        return [s for part in manifest["parts"] for s in self._read_json(part)] + manifest["shards"]

    def _commit(self, change) -> int:
        """change(manifest) -> the next one, or None if it no longer applies. Tried again if another writer was first."""
        while True:
            last = self.manifest()
            following = change(last)
            if following is None:
                return last["version"]
            following["version"] = last["version"] + 1
            name = f"manifests/.{uuid.uuid4().hex}"
            self._write_json(name, following)
            waiting = self._path(name)
            options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            try:
                context.rename(waiting, self.fs.makeQualified(self._path(f"manifests/{following['version']:010d}.json")), options)
                return following["version"]
            except Py4JJavaError as error:
                self.fs.delete(waiting, False)
                if "FileAlreadyExists" not in str(error.java_exception):
                    raise

    def _written(self, df: DataFrame, by: str | None = None) -> dict[str, list[dict]]:
        """The files that a write made, by value of the column `by`."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.path}/{folder}")
        found: dict[str, list[dict]] = {}
        for name, size in self._list(folder):
            if name.endswith(".parquet"):
                found.setdefault(name.split("/")[2] if by else "", []).append({"file": name, "bytes": size})
        return found

    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Adds the rows as small shards and returns the version. With `arrival`, rows of each value are an arrival of their own, written in one job and committed one after the other.

        The first append fixes the columns; later ones must have the same. No rows: a version with the columns and no new shard.
        Rows whose arrival is null are one arrival too.
        """
        schema = json.loads(df.schema.json())
        by = free_name(df.columns, "arrival")
        shards = self._written(df) if arrival is None else self._written(df.withColumn(by, arrival), by)
        shards = {k: [s for s in v if s["bytes"]] for k, v in shards.items()} or {"": []}
        version = self.manifest()["version"]
        for name in sorted(shards):
            def change(last: dict, new=shards[name]) -> dict:
                if last["schema"] and last["schema"]["fields"] != schema["fields"]:
                    raise ValueError("the columns differ from the store's")
                return {"schema": schema, "shards": last["shards"] + new, "parts": last["parts"]}

            version = self._commit(change)
        return version

    def merges(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[list[dict]]:
        """Groups of shards of one tier that are due: FANOUT or more, or as many as fill a target."""
        tiers: dict[int, list[dict]] = {}
        for shard in self.manifest()["shards"]:
            if shard["bytes"] < target / 2:
                tiers.setdefault(int(math.log(max(1, shard["bytes"]), fanout)), []).append(shard)
        due = []
        for tier in sorted(tiers):
            group, size = [], 0
            for shard in sorted(tiers[tier], key=lambda s: (s["bytes"], s["file"])):
                if size + shard["bytes"] > target:
                    due.append(group)
                    group, size = [], 0
                group.append(shard)
                size += shard["bytes"]
            if len(group) >= fanout:
                due.append(group)
        return [g for g in due if len(g) > 1]

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merges until no tier is due and returns the version. Each round's shards are larger by a tier at least, so the rounds are few, and a byte is rewritten once a tier."""
        while due := self.merges(target, fanout):
            for k in range(0, len(due), MERGES_AT_ONCE):
                batch = due[k : k + MERGES_AT_ONCE]
                merged = reduce(DataFrame.union, [self._frame(group).coalesce(1) for group in batch])
                new = [s for files in self._written(merged).values() for s in files]
                old = {s["file"] for group in batch for s in group}

                def change(last: dict, new=new, old=old) -> dict | None:
                    if not old <= {s["file"] for s in last["shards"]}:
                        return None  # another writer merged them; what this one wrote is left to vacuum()
                    return {"schema": last["schema"], "shards": [s for s in last["shards"] if s["file"] not in old] + new, "parts": last["parts"]}

                self._commit(change)
        return self._set_apart(target)

    def _set_apart(self, target: int) -> int:
        """Finished shards become parts, so many at a time that no part is small."""
        finished = [s for s in self.manifest()["shards"] if s["bytes"] >= target / 2]
        for k in range(0, len(finished) - PART_SHARDS + 1, PART_SHARDS):
            part, name = finished[k : k + PART_SHARDS], f"parts/{uuid.uuid4().hex}.json"
            self._write_json(name, part)
            gone = {s["file"] for s in part}

            def change(last: dict, name=name, gone=gone) -> dict | None:
                if not gone <= {s["file"] for s in last["shards"]}:
                    return None
                return {"schema": last["schema"], "shards": [s for s in last["shards"] if s["file"] not in gone], "parts": [*last["parts"], name]}

            self._commit(change)
        return self.manifest()["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the manifests but the newest `keep` and the files that none of these name; returns the number of files. Not while others write."""
        have = self.versions()
        held = [self.manifest(v) for v in have[-keep:]]
        named = {s["file"] for m in held for s in self.shards(m)} | {p for m in held for p in m["parts"]}
        gone = [n for folder in ("data", "parts") for n, _ in self._list(folder) if n not in named] + [f"manifests/{v:010d}.json" for v in have[:-keep]]
        for name in gone:
            self.fs.delete(self._path(name), False)
        return len(gone)

    def _frame(self, shards: list[dict], schema: dict | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(schema or self.manifest()["schema"])
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{s['file']}" for s in shards)) if shards else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. A store to which nothing was ever appended has no columns: ValueError."""
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError("nothing has been appended yet")
        return self._frame(self.shards(manifest), manifest["schema"])

    def drop_at_exit(self) -> None:
        self.fs.deleteOnExit(self._path(""))


def arrivals(key: Column, n: int = 8) -> Column:
    """Stands for the order of arrival where a table has none: a hash of the key."""
    return F.pmod(F.xxhash64(key), F.lit(n))
