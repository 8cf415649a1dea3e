"""Where intermediate tables go: the folder that driver and executors share, lineage cuts and tables kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of a join is broadcast; a larger side is shuffled.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The configured checkpoint folder; where none is set, a temporary folder on a local master, else one in the default file system's home."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        else:
            files = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
            context.setCheckpointDir(f"{files.getHomeDirectory().toString()}/.quartzgrid")
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that a lost executor costs no recomputation from the source."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Workspace:
    """Parquet tables in a folder of their own below the shared one: like cut(), but packed, and without a partitioning of
    their own, so that joins of them can be dealt anew where a key is frequent. What is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(self._path(self.folder))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self._path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def small(self, name: str, bytes_per_row: int) -> bool:
        """Whether a kept table may be broadcast: counted rows times what a row takes in memory."""
        return self.spark.read.parquet(f"{self.folder}/{name}").count() * bytes_per_row <= BROADCAST_BYTES


def numbered(df: DataFrame) -> DataFrame:
    """The columns renamed by place, c0, c1, ...: names that an operator adds beside them can't clash."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place_of(df: DataFrame, column: str) -> str:
    """The name in numbered(df) of a column: the one spelt so, or else the first that differs in case only."""
    exact = [k for k, name in enumerate(df.columns) if name == column]
    found = exact or [k for k, name in enumerate(df.columns) if name.lower() == column.lower()]
    if not found:
        raise ValueError(f"no column {column!r} among {df.columns}")
    return f"c{found[0]}"


def picked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """new name -> column, whatever other columns are called."""
    return numbered(df).select(*(F.col(place_of(df, old)).alias(new) for new, old in names.items()))


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, with underscores after it until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
