"""Stored sessions, memories, index manifests and index rows: Parquet, a folder for each session.

A session's rows of a table lie in root/table/session_id=<id>/v<n>. A write goes to the next version's folder, which
counts from when Spark marks it as complete, so readers see either the old or the new state, no table is overwritten
while it is read, and a command touches the rows of its own session only. New memories are appended to the version
in use: nothing that is stored is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlattice import schema
from memlattice.functions.text import valid_session_id
from memlattice.plans.manifest import STORE_RULES, invalid_stores

TABLES = {"sessions": schema.SESSIONS, "memories": schema.MEMORIES, "manifest": schema.MANIFEST}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _folder(self, name: str, session_id: str) -> str:
        return f"{self.root}/{name}/session_id={session_id}"

    def names_in(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _version(self, folder: str) -> int:
        done = [x for x in self.names_in(folder) if x.startswith("v") and self.exists(f"{folder}/{x}/_SUCCESS")]
        return max((int(x[1:]) for x in done), default=-1)

    def read(self, name: str, session_id: str | None = None) -> DataFrame:
        """The rows of a session, or of all."""
        ids = [x.removeprefix("session_id=") for x in self.names_in(f"{self.root}/{name}") if x.startswith("session_id=")] if session_id is None else [session_id]
        paths = [f"{f}/v{v}" for f in (self._folder(name, i) for i in ids) if (v := self._version(f)) >= 0]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])

    def append(self, name: str, session_id: str, rows: DataFrame) -> None:
        """Adds rows to a session's; what is stored stays as it is."""
        folder = self._folder(name, session_id)
        self._typed(name, rows).write.mode("append").parquet(f"{folder}/v{max(0, self._version(folder))}")

    def replace(self, name: str, session_id: str, rows: DataFrame | None) -> None:
        """A session's rows replaced, or removed. The version before stays for readers that still use it, older ones go."""
        folder = self._folder(name, session_id)
        if rows is None:
            return self.remove(folder)
        version = self._version(folder) + 1
        self._typed(name, rows).write.mode("overwrite").parquet(f"{folder}/v{version}")
        if version > 1:
            self.remove(f"{folder}/v{version - 2}")

    def scan(self) -> DataFrame:
        """Sessions with a valid id, others are skipped silently."""
        return self.read("sessions").where(valid_session_id(F.col("session_id")))

    def load(self, session_id: str) -> tuple[DataFrame, DataFrame]:
        """A session's row and memories; an error if it is not there, or the first rule that it breaks."""
        s, m = (self.read(n, session_id) for n in ("sessions", "memories"))
        if s.isEmpty():
            raise KeyError(f"session not found: {session_id}")
        wrong = invalid_stores(s, m).orderBy(F.array_position(F.array(*map(F.lit, STORE_RULES)), F.col("error"))).first()
        if wrong:
            raise ValueError(f"{wrong['error']} in store")
        if m.limit(schema.MAX_SESSION_RECORDS + 1).count() > schema.MAX_SESSION_RECORDS:
            raise ValueError("too many memories in store")
        return s, m

    def loadable(self) -> DataFrame:
        """The sessions that load() takes; others are skipped silently."""
        s, m = self.scan(), self.read("memories")
        return s.join(invalid_stores(s, m).select("session_id").distinct(), "session_id", "left_anti")


def session_index(root: str, scorer: str, session_id: str) -> str:
    """Where the index rows of a session lie, in a folder segment_id=<n> for each segment."""
    return f"{root}/scorer_key={scorer}/session_id={session_id}"


def write_index(rows: DataFrame, root: str, scorer: str) -> None:
    """Index rows by segment; only the partitions of the segments written are replaced."""
    out = rows.withColumn("scorer_key", F.lit(scorer))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scorer_key", "session_id", "segment_id").parquet(root)


def read_index(spark: SparkSession, root: str, scorer: str, types: StructType | None = None) -> DataFrame:
    found = spark.read if types is None else spark.read.schema(types)
    return found.parquet(root).where(F.col("scorer_key") == scorer).drop("scorer_key")
