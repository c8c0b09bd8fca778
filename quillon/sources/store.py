"""A versioned folder: a Parquet base, Parquet changes since, and a manifest for each version.

A version is published by creating its manifest, which fails if another writer was first; readers see the
newest manifest and nothing that isn't in it. Files have names of their own, so that what a writer leaves that
died before it published is in nobody's way. All access goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.selection import ROW

#: Changes of so many bytes at most are broadcast to the base's rows; larger ones are joined by a shuffle.
SMALL = 32 << 20
CHANGE = "commit_id"


class Conflict(RuntimeError):
    """Another transaction was published first."""


@dataclass
class Manifest:
    version: int = 0
    base: str | None = None
    base_commit: int = 0
    changes: list[dict] = field(default_factory=list)  # version, path, bytes, and whether it only adds rows
    kinds: dict[str, dict] = field(default_factory=dict)
    indexes: dict[str, list[str]] = field(default_factory=dict)
    sorts: dict[str, str] = field(default_factory=dict)
    next_row: int = 0
    applied: dict[str, int] = field(default_factory=dict)  # the newest commit of another collection that was replayed


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest_path(self, version: int):
        return self._path(f"{self.root}/_versions/{version:020d}.json")

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_versions")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json") and s.getLen())

    def load(self, version: int | None = None) -> Manifest:
        there = self.versions()
        if not there:
            raise FileNotFoundError(self.root)
        at = there[-1] if version is None else version
        stream = self.fs.open(self._manifest_path(at))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def publish(self, manifest: Manifest) -> None:
        """Make it the newest version. The file is created whole or not at all, and never twice."""
        done, draft = self._manifest_path(manifest.version), self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        if self.fs.exists(done):
            raise Conflict(f"version {manifest.version} of {self.root} is there already")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(done.toUri() if done.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(done), none)  # fails where the target exists
        except Exception as e:
            self.fs.delete(draft, False)
            raise Conflict(f"version {manifest.version} of {self.root}: {str(e)[:200]}") from None

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        at = self._path(path)
        return self.fs.getContentSummary(at).getLength() if self.fs.exists(at) else 0


def change_schema(kinds: dict[str, T.DataType]) -> T.StructType:
    """A changed row: its id, insert, put or delete, the columns that were written, their values, and the commit."""
    head = [T.StructField(ROW, T.LongType()), T.StructField("op", T.StringType()), T.StructField("written", T.ArrayType(T.StringType()))]
    return T.StructType([*head, T.StructField("row", T.StructType([T.StructField(c, t) for c, t in kinds.items()])), T.StructField(CHANGE, T.LongType())])


def folded(changes: DataFrame, columns: list[str], once: bool = False) -> DataFrame:
    """For each row the last value written to each column, which were written, and whether it was inserted or deleted.

    One partial aggregate and one shuffle by row, whatever the number of commits; none for the changes of one
    commit (once), which has a row once.
    """
    at = F.col(CHANGE)
    if once:
        wrote = lambda c: F.when(F.array_contains("written", c), F.struct(F.col("row").getField(c).alias("v")))
        return changes.select(ROW, (F.col("op") == "delete").alias("gone"), (F.col("op") == "insert").alias("new"), F.struct(*(wrote(c).alias(c) for c in columns)).alias("last"))
    lasts = []
    for c in columns:
        when = F.when(F.array_contains("written", c), at)
        # apart, so that numbers are aggregated in place
        lasts += [F.max_by(F.col("row").getField(c), when).alias(f"last_{c}"), F.max(when).alias(f"when_{c}")]
    # a row that is inserted again after it was deleted is there: replicas see that
    ends = [F.max(F.when(F.col("op") == op, at)).alias(op) for op in ("delete", "insert")]
    out = changes.groupBy(ROW).agg(*ends, *lasts)
    gone = F.col("delete").isNotNull() & (F.col("insert").isNull() | (F.col("insert") < F.col("delete")))
    last = F.struct(*(F.when(F.col(f"when_{c}").isNotNull(), F.struct(F.col(f"last_{c}").alias("v"))).alias(c) for c in columns))
    return out.select(ROW, gone.alias("gone"), F.col("insert").isNotNull().alias("new"), last.alias("last"))


def read(store: Store, manifest: Manifest, kinds: dict[str, T.DataType]) -> DataFrame:
    """The rows of a version: the base, and what changed since."""
    spark, columns = store.spark, list(kinds)
    whole = T.StructType([T.StructField(ROW, T.LongType()), *(T.StructField(c, t) for c, t in kinds.items())])
    base = spark.read.schema(whole).parquet(manifest.base) if manifest.base else spark.createDataFrame([], whole)
    since = [c for c in manifest.changes if c["version"] > manifest.base_commit]
    if not since:
        return base
    files = lambda some: spark.read.schema(change_schema(kinds)).parquet(*(c["path"] for c in some))
    # rows that were only added have ids of their own: no join
    adding, since = [c for c in since if c.get("adds")], [c for c in since if not c.get("adds")]
    if adding:
        base = base.unionByName(files(adding).select(ROW, *(F.col("row").getField(c).alias(c) for c in columns)))
    if not since:
        return base
    fold = folded(files(since), columns, len(since) == 1).withColumnRenamed(ROW, "_row")
    put = lambda c: F.when(F.col("last").getField(c).isNotNull(), F.col("last").getField(c).getField("v")).otherwise(F.col(c)).alias(c)
    if sum(c["bytes"] for c in since) <= SMALL:
        old = base.join(F.broadcast(fold), F.col(ROW) == F.col("_row"), "left").where("not coalesce(gone or new, false)").select(ROW, *map(put, columns))
        added = fold.where("new and not gone").select(F.col("_row").alias(ROW), *(F.col("last").getField(c).getField("v").alias(c) for c in columns))
        return old.unionByName(added)
    both = base.join(fold, F.col(ROW) == F.col("_row"), "full").where(f"not coalesce(gone, false) and ({ROW} is not null or new)")
    return both.select(F.coalesce(ROW, "_row").alias(ROW), *map(put, columns))
