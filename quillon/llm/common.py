"""Shared plumbing: input tables, scratch tables in the shared folder, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scratch tables that are still on disk, by session.
_SCRATCH: dict[int, list[str]] = {}


#: Rows of an Arrow batch: whole texts of any length are in it, in Python and in the JVM at once.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Set the session to batches of BATCH rows, unless it was set to fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a temporary folder, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quillon-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, until release()."""
    if not _SCRATCH:
        atexit.register(_tidy, spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(id(spark.sparkContext), []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from a Parquet table in the shared folder.

    This cuts the lineage: a lost executor costs no more than the reading of its part.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tidy(spark: SparkSession) -> None:
    """At the end of the program; a session that was stopped leaves its tables to whoever clears the folder."""
    with contextlib.suppress(Exception):
        release(spark)


def scratch(spark: SparkSession) -> list[str]:
    """Paths of the scratch tables that are still on disk."""
    return list(_SCRATCH.get(id(spark.sparkContext), ()))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch tables: all so far, or those at paths. Call it once what reads them has been stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    held = _SCRATCH.get(id(spark.sparkContext), [])
    for path in [p for p in held if paths is None or p in paths]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        held.remove(path)


def apply(docs: DataFrame, rows: Callable, results: str) -> DataFrame:
    """docs with the columns `results` that rows (for mapInArrow) adds to its batches of `row` and `text`.

    The other columns go along as one struct, whatever their names; of those named like a result the result stays.
    """
    new = [r.split()[0] for r in results.split(", ")]
    names = [c for c in docs.columns if c not in new]
    others = [docs[f"`{c}`"] for c in names if c != "text"]
    row = F.struct(*(others or [F.lit(None).cast("int").alias("none")]))
    there = docs.select(row.alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    out = there.mapInArrow(rows, f"row {quoted(there.schema['row'].dataType)}, text string, {results}")
    return out.select(*("text" if c == "text" else F.col("row").getField(c).alias(c) for c in names), *new)


def quoted(kind: T.DataType) -> str:
    """A type as text; names in a struct are quoted."""
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kind.fields) + ">" if isinstance(kind, T.StructType) else kind.simpleString()


def trim() -> None:
    """Give freed memory back to the system: workers live on, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None


def parts(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts come to about `most` bytes: at least one row, and never part of a text."""
    if not batch.num_rows:
        return
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(ends.searchsorted(base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches together, until their texts come to `least` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def zipped(texts: pa.Array) -> pa.Array:
    """Each text compressed by itself: half of what a shuffle's own compression leaves."""
    by = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    return pa.array([by(x) for x in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()], pa.binary())


def unzipped(column: pa.Array) -> list[bytes]:
    trim()
    by = zstandard.ZstdDecompressor().decompress
    return [by(x) for x in column.to_pylist()]
