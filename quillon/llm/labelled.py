"""Labelled rows with their features: a bounded sample for fitting on the driver, or all of them in a scratch table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import parts, written
from .textvec import Texts, buffers


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole):
            t = Texts(batch.column("text"))
            found = features.sparse(t)
            own = features.counts(t).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in range(2)), pa.array([x.tobytes() for x in own], pa.binary())],
                names=["doc_id", "label", "buckets", "shares", "counts"],
            )


class Sample:
    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["doc_id"], r["buckets"]))
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.found = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
        self.counts = np.array([np.frombuffer(r["counts"], np.float32) for r in rows], np.float64).reshape(len(rows), len(features.COUNTS))

    def __len__(self) -> int:
        return len(self.labels)

    def both(self) -> bool:
        return len(set(self.labels.tolist())) > 1


def sample(docs: DataFrame, labels: DataFrame, most: int) -> Sample:
    """At most `most` rows of labels (doc_id, label 0 or 1), up to half of each label, chosen by a hash of doc_id, with their whole texts' features.

    At most `most` rows of `labels` are sent to the executors and back to the driver; that bound doesn't grow.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    pick = None
    for value in (0, 1):
        own = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        pick = own if pick is None else pick.unionByName(own)
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).join(F.broadcast(pick), "doc_id").select("doc_id", "label", "text")
    return Sample(rows.mapInArrow(_features, "doc_id long, label int, buckets binary, shares binary, counts binary").limit(4 * most).collect())


#: Numbers of a sum that go through a shuffle as one row, the tasks that add them up, and the parts of the table that a task reads.
PIECE, ADDERS, PARTS = 1 << 14, 8, 8


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole):
            t = Texts(batch.column("text"))
            own = features.counts(t).astype(np.float32)
            columns: list[list[bytes]] = [[], [], [], []]
            for (bucket, share), c in zip(features.sparse(t), own, strict=True):
                kinds = np.bincount(bucket >> features.BITS, minlength=features.SIZE >> features.BITS).astype(np.int32)
                for column, x in zip(columns, (kinds, bucket.astype(np.uint16), share, c), strict=True):
                    column.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c, pa.binary()) for c in columns)], names=["label", "kinds", "buckets", "shares", "counts"])


class Packed:
    """A batch of stored(): labels, counts, and the buckets and shares of all its rows together, and how many each has."""

    def __init__(self, batch: pa.RecordBatch):
        of = lambda name, kind: buffers(batch.column(name))[0].view(kind)
        self.n = batch.num_rows
        self.labels = batch.column("label").to_numpy()
        self.counts = of("counts", np.float32).astype(np.float64).reshape(self.n, len(features.COUNTS))
        kinds = of("kinds", np.int32).reshape(self.n, -1)
        self.bucket = of("buckets", np.uint16) + np.repeat(np.tile(np.arange(kinds.shape[1], dtype=np.int32) << features.BITS, self.n), kinds.ravel())
        self.share, self.sizes = of("shares", np.float32), kinds.sum(axis=1)

    def linear(self, weights: np.ndarray) -> np.ndarray:
        """Of each row, the sum of its shares times their buckets' weights."""
        out, some = np.zeros(self.n), self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(self.share * weights[self.bucket], (np.cumsum(self.sizes) - self.sizes)[some])
        return out

    def gathered(self, own: np.ndarray) -> np.ndarray:
        """Of each bucket, the sum of its shares times their rows' own."""
        return np.bincount(self.bucket, self.share * np.repeat(own, self.sizes), features.SIZE)


def stored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs that labels (doc_id, label 0 or 1) names, with its whole text's features: written once, read by each pass of a fit."""
    known = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).join(known, "doc_id").select("label", "text")
    found = written(rows.mapInArrow(_packed, "label int, kinds binary, buckets binary, shares binary, counts binary"), "labelled")
    # a task of a pass has to begin and to send its sum, whatever it reads
    return found.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-found.rdd.getNumPartitions() // PARTS)))


def summed(rows: DataFrame, size: int, of: Callable[[Packed], np.ndarray]) -> np.ndarray:
    """The sum over all of stored()'s rows of of(batch), `size` numbers: each task's sum goes in pieces to those that add them up, so that the driver gets one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + of(Packed(batch)), True
        if seen:
            cut = range(0, size, PIECE)
            task = TaskContext.get().partitionId()
            part = [total[i : i + PIECE].astype(np.float32).tobytes() for i in cut]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([task] * len(cut), pa.int32()), pa.array(part, pa.binary())], names=["piece", "task", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("piece").to_pylist(), batch.column("part").to_pylist(), strict=True):
                held[i] = held.get(i, 0.0) + np.frombuffer(part, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["piece", "part"])

    pieces = rows.mapInArrow(partial, "piece int, task int, part binary").repartition(ADDERS, "piece").sortWithinPartitions("piece", "task")
    total = np.zeros(size)
    for r in pieces.mapInArrow(added, "piece int, part binary").collect():
        x = np.frombuffer(r["part"])
        total[r["piece"] * PIECE : r["piece"] * PIECE + len(x)] = x
    return total
