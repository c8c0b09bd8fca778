"""Structured Streaming over a collection's change log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..collection import EXPIRE, Collection
from ..plans.selection import ROW
from ..sources.store import CHANGE


def _start(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def versions(source: Collection, per_batch: int | None = None) -> DataFrame:
    """The versions of a collection, as they are published: version. per_batch holds back a flood."""
    reader = source.spark.readStream.schema("version long")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.json(f"{source.store.root}/_versions")


def change_stream(source: Collection, act: Callable[[DataFrame], None], checkpoint: str, every: str | None = None, per_batch: int | None = None) -> StreamingQuery:
    """act gets the changes of published commits, each commit whole and once, as Collection.changes() has them."""

    def told(batch: DataFrame, _: int) -> None:
        new = [r[0] for r in batch.select("version").collect()]  # a row for each commit
        if new:
            reader = Collection(source.spark, source.store.root, create=False)
            act(reader.changes(min(new) - 1, max(new)).where(F.col(CHANGE).isin(new)))

    own = _start(versions(source, per_batch), told, checkpoint, every)
    source._closing.append(own)
    return own


def replicate(source: Collection, target: Collection, checkpoint: str, every: str | None = None, per_batch: int | None = None) -> StreamingQuery:
    """Keep target like source. What a batch brings again is skipped by its commit ids, and what is due before it is applied first."""

    def apply(batch: DataFrame, _: int) -> None:
        newest = batch.agg(F.max("version")).first()[0]
        if newest is not None:
            done = target.manifest.applied.get(source.store.root, 0)
            target.replay(Collection(source.spark, source.store.root, create=False).changes(done, newest), source.store.root)

    own = _start(versions(source, per_batch), apply, checkpoint, every)
    target._closing.append(own)
    return own


def on_change(source: Collection, column: str, act: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """act gets each batch of the column's changes: commit_id, row_id, op (put or delete), value."""

    def told(changes: DataFrame) -> None:
        hit = changes.where(F.array_contains("written", column) | (F.col("op") == "delete"))
        act(hit.select(CHANGE, ROW, F.when(F.col("op") == "delete", "delete").otherwise("put").alias("op"), F.col("row").getField(column).alias("value")))

    return change_stream(source, told, checkpoint, every)


def sweep(collection: Collection, checkpoint: str, every: str = "1 second", now_ns: Callable[[], int] | None = None) -> StreamingQuery:
    """Delete expired rows again and again."""
    ticks = collection.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def act(_: DataFrame, __: int) -> None:
        collection.refresh()
        collection.vacuum(now_ns() if now_ns else None)

    own = _start(ticks, act, checkpoint, every)
    collection._closing.append(own)
    return own


def running_last(changes: DataFrame, by: str, order: str) -> DataFrame:
    """The largest order of each key so far: last write wins. Output mode update or complete."""
    return changes.groupBy(by).agg(F.max(order).alias(order))


def running_sum(deltas: DataFrame, by: str, value: str, scale: int = 2) -> DataFrame:
    """The sum of each key's deltas so far, exact to `scale` decimals."""
    return deltas.groupBy(by).agg(F.sum(F.col(value).cast(f"decimal(18,{scale})")).cast("double").alias(value))


def running_merge(deltas: DataFrame, by: str, order: str, value: str, merge: Callable[[object, object], object], start: object, kind: str = "string") -> DataFrame:
    """Each key's value after its deltas so far, merged one by one in the order of a column. Output mode update."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for delta in rows[value]:
            now = merge(now, delta)
        state.update((now,))
        yield pd.DataFrame({by: [key[0]], value: [now]})

    types = {f.name: f.dataType.simpleString() for f in deltas.schema.fields}
    return deltas.groupBy(by).applyInPandasWithState(fold, f"{by} {types[by]}, {value} {kind}", f"now {kind}", "update", GroupStateTimeout.NoTimeout)


__all__ = ["EXPIRE", "change_stream", "on_change", "replicate", "running_last", "running_merge", "running_sum", "sweep", "versions"]
