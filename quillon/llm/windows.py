"""Equal windows of a fixed length across a corpus, without a row for each window.

Each text is a sequence of symbols (bytes or words). Of the grams in a window of `length` symbols, the one
with the smallest hash is the window's anchor; equal windows have equal anchors at equal distances. A run of
windows with one anchor is a segment: (mh: the anchor's hash, sh: the hash of the segment's symbols, a: its
first window, n: its windows). So windows can only be equal within a group of equal mh, and segments of equal
(mh, sh) are equal in all their windows. Only segments of a group with several sh have to be looked into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, quoted, unzipped, written, zipped
from .textvec import _BYTES, Rolling, Texts, buffers, mixed

SEGMENTS = "doc_id long, th long, mh long, sh long, a int, n int"
#: Keys of a join that are broadcast: the most common ones. Any other has a thousandth of the rows at most.
HOT = 1000
#: Bytes of text that are cut into segments at once: their arrays, eight bytes and more for each, fit a core's cache.
PART = 1 << 16
#: Segments of an Arrow batch, about.
ROWS = 5000


def byte_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = buffers(texts)
    return _BYTES[data], at


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = Texts(texts)
    return found.word_hash(), found.words_at


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The least of key[i:i + width] for each i."""
    done = 1
    n = len(key) - width + 1
    if n <= 0:
        return key[:0]
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    return np.minimum(key[:n], key[width - done : width - done + n]) if done < width else key[:n]


def segments(symbols: np.ndarray, at: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The segments of the sequences symbols[at[i]:at[i + 1]]; seq: the sequence's number, a counts from its start."""
    n = len(symbols) - length + 1
    none = {k: np.zeros(0, np.int64) for k in ("seq", "mh", "sh", "a", "n")}
    valid = np.zeros(max(n, 0) + 1, np.int8)
    whole = np.flatnonzero(np.diff(at) >= length)
    if n <= 0 or not len(whole):
        return none
    roll = Rolling(symbols)
    grams = roll.grams(gram)
    bits = np.uint64(32)
    place = np.arange(len(grams), dtype=np.uint64)
    # half of the hash decides, whatever the batch, and of equal halves the leftmost gram: the window alone has a say in that
    least = sliding_min((grams >> bits << bits) | place, length - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    np.add.at(valid, at[whole], 1)
    np.add.at(valid, at[whole + 1] - length + 1, -1)
    ok = np.cumsum(valid[:-1], dtype=np.int8) > 0
    new = ok.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    new[at[whole]] = True
    first = np.flatnonzero(new)
    stop = ok.copy()
    stop[:-1] &= new[1:] | ~ok[1:]
    last = np.flatnonzero(stop)
    seq = np.searchsorted(at, first, side="right") - 1
    # texts without symbols share their place with the next text: searchsorted gives the last of them, which is the one meant
    return {
        "seq": seq,
        "mh": grams[anchor[first]].view(np.int64),
        "sh": roll.of(first, last + length).view(np.int64),
        "a": (first - at[seq]).astype(np.int32),
        "n": (last - first + 1).astype(np.int32),
    }


def segment_rows(sequences: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], length: int, gram: int):
    """A function for mapInArrow: from (doc_id, th, text) to SEGMENTS."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held, size = [], 0
            for batch in parts(whole, most=PART):
                found = segments(*sequences(batch.column("text")), length, gram)
                seq = pa.array(found["seq"])
                held.append([batch.column("doc_id").take(seq), batch.column("th").take(seq), *(pa.array(found[k], t) for k, t in (("mh", pa.int64()), ("sh", pa.int64()), ("a", pa.int32()), ("n", pa.int32())))])
                size += len(seq)
                if size >= ROWS:
                    yield joined(held)
                    held, size = [], 0
            if size:
                yield joined(held)

    def joined(held: list[list[pa.Array]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names=["doc_id", "th", "mh", "sh", "a", "n"])

    return rows


def keyed(docs: DataFrame, **more) -> DataFrame:
    """doc_id, th (a hash of the text, so that rows which share a doc_id are kept apart), text (null as empty) and more."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), *(c.alias(k) for k, c in more.items()))


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", zipped(batch.column("text")))


def matched(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows with the columns of table, which has each of the keys once and the number `n` of their rows: an inner join.

    The HOT most common keys are broadcast, so that none takes many rows to one task.
    """
    more = F.struct(*(c for c in table.columns if c not in keys))
    top = table.orderBy(F.desc(n), *keys).limit(HOT)
    found = rows.join(F.broadcast(top.select(*keys, more.alias("_hot"))), keys, "left")
    # rows that are found already go anywhere
    found = found.withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))).cast("int"))
    # zero, but no constant: one would be moved out of the join's keys, and found rows would go to their key's task all the same
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    rest = table.join(F.broadcast(top.select(*keys)), keys, "left_anti").select(*keys, zero.alias("_spread"), more.alias("_rest"))
    found = found.join(rest.hint("shuffle_hash"), [*keys, "_spread"], "left").withColumn("_more", F.coalesce("_hot", "_rest"))
    return found.where("_more is not null").select(*rows.columns, "_more.*")


def with_lists(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs (of keyed(); their texts compressed) with the list `segs` of the different structs `seg` of rows of the same doc_id and th."""
    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else struct_type(docs, f.name)}" for f in docs.schema.fields)
    docs = docs.mapInArrow(_zip, kinds)
    lists = rows.groupBy("doc_id", "th").agg(F.collect_set("seg").alias("segs")).withColumnsRenamed({"doc_id": "d", "th": "t"})
    same = (docs["th"] == lists["t"]) & docs["doc_id"].eqNullSafe(lists["d"])
    return docs.join(lists.hint("shuffle_hash"), same, how).drop("d", "t")


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that share doc_id and th, which have the same segments, the first of a task."""
    seen: set[tuple] = set()
    for batch in batches:
        keys = list(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), strict=True))
        fresh = [k not in seen and not seen.add(k) for k in keys]
        yield batch if all(fresh) else batch.filter(pa.array(fresh, pa.bool_()))


def struct_type(df: DataFrame, column: str) -> str:
    return quoted(df.schema[column].dataType)


def unpacked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and where each begins (one more at the end)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def each_window(sequences: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], length: int):
    """For mapInArrow, of texts with_lists(): a row for each window of the listed segments, with 128 bits of hash.

    skip: its number within the segment. Fields of `seg` other than a and n are carried along. Only for segments
    of groups that are too large for one task: windows, unlike groups, can be counted by partial aggregates.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in once(batches):
            symbols, at = sequences(pa.array(unzipped(batch.column("text")), pa.large_binary()))
            lists = batch.column("segs")
            seg, owner = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            a, n = seg.field("a").to_numpy().astype(np.int64), seg.field("n").to_numpy().astype(np.int64)
            first, second = Rolling(symbols), Rolling(mixed(symbols ^ np.uint64(0x5851F42D4C957F2D)))
            carried = [seg.type.field(i).name for i in range(seg.type.num_fields) if seg.type.field(i).name not in ("a", "n")]
            ends = np.cumsum(n)
            for low in range(0, len(n), 500):
                s = slice(low, min(low + 500, len(n)))
                which = np.repeat(np.arange(s.start, s.stop), n[s])
                skip = np.arange(len(which)) - np.repeat(ends[s] - n[s] - (ends[s.start] - n[s.start]), n[s])
                start = (at[owner] + a)[which] + skip
                took, docs = pa.array(which), pa.array(owner[which])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(r.of(start, start + length).view(np.int64)) for r in (first, second)), batch.column("doc_id").take(docs), batch.column("th").take(docs), pa.array(a[which].astype(np.int32)), pa.array(skip.astype(np.int32)), *(seg.field(c).take(took) for c in carried)],
                    names=["h1", "h2", "doc_id", "th", "a", "skip", *carried],
                )

    return rows


def crowds(kinds: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """kinds of groups of up to `most` different segments, and those of larger groups (None if there are none)."""
    large = written(kinds.groupBy("mh").count().where(F.col("count") > most).select("mh"), "crowds")
    if large.isEmpty():
        return kinds, None
    return kinds.join(large, "mh", "left_anti"), kinds.join(large, "mh", "left_semi")
