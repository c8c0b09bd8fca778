"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts elsewhere.

1. Each text is cut into segments (windows.py): about one small row for 190 bytes, no row for each suffix.
2. A segment equal to another repeats as a whole. Segments that share their anchor with a different segment
   are fetched, one copy of each, and dealt by the anchor, so that equal strings meet in one block. (A group of
   over CROWD different segments would not fit one task; its strings are counted by 128 bits of hash instead.)
3. A block's suffixes are sorted in two stages: those smaller than their successors directly, the rest by one
   scan over the buckets. Adjacent suffixes with a common prefix of `length` bytes repeat.

The same goes for strings of words, as numbers of one width in bytes: a passage of many short words is shorter
than any string of bytes that is long enough not to be chance.

Null and empty texts have nothing to remove. Rows with equal texts are copies of one another, whatever their
doc_id. Input columns named `kept`, `spans` or `passages` give way to the result's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import unzipped, written
from .textvec import Texts

LENGTH, GRAM, WORD_GRAM = 400, 16, 6
#: Starts that are sorted together at most, as long as a block holds more than one group.
BLOCK = 60_000
#: Above so many suffixes they are sorted by eight bytes at a time, with less memory than a list of their strings.
LISTED = 80_000
#: Different segments of a group that one task sorts at most. The windows of larger groups are counted by hash.
CROWD = 20_000


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number whose order is theirs."""
    padded = np.concatenate([text, np.full(8, 255, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text)]
    return out


def direct_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `at`, in the order of their first `depth` bytes."""
    if len(at) <= LISTED:
        whole = text.tobytes() + b"\xff" * depth
        keys = [whole[i:j] for i, j in zip(at.tolist(), (at + depth).tolist(), strict=True)]
        return at[sorted(range(len(keys)), key=keys.__getitem__)]
    words = _words(text)
    order, group = at, np.zeros(len(at), np.int64)
    out, open_ = at.copy(), np.arange(len(at))
    for d in range(0, depth, 8):
        where = order + d
        key = np.where(where < len(words), words[np.minimum(where, len(words) - 1)], np.uint64(2**64 - 1))
        by = np.lexsort((key, group))
        order, group, key = order[by], group[by], key[by]
        out[open_] = order
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        order, open_ = order[~alone], open_[~alone]
        if not len(order):
            break
    return out


def two_stage(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes `starts` (flags) of text, sorted by `depth` bytes at least, and each one's common prefix with the one before, up to depth.

    text consists of parts that each end with the byte 255, which is in none of them.
    """
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = 1
    decides = np.where(step != 0, np.arange(n), n - 1)
    rises = step[np.minimum.accumulate(decides[::-1])[::-1]] > 0  # smaller than its successor
    # beside the starts, the order of a falling suffix needs those that follow it, up to the next rising one
    next_rise = np.minimum.accumulate(np.where(rises, np.arange(n), n - 1)[::-1])[::-1]
    where = np.flatnonzero(starts)
    needed = starts.astype(np.int64) - np.bincount(next_rise[where] + 1, minlength=n + 1)[:n]
    needed = np.cumsum(needed) > 0
    direct = direct_sort(text, np.flatnonzero(needed & rises), depth)
    falls = np.append(needed & ~rises, False)  # place -1 is the last
    edges = np.searchsorted(text[direct], np.arange(257))
    arrived: dict[int, list[np.ndarray]] = {}
    order = []
    for c in np.unique(text[needed]).tolist():
        level = np.concatenate(arrived.pop(c, [direct[:0]]))
        bucket = [level]
        while len(level):
            before = level - 1
            before = before[falls[before]]
            level = before[text[before] == c]
            bucket.append(level)
        bucket = np.concatenate([*bucket, direct[edges[c] : edges[c + 1]]])
        order.append(bucket)
        before = bucket - 1
        before = before[falls[before]]
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            cuts = np.flatnonzero(np.diff(first[by])) + 1
            for part in np.split(before[by], cuts):
                arrived.setdefault(int(text[part[0]]), []).append(part)
    order = np.concatenate(order) if order else direct
    order = order[starts[order]]
    return order, adjacent_prefixes(text, order, depth)


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, depth: int, step: int = 64, most: int = 1 << 16) -> np.ndarray:
    """How many bytes, up to depth, each suffix of order shares with the one before it; `most` at a time."""
    common = np.zeros(len(order), np.int32)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth + step, np.uint8)]), step)
    for low in range(1, len(order), most):
        open_ = np.arange(low, min(low + most, len(order)))
        for d in range(0, depth, step):
            differ = rows[order[open_] + d] != rows[order[open_ - 1] + d]
            first = differ.argmax(1)
            same = ~differ[np.arange(len(open_)), first]
            common[open_] = d + np.where(same, step, first)
            open_ = open_[same]
            if not len(open_):
                break
    common[1:] = np.minimum(common[1:], len(text) - np.maximum(order[1:], order[:-1]))
    return np.minimum(common, depth)


def word_codes(texts: list[bytes]) -> tuple[list[bytes], int]:
    """Each text's words as numbers of one width in bytes (the same number for the same word), none of them the byte 255; and the width."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    found = [np.fromiter(map(number.__getitem__, x.split()), np.int64) for x in texts]
    width = 1
    while 255**width < len(number):
        width += 1
    powers = 255 ** np.arange(width - 1, -1, -1, dtype=np.int64)
    return [(x[:, None] // powers % 255).astype(np.uint8).tobytes() for x in found], width


def repeated_starts(texts: list[bytes], counts: list[int], length: int, width: int = 1) -> list[np.ndarray]:
    """For each text, flags of those of its first counts[i] starts whose `length` symbols of `width` bytes also start elsewhere in these texts."""
    size = np.array([len(x) + 1 for x in texts])
    at = np.concatenate([[0], np.cumsum(size)])
    text = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(text), bool)
    own = [slice(at[i], at[i] + n * width, width) for i, n in enumerate(counts)]
    for s in own:
        starts[s] = True
    order, common = two_stage(text, starts, length * width)
    found = np.zeros(len(text), bool)
    same = np.flatnonzero(common >= length * width)
    found[order[same]] = True
    found[order[same - 1]] = True
    return [found[s] for s in own]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cut(length: int, words: bool):
    """The bytes of the wanted segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in windows.once(batches):
            lists = batch.column("segs")
            seg, owner = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            a, n = seg.field("a").to_numpy(), seg.field("n").to_numpy()
            if words:
                found = Texts(pa.array(unzipped(batch.column("text")), pa.large_binary()))
                data, first = found.data, found.words_at[owner] + a
                begin, stop = found.start[first], found.end[first + n - 1 + length - 1]
            else:
                data, at = windows.unpacked(unzipped(batch.column("text")))
                begin = at[owner] + a
                stop = begin + n - 1 + length
            for i in range(0, len(owner), 2000):
                s = slice(i, i + 2000)
                bits = pa.array([data[x:y].tobytes() for x, y in zip(begin[s], stop[s], strict=True)], pa.binary())
                who = pa.array(owner[s])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(who), batch.column("th").take(who), *(seg.field(k)[i : i + 2000] for k in ("mh", "sh", "alone", "a", "n")), bits],
                    names=["doc_id", "th", "mh", "sh", "alone", "a", "n", "bits"],
                )

    return rows


def _sort_blocks(length: int, words: bool):
    def flush(held: list) -> pa.RecordBatch:
        cols = {k: [] for k in ("doc_id", "th", "a", "n")}
        texts, width = word_codes([x[5] for x in held]) if words else ([x[5] for x in held], 1)
        for (doc, th, alone, a, _, _), flags in zip(held, repeated_starts(texts, [x[4] for x in held], length, width), strict=True):
            if alone:
                for x, y in zip(*runs(flags), strict=True):
                    for k, v in zip(cols, (doc, th, a + int(x), int(y - x)), strict=True):
                        cols[k].append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], pa.int64()), pa.array(cols["th"], pa.int64()), pa.array(cols["a"], pa.int32()), pa.array(cols["n"], pa.int32())], names=list(cols))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for mh, sh, *row in zip(*(batch.column(k).to_pylist() for k in ("mh", "sh", "doc_id", "th", "alone", "a", "n", "bits")), strict=True):
                if last == (mh, sh):
                    continue  # of another row with the same doc_id and text
                if size >= BLOCK and mh != last[0]:
                    yield flush(held)
                    held, size = [], 0
                last = (mh, sh)
                held.append(tuple(row))
                size += row[4]
        if held:
            yield flush(held)

    return rows


def _covered(segs: list[dict], n: int, length: int) -> np.ndarray:
    """Flags of the n symbols of a text that the windows of segs cover."""
    gone = np.zeros(n + 1, np.int32)
    for s in segs:
        gone[s["a"]] += 1
        gone[s["a"] + s["n"] - 1 + length] -= 1
    return np.cumsum(gone[:-1]) > 0


def _strip(length: int, passage: int | None, cut_passages: bool, as_text: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    listed = lambda x, y: [{"start": int(i), "end": int(j)} for i, j in zip(x, y, strict=True)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unzipped(batch.column("text"))
            kept, spans, passages = [], [], []
            for text, segs in zip(texts, batch.column("segs").to_pylist(), strict=True):
                own = [s for s in segs or () if not s["words"]]
                gone = _covered(own, len(text), length)
                spans.append(listed(*runs(gone)) if own else [])
                own = [s for s in segs or () if s["words"]]
                if own:
                    found = Texts(pa.array([text], pa.large_binary()))
                    x, y = runs(_covered(own, len(found.start), passage))
                    passages.append(listed(found.start[x], found.end[y - 1]))
                    if cut_passages:  # and the white space up to the next word
                        for i, j in zip(found.start[x], np.append(found.start, len(text))[y], strict=True):
                            gone[i:j] = True
                else:
                    passages.append([])
                left = np.frombuffer(text, np.uint8)[~gone].tobytes() if segs else text
                # of a character that was cut nothing stays
                kept.append(left.decode("utf-8", "ignore").encode() if as_text and segs else left)
            left = pa.array(kept, pa.binary())
            cols = [batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), left.cast(pa.string()) if as_text else left, pa.array(spans, kind), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "text", "kept", "spans", "passages"])

    return rows


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, words: bool = False) -> DataFrame:
    """doc_id, th and seg (struct a, n): the n starts from symbol a on begin a string of `length` symbols that is also elsewhere.

    Symbols are bytes or, if `words`, words.
    """
    base, symbols = windows.keyed(docs), windows.word_symbols if words else windows.byte_symbols
    segs = base.mapInArrow(windows.segment_rows(symbols, length, gram), windows.SEGMENTS)
    groups = segs.groupBy("mh").agg(F.count("*").alias("copies"), (F.min("sh") != F.max("sh")).alias("mixed"))
    groups = written(groups.where("copies > 1"), "suffix-groups")
    shared = written(windows.matched(segs, groups, ["mh"], "copies").drop("copies"), "suffix-shared")
    mixed = shared.where("mixed").drop("mixed")
    kinds = written(mixed.groupBy("mh", "sh").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "a", "n")).alias("first")), "suffix-kinds")
    usual, crowded = windows.crowds(kinds, crowd)
    wanted = lambda k: k.select("first.doc_id", "first.th", F.struct("mh", "sh", (F.col("copies") == 1).alias("alone"), "first.a", "first.n").alias("seg"))
    pieces = windows.with_lists(base, wanted(usual), "inner").select("doc_id", "th", "text", "segs").mapInArrow(_cut(length, words), "doc_id long, th long, mh long, sh long, alone boolean, a int, n int, bits binary")
    sorted_ = pieces.repartition("mh").sortWithinPartitions("mh", "sh").mapInArrow(_sort_blocks(length, words), "doc_id long, th long, a int, n int")
    copied = windows.matched(mixed, kinds.where("copies > 1").select("mh", "sh", "copies"), ["mh", "sh"], "copies")
    found = [shared.where("not mixed"), copied, sorted_]
    if crowded is not None:
        each = windows.with_lists(base, wanted(crowded), "inner").select("doc_id", "th", "text", "segs")
        each = each.mapInArrow(windows.each_window(symbols, length), "h1 long, h2 long, doc_id long, th long, a int, skip int, mh long, sh long, alone boolean").drop("mh", "sh")
        twice = written(each.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1"), "suffix-windows")
        found.append(windows.matched(each.where("alone"), twice, ["h1", "h2"], "copies").select("doc_id", "th", (F.col("a") + F.col("skip")).alias("a"), F.lit(1).alias("n")))
    found = [x.select("doc_id", "th", F.struct("a", "n").alias("seg")) for x in found]
    return reduce(DataFrame.unionByName, found)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False, crowd: int = CROWD, passage: int | None = None, cut_passages: bool = False) -> DataFrame:
    """docs with `kept` (the text's bytes that are left), `spans` (start and end of each removed run of bytes) and `passages`.

    as_text: kept is a string, without what is left of a character that was cut.
    passage: `passages` are the runs of bytes of those words that a window of so many words covers which also starts
    elsewhere: they may have fewer than `length` bytes, and other white space. cut_passages: kept is without them, too.
    """
    names = [c for c in docs.columns if c not in ("kept", "spans", "passages")]
    there = windows.keyed(docs, row=F.struct(*(docs[f"`{c}`"] for c in names if c != "text")))
    tagged = lambda found, words: found.select("doc_id", "th", F.struct("seg.a", "seg.n", F.lit(words).alias("words")).alias("seg"))
    segs = tagged(repeats(docs, length, gram, crowd), False)
    if passage is not None:
        segs = segs.unionByName(tagged(repeats(docs, passage, min(WORD_GRAM, passage), crowd, words=True), True))
    found = windows.with_lists(there, segs, "left").select("row", "text", "segs")
    spans = "array<struct<start: int, end: int>>"
    out = found.mapInArrow(_strip(length, passage, cut_passages, as_text), f"row {windows.struct_type(found, 'row')}, text string, kept {'string' if as_text else 'binary'}, spans {spans}, passages {spans}")
    return out.select(*("text" if c == "text" else F.col("row").getField(c).alias(c) for c in names), "kept", "spans", "passages")
