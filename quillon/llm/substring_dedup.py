"""Substring dedup by repeated-phrase automata, on windows of `length` consecutive words.

A word is removed if a window that covers it has words that also start in a document with a smaller doc_id.

1. Each text is cut into segments of windows with one anchor (windows.py); equal windows meet under equal anchors.
2. Of each group of segments with one anchor, one copy of each different segment is fetched and dealt by the
   anchor. A shard confirms the phrases that recur in its segments, compiles them into an Aho-Corasick automaton
   and streams the segments through it: it locates each occurrence, and with that the smallest doc_id that has the
   phrase. (A group of over CROWD different segments would not fit one task; its windows meet by 128 bits of hash
   instead.)
3. What was located applies to every document with an equal segment.

A null or empty text has no words. A null doc_id is never the smaller one and keeps all its words. Rows that
share a doc_id don't remove from each other. Input columns named `kept`, `n_words` or `spans` give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import unzipped, written
from .suffix_dedup import runs
from .textvec import Rolling, Texts, mixed

LENGTH, GRAM = 50, 6
#: Windows in one automaton at most, as long as it serves more than one group of segments.
SHARD = 20_000
#: Different segments of a group that one task takes at most. The windows of larger groups meet by hash.
CROWD = 20_000
_GAP = range(0xD800, 0xE000)


def _cut(length: int):
    """The words of the wanted segments, as text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in windows.once(batches):
            found = Texts(pa.array(unzipped(batch.column("text")), pa.large_binary()))
            lists = batch.column("segs")
            seg, owner = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            first = found.words_at[owner] + seg.field("a").to_numpy()
            last = first + seg.field("n").to_numpy() - 1 + length - 1
            begin, stop = found.start[first], found.end[last]
            for i in range(0, len(owner), 2000):
                bits = pa.array([found.data[x:y].tobytes() for x, y in zip(begin[i : i + 2000], stop[i : i + 2000], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(seg.field(k)[i : i + 2000] for k in ("mh", "sh", "least", "n")), bits], names=["mh", "sh", "least", "n", "bits"])

    return rows


def recurring(segments: list[np.ndarray], length: int) -> list[tuple[int, int]]:
    """A place (segment, first word) of each phrase of `length` words that is in several places, by 64 bits of hash."""
    sizes = np.array([len(x) for x in segments])
    at = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(segments)), counts)
    skip = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = at[which] + skip
    hashes = Rolling(mixed(np.concatenate(segments).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).of(start, start + length)
    _, first, times = np.unique(hashes, return_index=True, return_counts=True)
    first = first[times > 1]
    return list(zip(which[first].tolist(), skip[first].tolist(), strict=True))


def locate(segments: list[tuple[int | None, list[bytes]]], length: int) -> list[list[tuple[int, int, int | None]]]:
    """For each segment (smallest doc_id, words): runs of its windows (first, number, smallest doc_id of all segments with that window)."""
    code: dict[bytes, int] = {}
    codes = [np.array([code.setdefault(w, len(code) + 1) for w in words], np.int64) for _, words in segments]
    texts = ["".join(map(chr, np.where(c < _GAP.start, c, c + len(_GAP)).tolist())) for c in codes]
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    phrases = recurring(codes, length)
    for n, (i, at) in enumerate(phrases):
        machine.add_word(texts[i][at : at + length], n)
    smallest: list[int | None] = [None] * len(phrases)
    places: list[list[tuple[int, int]]] = [[] for _ in segments]
    if phrases:
        machine.make_automaton()
        for (least, _), text, own in zip(segments, texts, places, strict=True):
            for end, n in machine.iter(text):
                own.append((end - length + 1, n))
                if least is not None and (smallest[n] is None or least < smallest[n]):
                    smallest[n] = least
    out = []
    for (least, _), text, own in zip(segments, texts, places, strict=True):
        best = [least] * (len(text) - length + 1)
        for at, n in own:
            best[at] = smallest[n]
        edges = [0, *(i for i in range(1, len(best)) if best[i] != best[i - 1]), len(best)]
        out.append([(x, y - x, best[x]) for x, y in zip(edges, edges[1:], strict=False) if y > x])
    return out


def _shards(length: int):
    def flush(held: list) -> pa.RecordBatch:
        out = [(mh, sh, *run) for (mh, sh, _, _), found in zip(held, locate([(x[2], x[3].split()) for x in held], length), strict=True) for run in found if run[2] is not None]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["mh", "sh", "skip", "run", "least"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for mh, sh, least, n, bits in zip(*(batch.column(k).to_pylist() for k in ("mh", "sh", "least", "n", "bits")), strict=True):
                if held and (mh, sh) == held[-1][:2]:
                    continue  # of another row with the same doc_id and text
                if mh != last and size >= SHARD:
                    yield flush(held)
                    held, size = [], 0
                last = mh
                held.append((mh, sh, least, bits))
                size += n
        if held:
            yield flush(held)

    return rows


def _strip(length: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unzipped(batch.column("text"))
            kept, spans, total = [], [], []
            for text, segs in zip(texts, batch.column("segs").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                own: list[dict] = []
                if segs:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for s in segs:
                        gone[s["a"]] += 1
                        gone[s["a"] + s["n"] - 1 + length] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    own = [{"start": int(x), "end": int(y)} for x, y in zip(*runs(gone), strict=True)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(words))
                spans.append(own)
            strings = [pa.array(x, pa.binary()).cast(pa.string()) for x in (texts, kept)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *strings, pa.array(total, pa.int64()), pa.array(spans, kind)], names=["row", "text", "kept", "n_words", "spans"])

    return rows


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, th and seg (struct a, n): the n windows from word a on also start in a document with a smaller doc_id."""
    base = windows.keyed(docs)
    segs = base.mapInArrow(windows.segment_rows(windows.word_symbols, length, gram), windows.SEGMENTS)
    groups = segs.groupBy("mh").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("copies"), (F.min("sh") != F.max("sh")).alias("mixed"))
    groups = written(groups.where("least < most").select("mh", "least", "mixed", "copies"), "phrase-groups")
    shared = written(windows.matched(segs, groups, ["mh"], "copies").drop("copies"), "phrase-shared")
    several = shared.where("mixed").drop("least", "mixed")
    kinds = written(several.groupBy("mh", "sh").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "a", "n")).alias("first")), "phrase-kinds")
    usual, crowded = windows.crowds(kinds, crowd)
    wanted = lambda k: k.select("first.doc_id", "first.th", F.struct("mh", "sh", "least", "first.a", "first.n").alias("seg"))
    pieces = windows.with_lists(base, wanted(usual), "inner").select("doc_id", "th", "text", "segs").mapInArrow(_cut(length), "mh long, sh long, least long, n int, bits binary")
    located = pieces.repartition("mh").sortWithinPartitions("mh", "sh").mapInArrow(_shards(length), "mh long, sh long, skip int, run int, least long")
    if crowded is not None:
        each = windows.with_lists(base, wanted(crowded), "inner").select("doc_id", "th", "text", "segs")
        each = each.mapInArrow(windows.each_window(windows.word_symbols, length), "h1 long, h2 long, doc_id long, th long, a int, skip int, mh long, sh long, least long").drop("doc_id", "th", "a")
        first = each.groupBy("h1", "h2").agg(F.min("least").alias("l"), F.count("*").alias("copies"))
        more = windows.matched(each.drop("least"), written(first.where("l is not null"), "phrase-windows"), ["h1", "h2"], "copies")
        located = located.unionByName(more.select("mh", "sh", "skip", F.lit(1).alias("run"), F.col("l").alias("least")))
    at_once = shared.where("not mixed and least < doc_id").select("doc_id", "th", F.struct("a", "n").alias("seg"))
    # a kind has at most as many runs as windows: fewer than `length`
    runs_of = located.groupBy("mh", "sh").agg(F.collect_set(F.struct("skip", "run", "least")).alias("runs"))
    hits = written(runs_of.join(kinds.select("mh", "sh", "copies"), ["mh", "sh"]), "phrase-runs")
    found = windows.matched(several, hits, ["mh", "sh"], "copies").select("doc_id", "th", "a", F.explode("runs").alias("r")).where("r.least < doc_id")
    return at_once.unionByName(found.select("doc_id", "th", F.struct((F.col("a") + F.col("r.skip")).alias("a"), F.col("r.run").alias("n")).alias("seg")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """docs with `kept` (the words left, joined by one space), `n_words` (before) and `spans` (first word and end of each removed run)."""
    names = [c for c in docs.columns if c not in ("kept", "n_words", "spans")]
    there = windows.keyed(docs, row=F.struct(*(docs[f"`{c}`"] for c in names if c != "text")))
    found = windows.with_lists(there, repeats(docs, length, gram, crowd), "left")
    out = found.select("row", "text", "segs").mapInArrow(_strip(length), f"row {windows.struct_type(found, 'row')}, text string, kept string, n_words long, spans array<struct<start: int, end: int>>")
    return out.select(*("text" if c == "text" else F.col("row").getField(c).alias(c) for c in names), "kept", "n_words", "spans")
