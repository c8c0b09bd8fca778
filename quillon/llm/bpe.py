"""Byte-level BPE over a corpus: each distinct word is encoded once, and decoding joins the token-byte table.

1. A block of whole documents is split into pre-tokens. Its positions become numbers of the block's distinct
   words (frequent words get small numbers), its words go to the part that a checksum of the word names.
   Both are packed: a block takes a row for its positions and one for its words in each part. Splitting is
   done twice, for the words and for the positions, as that costs less than to keep the positions meanwhile.
2. The rows of a part meet in one task, which encodes each distinct word of the corpus in that part once and
   sends the ids back to the blocks.
3. A block's ids are put together by position.
4. Decoding looks each id up in the table of token bytes, which is of fixed size and broadcast.

A null text counts as empty and has no ids. Rows stay apart whatever their doc_id. Only doc_id and `position`, a
number, are carried along.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, parts, small_batches, trim, written

#: Bytes of text in a block, about.
BLOCK = 8 << 20
PACKED = "block long, part int, doc_ids array<long>, positions array<long>, sizes array<int>, codes binary, words binary"
#: Bytes of input for each part of the words, about; words that a task remembers the ids of.
PART, KNOWN = 64 << 20, 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32, their low bytes together, then the next ones."""
    n = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(n.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _blocks(pattern: str, n_parts: int, words: bool):
    """The rows of each block: with its words, or with its positions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for whole in gathered(batches, least=BLOCK):
            for batch in parts(whole, most=2 * BLOCK):
                number: dict[str, int] = {}
                texts = pc.fill_null(batch.column("text"), "")
                runs = [np.array([number.setdefault(w, len(number)) for w in split(x.as_py())], np.int32) for x in texts]
                codes = np.concatenate(runs)
                by = np.argsort(-np.bincount(codes, minlength=len(number)), kind="stable")
                rank = np.empty(len(by), np.int32)
                rank[by] = np.arange(len(by))
                listed = [w.encode() for w in number]
                # blocks with one number have the same words, in one order
                block = int.from_bytes(hashlib.blake2b(repr([listed, rank.tobytes()]).encode(), digest_size=8).digest(), "little", signed=True)
                if not words:
                    yield pa.RecordBatch.from_pylist([{"block": block, "part": -1, "doc_ids": batch.column("doc_id").to_pylist(), "positions": batch.column("position").to_pylist(), "sizes": [len(x) for x in runs], "codes": pack(rank[codes])}], _PACKED)
                    continue
                part = np.array([zlib.crc32(w) % n_parts for w in listed], np.int32)
                order, out = by[np.argsort(part[by], kind="stable")], []
                for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
                    held = [listed[i] for i in own.tolist()]
                    out.append({"block": block, "part": int(part[own[0]]), "sizes": [len(w) for w in held], "codes": pack(np.diff(rank[own], prepend=0)), "words": zstandard.ZstdCompressor(level=1).compress(b"".join(held))})
                yield pa.RecordBatch.from_pylist(out, _PACKED)

    return rows


_PACKED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.binary())])
_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def _encoder(ranks: dict[bytes, int]):
    found = _ENCODINGS.get(id(ranks))
    if found is None:
        # each word is one piece already
        found = _ENCODINGS[id(ranks)] = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return found._encode_single_piece


def _encode_words(sent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                words, at, ids, counts = zstandard.ZstdDecompressor().decompress(row["words"]), 0, [], []
                for n in row["sizes"]:
                    word = words[at : at + n]
                    own = known.get(word)
                    if own is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        own = known[word] = encode(word)
                    ids += own
                    counts.append(len(own))
                    at += n
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "part": row["part"], "doc_ids": None, "positions": None, "sizes": None, "codes": row["codes"], "words": pack(np.array([*counts, *ids]))}], _PACKED)

    return rows


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start[i]:start[i] + count[i]] for all i, together."""
    ends = np.cumsum(count)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list = []
    last = at_place = None
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.column("block")[i].as_py()
            row = {k: batch.column(k)[i].as_py() for k in ("part", "codes", "words")}
            if row["part"] >= 0:
                if block != last or at_place:
                    found, last, at_place, seen = [], block, False, set()
                if row["part"] in seen:
                    continue  # of another block with the same words
                seen.add(row["part"])
                codes, both = np.cumsum(unpack(row["codes"]).astype(np.int32)), unpack(row["words"])
                found.append((codes, both[: len(codes)], both[len(codes) :].astype("<u4")))
                continue
            if block != last:
                found, last = [], block
            at_place = True
            size = sum(len(c) for c, _, _ in found)
            count, start, base = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
            for codes, n, ids in found:
                count[codes] = n
                start[codes] = base + np.cumsum(n) - n
                base += len(ids)
            flat = np.concatenate([ids for _, _, ids in found]) if found else np.zeros(0, "<u4")
            codes, doc_ids, positions, ends = unpack(row["codes"]), batch.column("doc_ids")[i].values, batch.column("positions")[i].values, np.cumsum(batch.column("sizes")[i].values.to_numpy())
            if len(codes) and int(codes.max()) >= size:
                raise RuntimeError("a file changed while it was read")
            at = 0
            while at < len(ends):  # some texts at a time
                low = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, low + 500_000, side="right")))
                own = codes[low : ends[to - 1]]
                n = count[own]
                ids, cuts = gather(flat, start[own], n), np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends[at:to] - low])]
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [doc_ids[at:to], positions[at:to], pa.array(np.diff(cuts), pa.int64()), pa.array([raw[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                    names=["doc_id", "position", "n_tokens", "ids"],
                )
                at = to
    trim()


ENCODED = "doc_id long, position long, n_tokens long, ids binary"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, position (if docs have it), n_tokens and ids (unsigned 32-bit, little-endian) for each row of docs (doc_id, text)."""
    out = _together(docs, ranks, pattern).mapInArrow(_assemble, ENCODED)
    return out if "position" in docs.columns else out.drop("position")


_IN_ORDER = {"AdaptiveSparkPlan", "ColumnarToRow", "FileScan", "Filter", "InputAdapter", "LocalTableScan", "Project", "WholeStageCodegen"}


def comes_again(docs: DataFrame) -> bool:
    """Whether docs, read twice, is sure to give the same rows in the same order and batches: a plain scan of files."""
    run = docs._jdf.queryExecution()
    nodes = re.findall(r"^[^A-Za-z]*([A-Za-z]+)", run.executedPlan().toString(), re.MULTILINE)
    return set(nodes) <= _IN_ORDER and run.optimizedPlan().deterministic()


def part_count(docs: DataFrame) -> int:
    """Parts of the words: in proportion to the files that are read, the session's shuffle partitions at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, -(-size // PART))  # an unknown size is told as the largest number


def _together(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Each block's ids, part by part, and then its positions."""
    spark = docs.sparkSession
    small_batches(spark)
    position = docs["position"] if "position" in docs.columns else F.lit(None)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), position.cast("long").alias("position"), docs["text"].cast("string").alias("text"))
    if not comes_again(rows):
        rows = written(rows, "bpe-texts")  # the texts are read twice
    n_parts = part_count(rows)
    sent = spark.sparkContext.broadcast(ranks)  # of fixed size
    packed = lambda words: rows.mapInArrow(_blocks(pattern, n_parts, words), PACKED)
    ids = packed(True).repartition(n_parts, "part").mapInArrow(_encode_words(sent), PACKED)
    return ids.unionByName(packed(False)).repartition(n_parts, "block").sortWithinPartitions("block", F.desc("part"))


def token_bytes(spark: SparkSession, ranks: dict[bytes, int]):
    """The token-byte table, for broadcast: all bytes, and where each id's begin and how many they are (-1 for no token)."""
    size = max(ranks.values(), default=-1) + 1
    start, count, blob = np.zeros(size, np.int64), np.full(size, -1, np.int64), bytearray()
    for token, i in ranks.items():
        start[i], count[i] = len(blob), len(token)
        blob += token
    return spark.sparkContext.broadcast((np.frombuffer(bytes(blob), np.uint8), start, count))


def _decoded(sent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, start, count = sent.value
        for whole in batches:
            for batch in parts(whole, "ids"):
                raw = pc.fill_null(batch.column("ids"), b"").to_pylist()
                ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
                if len(ids) and (ids.max() >= len(count) or count[ids].min() < 0):
                    raise ValueError("an id without a token")
                data = gather(blob, start[ids], count[ids]).tobytes()
                cuts = np.concatenate([[0], np.cumsum(count[ids])])[np.cumsum([0, *(len(x) // 4 for x in raw)])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=[*batch.schema.names, "decoded"])

    return rows


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded with `decoded`, the bytes of its ids. An id without a token is an error."""
    encoded = encoded.select(*(c for c in encoded.columns if c != "decoded"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(token_bytes(encoded.sparkSession, ranks)), f"{kinds}, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, position (if docs have it), n_tokens, ids and decoded: encode() and decode() in one Python worker of a task."""
    decoded = _decoded(token_bytes(docs.sparkSession, ranks))
    out = _together(docs, ranks, pattern).mapInArrow(lambda batches: decoded(_assemble(batches)), f"{ENCODED}, decoded binary")
    return out if "position" in docs.columns else out.drop("position")
