"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Copies share a fingerprint, so only distinct fingerprints are linked. Fingerprints that differ in at most
`radius` bits agree in one of radius + 1 blocks of bits at least: those that agree in a block meet in a shard,
whose BK-tree is followed along the edges within the radius. A shard gives a spanning forest of its links, not
all pairs. Shards of over CROWD fingerprints are linked exactly another way: each fingerprint is listed under
all that differ from it in up to radius / 2 bits, and two meet under one of these if and only if they are within
the radius; such a list has 65 members at most for radius 2.

A null or empty text has fingerprint zero, linked like any other. component_id is null where every doc_id of
the component is null. Input columns with a result's name give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, unzipped, written, zipped
from .components import components
from .textvec import mixed
from .windows import matched

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Distinct fingerprints in a BK-tree at most.
CROWD = 8192


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit b is 1 if it is set in over half the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z, and white space \x20 \x09-\x0D
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    hashes = np.array([h(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _prints(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return rows


class BKTree:
    """Children are keyed by their distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search_and_add(self, value: int, radius: int) -> list[int]:
        """The numbers of the values within the radius; then value is added."""
        values, children, found = self.values, self.children, []
        if values:
            todo = [0]
            while todo:
                i = todo.pop()
                d = (values[i] ^ value).bit_count()
                if d <= radius:
                    found.append(i)
                own = children[i]
                if len(own) <= 2 * radius:
                    todo.extend(j for k, j in own.items() if d - radius <= k <= d + radius)
                else:
                    todo.extend(own[k] for k in range(d - radius, d + radius + 1) if k in own)
            i = 0
            while True:
                d = (values[i] ^ value).bit_count()
                if d not in children[i]:
                    children[i][d] = len(values)
                    break
                i = children[i][d]
        values.append(value)
        children.append({})
        return found


class LiveTree(BKTree):
    """A BK-tree that values can be taken out of: what holds none any more is not visited."""

    def __init__(self, values: list[int]):
        super().__init__()
        self.parent: list[int] = []
        self.live: list[int] = []
        self.held: list[list[int]] = []
        self.place = [self._add(n, value) for n, value in enumerate(values)]

    def _add(self, n: int, value: int) -> int:
        i, parent = (0, -1) if self.values else (None, -1)
        while i is not None:
            self.live[i] += 1
            d = (self.values[i] ^ value).bit_count()
            if not d:
                self.held[i].append(n)
                return i
            i, parent = self.children[i].setdefault(d, len(self.values)), i
            if i == len(self.values):
                break
        for column, x in ((self.values, value), (self.children, {}), (self.parent, parent), (self.live, 1), (self.held, [n])):
            column.append(x)
        return len(self.values) - 1

    def within(self, value: int, radius: int) -> list[int]:
        """The numbers of the values that are still held, and within the radius."""
        values, children, live, found, todo = self.values, self.children, self.live, [], [0]
        while todo:
            i = todo.pop()
            if live[i]:
                d = (values[i] ^ value).bit_count()
                if d <= radius:
                    found.extend(self.held[i])
                todo.extend(j for k, j in children[i].items() if d - radius <= k <= d + radius)
        return found

    def take(self, n: int) -> bool:
        """Take number n out; false if it isn't held."""
        i = self.place[n]
        if i < 0:
            return False
        self.held[i].remove(n)
        self.place[n] = -1
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]
        return True


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join whatever is within the radius, directly or by way of others: fewer than values."""
    tree, top, out = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for n, value in enumerate(values):
        for i in tree.search_and_add(value, radius):
            a, b = root(i), root(n)
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((values[i], value))
    return out


def _shards(radius: int):
    mask = (1 << 64) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []
        sign = lambda v: v - (1 << 64) if v >> 63 else v

        def done():
            if len(held) > 1:
                out.extend((sign(a), sign(b)) for a, b in forest(held, radius))

        def made():
            cols = list(zip(*out, strict=True)) or [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

        for batch in batches:
            for key, fp in zip(batch.column("key").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                if key != last:
                    done()
                    held, last = [], key
                held.append(fp & mask)
            if len(out) > 10_000:
                yield made()
        done()
        yield made()

    return rows


def block_masks(radius: int) -> list[int]:
    """Of 64 bits, radius + 1 blocks."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]


def links(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """a and b of links that join distinct fingerprints `fp` into the components of their radius."""
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    blocks = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(sign(m)))) for i, m in enumerate(block_masks(radius))))
    keyed = prints.select("fp", F.explode(blocks).alias("key"))
    sizes = written(keyed.groupBy("key").count().where("count > 1"), "simhash-shards")
    crowded = sizes.where(F.col("count") > crowd)
    usual = keyed.join(sizes.where(F.col("count") <= crowd).select("key"), "key", "left_semi")
    found = usual.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_shards(radius), "a long, b long")
    if crowded.isEmpty():
        return found
    if radius % 2:
        raise ValueError("shards of over `crowd` fingerprints need an even radius")
    flips = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    rest = keyed.join(crowded.select("key"), "key", "left_semi").select("fp").distinct()
    listed = rest.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(sign(m))) for m in flips))).alias("near"))
    least = listed.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    return found.unionByName(least.select("a", F.explode("all").alias("b")).where("a <> b"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_prints(shingle), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint and component_id, a row for each row of docs."""
    prints = written(fingerprints(docs, shingle), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    tops = components(links(distinct.select("fp"), radius, crowd))
    placed = distinct.join(tops, distinct["fp"] == tops["node"], "left").select("fp", "least", F.coalesce("top", "fp").alias("top"))
    placed = written(placed, "simhash-placed")
    least = written(placed.groupBy("top").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-least")
    classes = matched(placed.select("fp", "top"), least, ["top"], "n").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The shingle's words, and the least similarity of two shingle sets (Jaccard's).
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits of a set's fingerprint, and the bits in which those of similar sets may differ. Each bit differs with a
#: probability of 0.19 at most in sets of similarity 0.8 (48 of 256, standard deviation 6), of 0.5 in sets with nothing in common.
WIDE, WIDE_RADIUS = 4, 88
#: Bands of a set, and least hashes of a band; shingles of a shard's sets, about.
BANDS, ROWS, SHINGLES = 24, 4, 4_000_000


def shingles(text: bytes, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The set of a text's shingles: their hashes, in order. A text without a whole one is its own."""
    found = text.lower().split()
    h = xxhash.xxh64_intdigest
    hashes = {h(s, seed) for s in map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))} if len(found) > shingle else {h(b" ".join(found), seed)}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def wide_print(hashes: np.ndarray) -> bytes:
    """The set's fingerprint of 64 * WIDE bits: a bit is 1 if it is set in over half the hashes, mixed anew for each word."""
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 1024):
        ones += np.unpackbits(mixed(hashes[i : i + 1024, None] ^ _WORDS).view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


_WORDS = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: equal where all the band's least hashes are."""
    least = np.full(len(_DRAWS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, mixed(hashes[i : i + 1024, None] + _DRAWS).min(axis=0), out=least)
    cut = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), j) for j, x in enumerate(cut)], np.uint64).view(np.int64)


_DRAWS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _set_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in parts(whole)):
        sets = [shingles(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
        fp = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in sets], pa.int64())
        keys = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
        wide = pa.array([wide_print(x) for x in sets], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), fp, pa.array([len(x) for x in sets], pa.int64()), keys, wide, zipped(batch.column("text"))], names=["doc_id", "th", "fp", "n", "keys", "wide", "zip"]
        )


def alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have that Jaccard similarity with one."""
    sizes = np.array([len(x) for x in others])
    values = np.concatenate(others)
    there = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
    both = np.add.reduceat(there, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both / (len(one) + sizes - both) >= similarity


def set_forest(sets: list[np.ndarray], similarity: float, prints: list[bytes] | None = None, radius: int = WIDE_RADIUS) -> list[tuple[int, int]]:
    """Links (numbers of sets) that join sets of that Jaccard similarity, directly or by way of others.

    What the BK-tree of their fingerprints finds within the radius is compared exactly.
    """
    values = [int.from_bytes(x) for x in prints or map(wide_print, sets)]
    tree, out = LiveTree(values), []
    for start in range(len(sets)):
        todo = [start] if tree.take(start) else []
        # each set that was reached is compared with those that were not
        while todo:
            at = todo.pop()
            found = [j for j in tree.within(values[at], radius) if similarity * max(len(sets[at]), len(sets[j])) <= min(len(sets[at]), len(sets[j]))]
            near = np.array(found)[alike(sets[at], [sets[j] for j in found], similarity)].tolist() if found else []
            for j in near:
                tree.take(j)
                out.append((at, j))
            todo += near
    return out


def _set_shards(similarity: float, radius: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, prints, ids, out = None, [], [], [], []

        def done():
            if len(held) > 1:
                out.extend((ids[i], ids[j]) for i, j in set_forest(held, similarity, prints, radius))

        def made():
            cols = list(zip(*out, strict=True)) or [[], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

        for batch in batches:
            for key, fp, wide, text in zip(*(batch.column(c).to_pylist() for c in ("key", "fp", "wide")), unzipped(batch.column("zip")), strict=True):
                if key != last:
                    done()
                    held, prints, ids, last = [], [], [], key
                held.append(shingles(text))
                prints.append(wide)
                ids.append(fp)
            if len(out) > 10_000:
                yield made()
        done()
        yield made()

    return rows


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, crowd: int = SHINGLES, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id, th (a hash of the text), component_id and `first` of texts whose sets of five-word shingles are similar, directly or by way of others.

    Each set has a SimHash fingerprint of 64 * WIDE bits. A shard's BK-tree finds the fingerprints within `radius`
    bits of one another; their sets are then compared exactly. In a shard are the sets that have all the least hashes
    of a band in common, whatever the size of the corpus: of pairs right at 0.8 all but (1 - 0.8 ** ROWS) ** BANDS
    meet, three in a million. A shard of over `crowd` shingles is cut into parts, and each two parts meet in a task. `first` is true of the text with the
    component's smallest doc_id (of several that share it, of the one with the smallest th).
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    prints = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_set_prints, "doc_id long, th long, fp long, n long, keys array<long>, wide binary, zip binary")
    prints = written(prints, "simhash-sets")
    distinct = written(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "simhash-distinct")
    keyed = distinct.select("fp", "n", F.explode("keys").alias("key"))
    # near copies share most of their bands: of shards with the same members one is enough
    members = [F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"m{i}") for i in range(2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("n"), *members).where("members > 1")
    shared = shared.groupBy("members", "m0", "m1").agg(F.min("key").alias("key"), F.first("n").alias("all"))
    cut = shared.select("key", F.ceil(F.col("all") / crowd).cast("int").alias("parts"))
    meeting = written(keyed.join(cut, "key").select("fp", "key", "parts"), "simhash-meeting")
    texts = prints.select("fp", "wide", "zip").join(meeting.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("wide").alias("wide"), F.first("zip").alias("zip"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = meeting.select("fp", "key", part.alias("part"), F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    cells = cells.select("fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"))
    shards = cells.join(texts, "fp").repartition("key").sortWithinPartitions("key", "fp")
    tops = components(shards.mapInArrow(_set_shards(similarity, radius), "a long, b long"))
    placed = distinct.join(tops, distinct["fp"] == tops["node"], "left").select("fp", "least", F.coalesce("top", "fp").alias("top"))
    placed = written(placed, "simhash-placed")
    least = written(placed.groupBy("top").agg(F.min("least").alias("first"), F.count("*").alias("n")), "simhash-least")
    classes = matched(placed.select("fp", "top"), least, ["top"], "n").select("fp", F.col("first").alias("least"))
    found = prints.select("doc_id", "th", "fp").join(classes, "fp")
    return found.select("doc_id", "th", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "th") == F.col("least")).alias("first"))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each component of groups: its first text or, of near_duplicates(), a row with its smallest doc_id.

    Rows without a doc_id stay.
    """
    docs = docs.withColumn("_th", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    if "first" in groups.columns:
        kept, by = groups.where("first").select("doc_id", F.col("th").alias("_th")), ["doc_id", "_th"]
    else:
        kept, by = groups.where("doc_id = component_id").select("doc_id"), ["doc_id"]
    named = docs.join(kept.distinct(), by, "left_semi").dropDuplicates(by).select(docs.columns)
    return named.unionByName(docs.where("doc_id is null")).drop("_th")
