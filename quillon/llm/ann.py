"""Nearest neighbours by inner product, with vantage-point trees per shard.

With M the largest norm of a shard, x' = (x, sqrt(M**2 - |x|**2)) and q' = (q, 0), the largest inner products with q are
the smallest distances from q'. Each shard of vectors becomes a vantage-point tree over the x'; a subtree is
left out if `factor` times its least possible distance (by the triangle inequality) exceeds the distance of the
worst candidate held, by more than rounding can do. Factor one is exact; larger factors leave out more. Distances
only prune: candidates are held by their exact inner products, as many as a query's own vectors can't crowd out.

Equal vectors are one entry of a tree, with the smallest ids that any query may need. Queries go in blocks, and
each block meets each shard in a task of its own, of bounded size. Candidates are scored on the original
vectors, in double precision, component by component; ties go to the smaller id.

Vectors that are null, zero, empty or hold null or non-finite components take no part, neither do rows without
an id. Only vectors of equal length are compared. Rows with equal id and vector are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Neighbours; vectors in a shard and queries in a block, about; entries of a leaf; lists merged at once.
K, SHARD, QUERIES, LEAF, MERGE = 20, 8192, 16_384, 512, 64
EPS = np.finfo(float).eps


class VPTree:
    """Nodes: (vantage point's row, bounds of its distances inside and outside, children) or a leaf's rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 11):
        self.points, self.leaf = points, leaf
        self.squares = (points * points).sum(axis=1)
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(points)))

    def _far(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of each of x from each of the rows."""
        square = (x * x).sum(axis=1)[:, None] + self.squares[rows] - 2 * x @ self.points[rows].T
        return np.sqrt(np.maximum(square, 0))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        v = rows[self.rng.integers(len(rows))]
        d = self._far(self.points[v : v + 1], rows)[0]
        middle = np.median(d)
        inside = d <= middle
        if inside.all():
            inside = d < middle
        if not inside.any() or inside.all():
            return rows  # all as far: no split
        return v, [(d[m].min(), d[m].max(), self._grow(rows[m])) for m in (inside, ~inside)]

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, held: Held | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest of each query (fewer: row -1), in no order; with `held` what that holds."""
        held = held or Held(self, queries, k)
        # of a distance near zero the square's rounding leaves the root; three distances are compared
        norms = np.sqrt((queries * queries).sum(axis=1))
        slack = 4 * np.sqrt((queries.shape[1] + 4) * EPS) * (norms + np.sqrt(self.squares.max(initial=0)))

        def visit(node, of: np.ndarray):
            if not len(of):
                return
            if isinstance(node, np.ndarray):
                for part in np.array_split(of, max(1, len(of) * len(node) // 2_000_000)):
                    held.meet(part, node)
                return
            v, (inner, outer) = node
            d = self._far(queries[of], np.array([v]))[:, 0]
            near = d <= (inner[1] + outer[0]) / 2
            for (_, _, first), (low, high, second), mine in ((inner, outer, near), (outer, inner, ~near)):
                visit(first, of[mine])
                least = np.maximum(0, np.maximum(d[mine] - high, low - d[mine]))
                visit(second, of[mine][factor * least <= held.worst(of[mine]) + slack[of[mine]]])

        if len(self.points):
            visit(self.root, np.arange(len(queries)))
        return held.who, held.best


class Held:
    """The k rows nearest so far, by distance."""

    def __init__(self, tree: VPTree, queries: np.ndarray, k: int):
        self.tree, self.queries, self.k = tree, queries, k
        self.best = np.full((len(queries), k), np.inf)
        self.who = np.full((len(queries), k), -1, np.int64)

    def meet(self, part: np.ndarray, node: np.ndarray) -> None:
        d = np.concatenate([self.best[part], self.tree._far(self.queries[part], node)], axis=1)
        ids = np.concatenate([self.who[part], np.broadcast_to(node, (len(part), len(node)))], axis=1)
        keep = np.argpartition(d, self.k - 1, axis=1)[:, : self.k]
        self.best[part], self.who[part] = np.take_along_axis(d, keep, 1), np.take_along_axis(ids, keep, 1)

    def worst(self, of: np.ndarray) -> np.ndarray:
        return self.best[of].max(axis=1)


class Products(Held):
    """The k rows of the largest exact inner products so far, of equal ones the first rows; best: the products, falling.

    Products of matrices only leave out what their rounding errors can't bring among the k.
    """

    def __init__(self, x: np.ndarray, queries: np.ndarray, k: int, top: float):
        self.x, self.queries, self.k = x, queries, k
        self.best = np.full((len(queries), k), -np.inf)
        self.who = np.full((len(queries), k), -1, np.int64)
        self.squares = np.square(queries).sum(axis=1) + top
        self.norms, self.lengths = (np.sqrt(np.square(a).sum(axis=1)) for a in (x, queries))

    def meet(self, part: np.ndarray, node: np.ndarray) -> None:
        x, q, k = self.x[node], self.queries[part], self.k
        about = q @ x.T
        error = 2 * (x.shape[1] + 4) * EPS * self.lengths[part][:, None] * self.norms[node] + np.finfo(float).tiny
        least = np.where(self.who[part, -1] >= 0, self.best[part, -1], -np.inf)
        if len(node) > k:
            least = np.fmax(least, np.partition(about - error, len(node) - k, axis=1)[:, len(node) - k])
        row, at = np.nonzero(~(about + error < least[:, None]))  # an overflow stays
        score = np.concatenate([np.zeros(0), *(inner_products(q[row[i : i + 100_000]], x[at[i : i + 100_000]]) for i in range(0, len(row), 100_000))])
        new = np.unique(row)
        place = np.searchsorted(new, row)
        best, who = self.best[part[new]], self.who[part[new]]
        of = np.concatenate([np.repeat(np.arange(len(new)), k), place])
        score, ids = np.concatenate([best.ravel(), score]), np.concatenate([who.ravel(), node[at]])
        order = np.lexsort((ids, -score, ids < 0, of))
        n = np.bincount(of, minlength=len(new))
        rank = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        order = order[rank < k]
        self.best[part[new]], self.who[part[new]] = score[order].reshape(-1, k), ids[order].reshape(-1, k)

    def worst(self, of: np.ndarray) -> np.ndarray:
        far = np.sqrt(np.maximum(self.squares[of] - 2 * self.best[of, -1], 0))
        return np.where(self.who[of, -1] >= 0, far, np.inf)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x and y, summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors, equal ones together, as doubles in bytes."""
    for batch in batches:
        rows: dict[bytes, list[int]] = {}
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
            if len(x) and np.isfinite(x).all() and x.any():
                rows.setdefault((x + 0.0).tobytes(), []).append(i)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([sorted(set(v)) for v in rows.values()], pa.list_(pa.int64()))], names=["vec", "ids"])


def _search(k: int, factor: float):
    schema = pa.schema([("key", pa.int64()), ("query", pa.int64()), ("shard", pa.int32()), ("found", pa.list_(pa.struct([("minus", pa.float64()), ("ids", pa.list_(pa.int64()))])))])

    def pairs(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return schema.empty_table()
        # one length of vectors in a shard; in the order of their smallest ids, by which equal products go
        ids = shard.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids = [ids[i] for i in order]
        x = np.frombuffer(b"".join(shard.column("vec").to_pylist()), "<f8").reshape(shard.num_rows, -1)[order]
        q = np.frombuffer(b"".join(block.column("vec").to_pylist()), "<f8").reshape(block.num_rows, -1)
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.square(x).sum(axis=1)
            top = squares.max()
            # squares that overflow have no distances: all rows are one leaf
            flat = not np.isfinite(4 * (top + np.square(q).sum(axis=1).max()))
            tree = VPTree(np.column_stack([x, np.sqrt(np.maximum(top - squares, 0))]), leaf=len(x) if flat else LEAF)
            who, score = tree.search(np.column_stack([q, np.zeros(len(q))]), min(k, len(x)), factor, Products(x, q, min(k, len(x)), top))
        found = [[{"minus": -s, "ids": ids[i]} for s, i in zip(ss, ii, strict=True) if i >= 0] for ss, ii in zip(score.tolist(), who.tolist(), strict=True)]
        return pa.table([block.column("key"), block.column("query"), pa.array([shard.column("shard")[0].as_py()] * len(q), pa.int32()), pa.array(found, schema.field("found").type)], schema=schema)

    return pairs


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = 1.0, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of each row of queries, its own id apart.

    vectors and queries: vec_id, embedding. Each query's id and vector are one of the rows of vectors.
    """
    own = "vec binary, ids array<long>"
    packed = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_distinct, own)
    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.slice("ids", 1, k + 1))))), 1, k + 1)
    # parts of a task's batches come first, so that a very common vector is a few rows here
    entries = packed(vectors).groupBy("vec").agg(few.alias("ids")).withColumn("dim", (F.octet_length("vec") / 8).cast("int"))
    entries = written(entries.withColumn("key", F.xxhash64("vec")), "ann-entries")
    asked = written(packed(queries).select("vec", F.explode("ids").alias("query_id")).distinct().withColumn("key", F.xxhash64("vec")), "ann-queries")
    sizes = {r["dim"]: r["n"] for r in entries.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    # vectors of a query's own id take places in its list, and are not shown
    own_ids = entries.select(F.explode("ids").alias("query_id")).join(asked.select("query_id").distinct(), "query_id", "left_semi")
    held = k + (own_ids.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
    once = asked.select("key", "vec").distinct().withColumn("dim", (F.octet_length("vec") / 8).cast("int"))
    n_queries = once.count()
    blocks = max(1, -(-n_queries // block))
    most = max([1, *(-(-n // shard) for n in sizes.values())])
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, F.lit(max(1, -(-n // shard)))).otherwise(shards)
    dealt = F.pmod(F.xxhash64("key"), shards).cast("int")
    left = entries.select("vec", "ids", "dim", dealt.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = once.select("vec", "key", F.xxhash64("vec", F.lit(1)).alias("query"), "dim", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.pmod(F.hash("key"), F.lit(blocks)).cast("int").alias("block"))
    by = ("dim", "shard", "block")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(held, factor), "key long, query long, shard int, found array<struct<minus: double, ids: array<long>>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, held).alias("found")
    while most > MERGE:
        found = found.withColumn("shard", F.expr(f"shard div {MERGE}").cast("int")).groupBy("key", "query", "shard").agg(best)
        most = -(-most // MERGE)
    found = found.groupBy("key", "query").agg(best)
    asked = asked.select("query_id", "key", F.xxhash64("vec", F.lit(1)).alias("query"))
    each = asked.join(found, ["key", "query"])
    flat = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct(c["minus"].alias("minus"), i.alias("vec_id")))))
    ranked = each.select("query_id", F.slice(F.array_sort(F.filter(flat, lambda c: c["vec_id"] != F.col("query_id"))), 1, k).alias("found"))
    out = ranked.select("query_id", F.posexplode("found").alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", (-F.col("one.minus")).alias("score"))


