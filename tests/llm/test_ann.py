import numpy as np
import pytest

from quillon.llm import ann


def product(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def brute(rows, k, ask):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((i, tuple(map(float, v))), None)
    out = set()
    for q, x in ok:
        if ask(q):
            # of several rows with one id, each vector is asked for
            found = sorted(((-product(x, y), i) for i, y in ok if i != q and len(y) == len(x)))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # a very common vector
    rows += [(2000 + i, [3.0 * x for x in rows[i][1]]) for i in range(20)]
    rows += [(5000, None), (5010, [0.0] * 6), (5020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5030, [float("nan")] * 6), (5040, [float("inf")] + [0.0] * 5), (5050, []), (None, [1.0] * 6), (5060, [1.0, 2.0]), (5061, [2.0, 1.0]), rows[0], (5070, [-0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    out = ann.nearest(df, df.where("vec_id % 10 = 0"), k=7, shard=50, block=16)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()}
    assert got == brute(rows, 7, lambda q: q % 10 == 0)
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (2.0, 0.9)])
def test_recall_and_pruning(factor, least):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16)) * 4
    points = np.concatenate([c + rng.normal(size=(100, 16)) * 0.3 for c in centers])
    queries = points[::37]
    tree = ann.VPTree(points, leaf=32)
    seen = 0
    far = tree._far

    def counted(x, rows):
        nonlocal seen
        seen += len(x) * len(rows)
        return far(x, rows)

    tree._far = counted
    who, _ = tree.search(queries, 10, factor)
    d = np.linalg.norm(queries[:, None] - points[None], axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(who.tolist(), want.tolist(), strict=True)])
    assert recall >= least and seen < len(queries) * len(points) / 2


def outlier(size):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    return [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])] + [(400, [size] + [0.0] * 7)]


one_hot = [(997 * i % 200, [float(j == i) for j in range(200)]) for i in range(200)]
own_id = [(0, [1.0 + i, 1.0]) for i in range(60)] + [(1 + i, [0.5, i / 40]) for i in range(40)]


@pytest.mark.parametrize("rows", [outlier(1e8), outlier(1e10), outlier(1e200), one_hot, own_id], ids=["1e8", "1e10", "1e200", "one hot", "own id"])
def test_outliers_ties_and_own_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = ann.nearest(df, df.where("vec_id % 20 = 0"), k=5, shard=150)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()}
    assert got == brute(rows, 5, lambda q: q % 20 == 0)


def test_products_prune():
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.3 for c in rng.normal(size=(40, 16)) * 4])
    q, square = x[::37], np.square(x).sum(axis=1)
    tree = ann.VPTree(np.column_stack([x, np.sqrt(square.max() - square)]), leaf=32)
    held, seen = ann.Products(x, q, 10, square.max()), 0
    meet = held.meet

    def counted(part, node):
        nonlocal seen
        seen += len(part) * len(node)
        meet(part, node)

    held.meet = counted
    who, score = tree.search(np.column_stack([q, np.zeros(len(q))]), 10, 1.0, held)
    want = np.argsort(-np.array([ann.inner_products(np.broadcast_to(a, x.shape), x) for a in q]), axis=1, kind="stable")[:, :10]
    assert (who == want).all() and (np.diff(score) <= 0).all() and seen < len(q) * len(x) / 2
