import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillon.llm import features, quality_rules, ranking
from quillon.llm.textvec import Texts

DATA = "/root/testdata/sf0.01"


def slow_counts(text):
    raw = text or ""
    for c in "\t\x0b\x0c\r":
        raw = raw.replace(c, " ")
    words = [w for w in raw.replace("\n", " ").split(" ") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(five) if five.count(w) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


TEXTS = ["", None, "\n", "a b\na b\n a b\n\n\na b", "one", "x " * 7, "é# ß*  z\x1fy", "a b c d e f a b c d e", "\n\nq\nq", "tail\n", "  ", "a b c d e", "e a b c d e"]


@pytest.mark.parametrize("seed", range(3))
def test_base_counts_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [*TEXTS, *("".join(rng.choice(["a", "b ", "é", "\n", " ", "\t", "#", "a b c d e "]) for _ in range(rng.randint(0, 120))) for _ in range(60))]
    rng.shuffle(texts)
    for column in (pa.array(texts), pa.array([None, "zz", *texts, "a"]).slice(2, len(texts))):
        got = features.base_counts(Texts(column))
        assert list(zip(*(v.tolist() for v in got.values()), strict=True)) == [slow_counts(t) for t in texts]


def test_linear_equals_sparse_rows():
    texts = [t or "" for t in TEXTS] + ["longer text with ünï code " * 9]
    weights = np.random.default_rng(3).normal(size=features.SIZE)
    t = Texts(pa.array(texts))
    want = [float(share @ weights[bucket]) for bucket, share in features.sparse(t)]
    assert np.allclose(features.linear(t, weights), want, atol=1e-5)
    alone = [features.linear(Texts(pa.array([x])), weights)[0] for x in texts]
    assert np.allclose(alone, want, atol=1e-5)


def test_models_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    learn, test = labels.where("doc_id % 2 = 0"), {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    for out, right in ((quality_rules.judge(docs, learn), lambda r, q: r["kept"] == bool(q)), (ranking.classify(docs, learn), lambda r, q: r["predicted"] == q)):
        rows = [r for r in out.collect() if r["doc_id"] in test]
        for q in (0, 1):
            own = [r for r in rows if test[r["doc_id"]] == q]
            assert sum(right(r, q) for r in own) >= 0.85 * len(own), q


def test_edges(spark):
    docs = spark.createDataFrame([(1, "word " * 30, 5), (None, None, 6), (1, "word " * 30, 5), (2, "", 7)], "doc_id long, text string, `kept.x` int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    for labels in (none, one):
        rows = quality_rules.judge(docs, labels).collect()
        assert len(rows) == 4 and all(r["probability"] > 0.99 for r in rows)
        assert all(r["base_failed"] for r in rows)
        assert all(r["predicted"] == 1 for r in ranking.classify(docs, labels).collect())
    zero = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert all(r["predicted"] == 0 for r in ranking.classify(docs, zero).collect())
    assert quality_rules.judge(docs.limit(0), one).collect() == ranking.classify(docs.limit(0), none).collect() == []


def test_ranking_learns_from_every_labelled_row(spark):
    # the first 1,200 rows of a label by hash were once all that was learnt from: the others alone show what "zzmark" means
    rng = random.Random(4)
    ids = spark.range(6000).select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").collect()
    label = {r["id"]: r["id"] % 2 for r in ids}
    early = {d for q in (0, 1) for d in [r["id"] for r in ids if label[r["id"]] == q][:1200]}
    words = [f"w{i}" for i in range(300)]
    text = lambda more: " ".join(rng.choice(words) for _ in range(20)) + more * 4
    rows = [(d, text("" if q else " qqjunk" if d in early else " zzmark")) for d, q in label.items()]
    probes = [(10_000 + i, text(" zzmark" if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in ranking.classify(docs, labels).where("doc_id >= 10000").collect()}
    assert got == {10_000 + i: int(i % 2 == 0) for i in range(40)}


def test_ranking_equals_a_plain_fit_over_all_pairs(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    t = Texts(pa.array([r["text"] for r in rows]))
    y, counts, steps = np.array([r["quality"] for r in rows]), features.counts(t), 6
    bucket, share, row = features.rows_of(features.sparse(t))
    w, v = np.zeros(features.SIZE), np.zeros(counts.shape[1])
    by, by_dense = features.Adam(features.SIZE, 0.3), features.Adam(len(v), 0.1)
    strength = lambda: np.bincount(row, share * w[bucket], len(y)) + counts @ v
    for _ in range(steps):
        s = strength()
        lost = -features.sigmoid(s[y == 0] - s[y == 1][:, None])
        own = np.zeros(len(y))
        own[y == 1], own[y == 0] = lost.mean(axis=1) / (y == 1).sum(), -lost.mean(axis=0) / (y == 0).sum()
        w -= by.step(np.bincount(bucket, share * own[row], features.SIZE) + 1e-4 * w)
        v -= by_dense.step(counts.T @ own + 1e-4 * v)
    s = strength()
    got = {r["doc_id"]: r["score"] for r in ranking.classify(docs, labels, steps=steps).collect()}
    got = np.array([got[r["doc_id"]] for r in rows])
    # scores are the logistic of a line on the strengths
    slope, offset = np.polyfit(s, np.log(got / (1 - got)), 1)
    assert np.allclose(got, features.sigmoid(slope * s + offset), atol=0.01) and slope > 0
    order = np.argsort(s)
    half = np.searchsorted(np.cumsum(np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())[order]), 0.5)
    assert s[order[max(half - 1, 0)]] - 0.1 <= -offset / slope <= s[order[half + 1]] + 0.1
