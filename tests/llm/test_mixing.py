import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from quillon.llm import mixing as M


def plan(weights, slots):
    """Earliest deadline first over whole numbers: the slot of each source's j-th block."""
    total, k, out = sum(weights.values()), Counter(), {}
    names = sorted(weights, key=lambda s: (s is not None, s))
    for t in range(slots):
        s = min((s for s in names if k[s] * total // weights[s] <= t), key=lambda s: -(-(k[s] + 1) * total // weights[s]))
        out[s, k[s]] = t
        k[s] += 1
    return out


def within_a_block(slots_of, weights):
    """At each slot, as long as a source has rows, it has had its exact share of the slots but for less than one block."""
    total = sum(map(Fraction, weights.values()))
    for s, slots in slots_of.items():
        for n, t in enumerate(sorted(slots)):
            assert abs(n - Fraction(weights[s]) * t / total) < 1 and abs(n + 1 - Fraction(weights[s]) * (t + 1) / total) < 1


@pytest.mark.parametrize("seed", range(2))
def test_placed_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "c", "", None])) for i in range(400)]
    df = spark.createDataFrame([(d, s, "t", 1) for d, s in rows], "doc_id long, source string, `te.xt` string, slot int")
    got = {r["doc_id"]: r for r in M.placed(df, block=3, bucket=7).collect()}
    weights = {s: math.floor(math.sqrt(n) * 1000 + 0.5) for s, n in Counter(s for _, s in rows).items()}
    at = plan(weights, 2000)
    by = {}
    for d, s in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        by.setdefault(s, []).append(d)
    for s, docs in by.items():
        for i, d in enumerate(docs):
            slot = at[s, i // 3]
            assert (got[d]["slot"], got[d]["position"]) == (slot, slot * 3 + i % 3)
    assert len(got) == len(rows)
    within_a_block({s: {got[d]["slot"] for d in docs} for s, docs in by.items()}, weights)
    mixed = M.mix(df, block=3, bucket=7)
    order = [r["position"] for r in mixed.collect()]
    assert order == sorted(order) and len(set(order)) == len(rows) and mixed.columns == ["doc_id", "source", "te.xt", "slot", "position"]


def test_exact_targets_over_a_long_schedule(spark):
    # weights that no small whole numbers stand for, and a source of a share below one in a thousand
    weights = {"a": 0.7123456789, "b": 0.2871234567, "c": 0.0005308644}
    df = spark.range(6000).selectExpr("id as doc_id", "case when id < 4200 then 'a' when id < 5997 then 'b' else 'c' end as source")
    got = M.placed(df, weights, block=1).collect()
    assert len({r["position"] for r in got}) == 6000
    within_a_block({s: {r["slot"] for r in got if r["source"] == s} for s in weights}, weights)


def test_more_sources_than_blocks_of_the_largest(spark):
    rows = [(i, "hot") for i in range(600)] + [(1000 + i, f"s{i}") for i in range(200)]
    got = M.placed(spark.createDataFrame(rows, "doc_id long, source string"), block=4).collect()
    assert len({r["position"] for r in got}) == len(rows)
    weights = {s: math.floor(math.sqrt(n) * 1000 + 0.5) for s, n in Counter(s for _, s in rows).items()}
    within_a_block({s: {r["slot"] for r in got if r["source"] == s} for s in weights}, weights)


def test_weight_zero_comes_last(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "doc_id long, source string")
    got = M.placed(df, {"a": 1.0, "b": 2.0, "c": 0.0}, block=2).collect()
    last = max(r["position"] for r in got if r["source"] != "c")
    assert len({r["position"] for r in got}) == 90 and all(r["position"] > last for r in got if r["source"] == "c")


def test_weights_repeated_rows_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "b"), (None, None), (2, "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = M.mix(df, weights={"a": 3.0, "b": 1.0}, block=1).collect()
    assert sorted(((r["doc_id"], r["source"]) for r in out), key=str) == sorted(rows, key=str)
    assert len({r["position"] for r in out}) == len(rows)
    assert M.mix(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        M.mix(df, weights={"a": -1})
