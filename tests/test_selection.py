import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.kinds import KINDS
from quillon.functions.values import as_int, as_uint, python, remaining, wrapped
from quillon.operators import keys
from quillon.operators.aggregates import Aggregate, avg_of, count, sum_of
from quillon.operators.ordering import last_of_each, top
from quillon.plans.selection import Table

ROWS = [(0, "a", 1, 2.9, True), (1, "b", None, -2.9, False), (2, None, 3, None, None), (3, "a", -4, float("nan"), True), (4, "c", 5, 1e30, False)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, s string, n int, x double, b boolean")


def table(df, **more):
    t = Table.of(df, "id", **more)
    return t.index("isa", "s", lambda c: c == "a").index("isb", "s", "s = 'b'").index("pos", "n", lambda c: c > 0).sort("by_s", "s")


def ids(selection):
    return sorted(r[0] for r in selection.select("id").collect())


def test_names(df):
    s = table(df).select()
    assert ids(s) == [0, 1, 2, 3, 4]
    assert ids(s.with_("isa")) == [0, 3]
    assert ids(s.with_("s")) == [0, 1, 3, 4] and ids(s.with_("b")) == [0, 3]
    assert ids(s.with_("nothing")) == [] == ids(s.with_("isa", "nothing"))
    assert ids(s.without("isa")) == [1, 2, 4] and ids(s.without("nothing")) == [0, 1, 2, 3, 4]
    assert ids(s.without("b")) == [1, 2, 4] and ids(s.without("pos")) == [1, 3]
    assert ids(s.union("isa", "isb")) == [0, 1, 3] and ids(s.union("nothing", "isb")) == [1]
    assert ids(s.with_("isa").union("isb")) == [0, 1, 3] and ids(s.with_("isa").union("nothing")) == [0, 3]
    assert ids(s.with_union("isa", "isb")) == [0, 1, 3]
    assert ids(s.with_("pos").with_union("isa", "isb", "nothing")) == [0] and ids(s.with_("pos").with_union("isb")) == []
    assert ids(s.with_("isa").with_union("nothing")) == []


def test_strict_names(df):
    s = table(df, strict=True).select()
    assert ids(s.union("nothing", "isb")) == [0, 1, 2, 3, 4]
    assert ids(s.with_("pos").with_union("isb")) == [0, 1, 2, 4]


def test_values(df):
    s = table(df).select()
    assert ids(s.with_value("n", lambda c: c != 3)) == [0, 3, 4] and ids(s.with_value("n", "n = 3")) == [2]
    assert ids(s.with_int("x", lambda c: c == -2)) == [1] and ids(s.with_int("x", lambda c: c == 2)) == [0]
    assert ids(s.with_uint("x", lambda c: c == 2)) == [0] and ids(s.with_uint("n", lambda c: c >= 0)) == [0, 2, 4]
    assert ids(s.with_string("s", python(lambda v: v in "ab"))) == [0, 1, 3]
    assert ids(s.with_string("n", lambda c: c == "1")) == [] == ids(s.with_float("s", lambda c: c > 0)) == ids(s.with_float("gone", lambda c: c > 0))
    assert ids(s.with_float("x", lambda c: c > 0)) == [0, 3, 4]
    assert ids(table(df, strict=True).select().with_float("x", lambda c: c > 0)) == [0, 4]
    assert ids(table(df, strict=True).select().with_uint("n", lambda c: c > F.lit(2**63 - 1))) == [3]
    with pytest.raises(TypeError):
        s.with_value("n", lambda c: True)


def test_aggregates(spark, df):
    s, strict = table(df).select(), table(df, strict=True).select()
    assert s.count() == 5 and s.sum("n") == 5 and s.avg("n") == 1.25 and strict.avg("n") == 1.0
    assert s.min("n") == (-4, True) and strict.with_("isb").min("n") == (0, True)
    none = s.with_("nothing")
    assert none.min("n") == (None, False) and none.sum("n") == 0 and none.avg("n") is None
    assert math.isnan(strict.with_("nothing").avg("n"))
    big = Table.of(spark.createDataFrame([(0, 30000), (1, 10000)], "id long, h short"), "id", strict=True).select()
    assert big.sum("h") == 40000 - 65536
    assert s.agg(n=count, t=sum_of("n"), a=avg_of("n")).first() == (5, 5, 1.25)
    with pytest.raises(TypeError):
        s.sum("s")
    below = s.with_float("n", lambda c: c < s.scalar(avg_of("n")))
    assert ids(below) == [0, 3]
    assert Aggregate("any").of({}, False) is not None


def test_order_and_projection(df):
    s = table(df).select()
    assert [r[0] for r in s.ascend("by_s", "id").collect()] == [0, 3, 1, 4]
    assert [r[0] for r in table(df, strict=True).select().ascend("by_s", "id").collect()] == [3, 1, 4]
    assert [r[0] for r in s.ascend("by_s", top=2).collect()] == [0, 3]
    assert [r[0] for r in s.with_("pos").range("id").collect()] == [0, 2, 4] and [r[0] for r in s.iterate("id")] == [0, 1, 2, 3, 4]
    assert [tuple(r) for r in s.select("id", "isa").orderBy("id").collect()] == [(0, True), (1, False), (2, False), (3, True), (4, False)]
    with pytest.raises(ValueError, match="no sorted index"):
        s.ascend("isa")
    with pytest.raises(ValueError, match="no column or index"):
        s.select("zz")
    with pytest.raises(ValueError, match="taken"):
        s.table.index("isa", "s", "true")
    assert [r["id"] for r in top(s.table.df, "n", 2, descending=True).collect()] == [4, 2]
    assert {r["id"] for r in last_of_each(df.where("s is not null"), "s", "id").collect()} == {1, 3, 4}


def test_changed_frames(spark, df):
    s = table(df).select()
    got = {r["id"]: r["n"] for r in s.with_("isa").updated(n=9).collect()}
    assert got == {0: 9, 1: None, 2: 3, 3: 9, 4: 5}
    got = {r["id"]: r["n"] for r in s.with_("isb").merged(n=7).collect()}
    assert got == {0: 1, 1: 7, 2: 3, 3: -4, 4: 5}
    assert sorted(r["id"] for r in s.with_("pos").deleted().collect()) == [1, 3]
    up = keys.upserted(df, spark.createDataFrame([(1, "new"), (9, "nine")], "id long, s string"), "id")
    assert {r["id"]: (r["s"], r["x"]) for r in up.where("id in (0, 1, 9)").collect()} == {0: ("a", 2.9), 1: ("new", -2.9), 9: ("nine", None)}
    assert keys.taken(df, spark.createDataFrame([(1,), (7,), (7,), (8,)], "id long"), "id").count() == 2


def test_filters_reach_the_scan(spark):
    t = Table.of(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey").index("finished", "o_orderstatus", lambda c: c == "F")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = t.select().with_("finished").with_float("o_totalprice", lambda c: c >= 1000).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(o_totalprice,1000.0)" in plan
    assert "o_orderdate" not in plan and "Exchange" not in plan


def test_random_chains_against_a_list(df):
    rng = random.Random(1)
    rules = {"isa": lambda r: r[1] == "a", "isb": lambda r: r[1] == "b", "pos": lambda r: (r[2] or 0) > 0, "n": lambda r: r[2] is not None, "b": lambda r: bool(r[4])}
    for _ in range(12):
        s, now, fresh = table(df).select(), {r[0] for r in ROWS}, True
        for _ in range(rng.randint(1, 4)):
            names = rng.sample([*rules, "nothing"], rng.randint(1, 3))
            hits = [{r[0] for r in ROWS if rules[n](r)} for n in names if n in rules]
            op = rng.choice(["with_", "without", "union", "with_union"])
            s = getattr(s, op)(*names)
            every = set().union(*hits)
            if op == "with_":
                now = now.intersection(*hits) if "nothing" not in names else set()
            elif op == "without":
                now = now - every
            elif op == "union" or fresh:
                now = every if fresh and hits else now | every
            else:
                now = now & every
            fresh = fresh and op in ("union", "with_union") and not hits
        assert set(ids(s)) == now


def test_conversions(spark):
    df = spark.createDataFrame([(-2500.9, 5), (1e30, 0), (-0.5, -1)], "x double, e long")
    assert [r[0] for r in df.select(as_int(F.col("x"))).collect()] == [-2500, None, 0]
    uints = [r[0] for r in df.select(as_uint(F.col("x"), KINDS["float64"].type)).collect()]
    assert uints[0] is None and uints[2] in (None, 0)
    assert [r[0] for r in df.select(wrapped(F.col("e") + 32763, 16).cast("int")).collect()] == [-32768, 32763, 32762]
    assert [r[0] for r in df.select(remaining(F.col("e"), 2)).collect()] == [3, None, -3]
