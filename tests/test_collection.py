import struct
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.collection import Collection
from quillon.functions.kinds import KINDS, Kind, infer, json_codec, kind, python_codec, register
from quillon.sources.files import from_json, from_rows
from quillon.sources.log import Log
from quillon.sources.store import Conflict, Store


@pytest.fixture
def path(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def players(spark, path, **more):
    c = Collection(spark, path, **more)
    for name, k in (("name", "string"), ("race", "enum"), ("age", "int16"), ("balance", "float64"), ("active", "bool")):
        c.create_column(name, k)
    c.create_index("human", "race", "race = 'human'")
    c.create_index("old", "age", lambda a: a >= 30)
    c.create_sort_index("names", "name")
    rows = [("bob", "human", 20, 10.0, True), ("al", "elf", 40, 20.0, False), ("eve", "human", 50, 30.0, None), ("dan", None, None, None, True)]
    c.insert_many(from_rows(spark, rows, "name string, race string, age short, balance double, active boolean").coalesce(1))
    return c


def rows(c, *columns):
    return {r[0]: tuple(r)[1:] if len(columns) > 1 else r[1] for r in c.select().range("name", *columns).collect()}


def test_insert_select_and_reopen(spark, path):
    c = players(spark, path)
    assert c.count() == 4 and c.select().with_("human", "old").count() == 1 and c.select().without("active").count() == 2
    assert [r[0] for r in c.select().ascend("names", "name").collect()] == ["al", "bob", "dan", "eve"]
    new = c.insert(name="zoe", age=7, balance=1)
    assert new == 4 and c.query_at(new, lambda r: (r.string("name"), r.int16("age"), r.get("race"), r.bool("active"))) == ("zoe", 7, None, False)
    again = Collection(spark, path, create=False)
    assert again.count() == 5 and again.select().with_("human").count() == 2
    with pytest.raises(FileNotFoundError):
        Collection(spark, path + "none", create=False)


def test_update_merge_delete(spark, path):
    c = players(spark, path)
    with c.txn() as t:
        t.select().with_("human").set(balance=1.5).merge(age=5)
        assert c.select().with_("human").sum("balance") == 40.0  # not before the commit
    assert rows(c, "balance", "age") == {"bob": (1.5, 25), "al": (20.0, 40), "eve": (1.5, 55), "dan": (None, None)}
    with c.txn() as t:
        t.select().merge(balance=500.0)
        t.select().with_("old").merge(balance=F.col("age").cast("double"))
    assert rows(c, "balance") == {"bob": 501.5, "al": 560.0, "eve": 556.5, "dan": 500.0}
    with c.txn() as t:
        t.select().with_("old").set(name="x").delete_all()  # a deleted row stays deleted
    assert sorted(rows(c, "age")) == ["bob", "dan"]
    assert c.delete_at(0) and not c.delete_at(0) and not c.delete_at(99)
    assert c.count() == 1 and c.insert(name="new") == 4


def test_rollback_and_conflict(spark, path):
    c = players(spark, path)
    with pytest.raises(RuntimeError), c.txn() as t:
        t.select().set(balance=0.0)
        t.insert(name="ghost")
        raise RuntimeError
    assert c.count() == 4 and c.select().sum("balance") == 60.0
    other = Collection(spark, path)
    with pytest.raises(Conflict), c.txn() as t:
        t.select().set(balance=0.0)
        other.insert(name="first")
    c.refresh()
    assert c.count() == 5 and c.select().sum("balance") == 60.0


def test_row_methods_and_errors(spark, path):
    c = players(spark, path)
    with c.txn() as t:
        t.query_at(1, lambda r: r.set_float64("balance", 7).merge_float64("balance", 1.0).set_many({"name": "alf", "active": True}))
    assert rows(c, "balance", "active")["alf"] == (8.0, True)
    for bad in (lambda r: r.float64("name"), lambda r: r.set_int16("balance", 1)):
        with pytest.raises(TypeError):
            c.query_at(1, bad)
    with pytest.raises(KeyError):
        c.query_at(77, lambda r: r.set("name", "x"))
    assert c.query_at(77, lambda r: r.get("name")) is None
    for bad in (lambda: c.insert(nope=1), lambda: c.create_column("name", "int"), lambda: c.create_column("human", "int"), lambda: c.create_index("i", "nope", "true"), lambda: c.drop_index("name"), lambda: c.drop_trigger("t"), lambda: c.create_sort_index("old", "age"), lambda: kind("int8")):
        with pytest.raises(ValueError):
            bad()
    c.drop_index("old")
    c.drop_index("human")
    c.drop_index("names")
    assert c.select().with_("old").count() == 0


def test_columns(spark, path):
    c = Collection(spark, path)
    c.create_columns_of({"n": 1, "x": 2.5, "s": "a", "b": True, "r": {"x": 1.0, "y": 2.0}})
    assert {n: k.name for n, k in c.kinds.items()} == {"expire": "expire", "n": "int", "x": "float64", "s": "string", "b": "bool", "r": "record"}
    with pytest.raises(TypeError):
        infer([1])
    c.insert(n=1, r={"x": 3.0, "y": 4.0})
    c.create_column("late", "string")
    assert c.frame().select("n", "late", "r.x").first() == (1, None, 3.0)
    c.insert(late="yes")
    c.drop_column("n")
    c.drop_column("never there")
    c.create_column("n", "int")
    assert [r["n"] for r in c.frame().collect()] == [None, None] and c.select().with_("late").count() == 1
    assert all(KINDS[n].numeric for n in ("int", "uint64", "float32")) and KINDS["enum"].textual


def test_every_number(spark, path):
    c = Collection(spark, path)
    names = ["int", "int16", "int32", "int64", "uint", "uint16", "uint32", "uint64", "float32", "float64"]
    for n in names:
        c.create_column(f"c_{n}", n)
    c.insert(**{f"c_{n}": 1 for n in names})
    with c.txn() as t:
        t.query_at(0, lambda r: [getattr(r, f"merge_{n}")(f"c_{n}", 1) for n in names])
    assert c.query_at(0, lambda r: [getattr(r, n)(f"c_{n}") for n in names]) == [2] * 10
    with pytest.raises(Exception, match="out of range"), c.txn() as t:
        t.select().set(c_uint16=70000)


def test_custom_merges(spark, path):
    c = Collection(spark, path)
    c.create_column("letters", kind("string", merge=lambda v, d: F.when(F.coalesce(v, F.lit("")) == "", d).otherwise(F.concat(v, F.lit(", "), d))))
    c.create_column("name", "string")
    c.create_column("age", kind("int32", merge=lambda v, d: F.coalesce(v, F.lit(0)) - d))
    c.create_column("tag", "enum")
    c.create_column("at", kind("record", type=infer({"x": 1.0}).type, merge=lambda v, d: F.struct((v["x"] + d["x"]).alias("x"))))
    c.insert(letters="a", name="m", age=100, tag="t", at={"x": 1.0})
    for _ in range(2):
        with c.txn() as t:
            t.select().merge(letters="b", name="merlin", age=7, tag="u", at={"x": 2.0})
    assert c.frame().select("letters", "name", "age", "tag", "at.x").first() == ("a, b, b", "merlin", 86, "t", 5.0)
    again = Collection(spark, path, create=False)  # rules aren't stored: no merge by another rule in their place
    with pytest.raises(ValueError, match="merge rule of age"), again.txn() as t:
        t.select().merge(age=7)
    again.merges["age"] = lambda v, d: v - d
    with again.txn() as t:
        t.select().merge(age=7, name="same")
    assert again.frame().select("name", "age").first() == ("same", 79)


def test_keys(spark, path):
    c = Collection(spark, path)
    c.create_column("id", "key")
    c.create_column("v", "string")
    c.create_column("n", "int")
    with pytest.raises(ValueError):
        c.create_column("second", "key")
    with pytest.raises(ValueError):
        c.insert(v="x")
    c.insert_key("a", v="1")
    assert c.upsert_key("a", v="2") == 0 and c.upsert_key("b", v="3", n=4) == 1
    with pytest.raises(KeyError):
        c.insert_key("a", v="9")
    with pytest.raises(KeyError), c.txn() as t:
        t.insert_key("x")
        t.insert_key("x")
    assert c.query_key("a", lambda r: (r.key(), r.string("v"))) == ("a", "2")
    with pytest.raises(KeyError):
        c.query_key("zz", lambda r: r)
    with pytest.raises(KeyError):
        c.delete_key("zz")
    with c.txn() as t:
        t.upsert_many(spark.createDataFrame([("b", "B"), ("c", "C"), ("d", "D")], "id string, v string"))
    assert {r["id"]: (r["v"], r["n"]) for r in c.frame().collect()} == {"a": ("2", None), "b": ("B", 4), "c": ("C", None), "d": ("D", None)}
    with pytest.raises(KeyError):
        c.insert_many(spark.createDataFrame([("d", "again")], "id string, v string"))
    with c.txn() as t:
        t.query_key("a", lambda r: r.set_key("e"))
    c.insert_key("a", v="free again")
    c.delete_key("b")
    assert sorted(r["id"] for r in c.frame().collect()) == ["a", "c", "d", "e"]


def test_expiry(spark, path):
    c = players(spark, path)
    with c.txn() as t:
        t.select().with_("human").set_ttl(100, now_ns=1000)
        t.query_at(1, lambda r: r.set_ttl(500, now_ns=1000))
    assert c.query_at(1, lambda r: r.ttl(now_ns=1200)) == 300 and c.query_at(3, lambda r: r.ttl()) is None
    with c.txn() as t:
        t.select().extend(50)
    assert rows(c, "expire") == {"bob": 1150, "al": 1550, "eve": 1150, "dan": None}
    assert c.vacuum(now_ns=1150) == 0 and c.vacuum(now_ns=1151) == 2
    assert sorted(rows(c, "age")) == ["al", "dan"]
    with c.txn() as t:
        t.select().set_ttl(0)
    assert c.vacuum() == 0


def test_triggers(spark, path):
    c, told = players(spark, path), []
    c.create_trigger("on_balance", "balance", lambda df: told.append(sorted((r["row_id"], r["op"], r["value"]) for r in df.collect())))
    with c.txn() as t:
        t.select().with_("human").merge(balance=1.0)
    c.insert(name="x", balance=5.0)
    c.delete_at(1)
    with c.txn() as t:
        t.select().set(name="same")
    c.drop_trigger("on_balance")
    c.insert(balance=9.0)
    assert [x for x in told if x] == [[(0, "put", 11.0), (2, "put", 31.0)], [(4, "put", 5.0)], [(1, "delete", None)]]


def test_snapshot_restore_and_compaction(spark, path, tmp_path, monkeypatch):
    c = players(spark, path)
    c.snapshot()
    c.insert(name="later", balance=4.0)
    away = f"{tmp_path}/away"
    c.snapshot(away)
    mark = c.manifest.version
    with c.txn() as t:
        t.select().with_("human").merge(balance=1.0)
    c.delete_at(1)
    r = players(spark, f"{tmp_path}/other")
    r.restore(away)
    assert r.count() == 5 and r.select().sum("balance") == 64.0
    r.restore(away, c.changes(mark))
    assert r.count() == 4 and r.select().sum("balance") == c.select().sum("balance") == 46.0
    assert c.table(version=mark).df.count() == 5
    monkeypatch.setattr("quillon.sources.store.SMALL", -1)  # the other join
    assert c.count() == 4 and c.select().sum("balance") == 46.0
    monkeypatch.undo()
    few = players(spark, f"{tmp_path}/few", compact=3)
    for i in range(7):
        few.insert(name=f"n{i}")
    assert few.count() == 11 and len([x for x in few.manifest.changes if x["version"] > few.manifest.base_commit]) < 3
    bad = Collection(spark, f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        bad.restore(away)


def test_snapshot_restore_query_at_its_bound(spark, tmp_path):
    from quillon.queries import ORACLE_SQL, QUERIES

    balances = (None, float("nan"), -1.0, 0.0, 8998.99, 8999.0, 8999.8, 9000.0, 9001.0)
    made = [(f"{s}{b}", b, s) for s in ("BUILDING", "FURNITURE", None) for b in balances]
    df = spark.createDataFrame(made, "c_name string, c_acctbal double, c_mktsegment string")
    df.write.parquet(f"{tmp_path}/customer.parquet")
    df.createOrReplaceTempView("customer")
    try:
        want = sorted(map(tuple, spark.sql(ORACLE_SQL["snapshot_restore"]).collect()))
    finally:
        spark.catalog.dropTempView("customer")
    got = sorted(map(tuple, QUERIES["snapshot_restore"](spark, str(tmp_path)).collect()))
    assert got == want and len(got) == 15 and ("BUILDING8999.8", 9000.8) in got


def test_restore_with_a_row_merged_and_then_deleted(spark, path, tmp_path):
    c, r = players(spark, path), players(spark, f"{tmp_path}/other")
    c.snapshot(f"{tmp_path}/away")
    mark = c.manifest.version
    with c.txn() as t:
        t.select().with_("human").merge(balance=1.0)
    with c.txn() as t:
        t.select().with_float("balance", lambda b: b >= 31).delete_all()  # eve, by the merged balance
    r.restore(f"{tmp_path}/away", c.changes(mark))
    assert rows(r, "balance") == rows(c, "balance") == {"bob": 11.0, "al": 20.0, "dan": None}


def test_replay_is_idempotent(spark, path, tmp_path):
    c, r = players(spark, path), players(spark, f"{tmp_path}/replica")
    with r.txn() as t:
        t.select().delete_all()
    with c.txn() as t:
        t.select().with_("human").merge(balance=2.0)
    c.delete_at(1)
    for _ in range(2):
        r.replay(c.changes(), "c")
    with c.txn() as t:
        t.select().merge(balance=1.0)
    r.replay(c.changes(), "c")
    assert rows(r, "balance", "age") == rows(c, "balance", "age")
    assert sorted({x["chunk"] for x in c.changes().collect()}) == [0]


def test_publish_is_exclusive(spark, path):
    c = Collection(spark, path)
    with pytest.raises(Conflict):
        Store(spark, path).publish(c.manifest)


def test_json_source(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"name": "a", "age": 3},\n {"name": "b"}]')
    assert from_json(spark, f"{tmp_path}/p.json", "name string, age int").orderBy("name").collect() == [("a", 3), ("b", None)]


def test_log_of_commits(spark, path, tmp_path):
    c, r = players(spark, path), players(spark, f"{tmp_path}/replica")
    with r.txn() as t:
        t.select().delete_all()
    log = Log(spark, f"{tmp_path}/log")
    log.append(c.changes())
    c.on_commit(log.append)
    with c.txn() as t:
        t.select().with_("human").merge(balance=2.0)
    c.delete_at(1)
    log.append(c.changes(c.manifest.version - 1))  # once more
    assert log.range().count() == c.changes().count() == 7
    assert log.range(since=c.manifest.version - 1).count() == 1
    r.replay(log.copy(f"{tmp_path}/copy").range(), "log")
    assert rows(r, "balance", "age") == rows(c, "balance", "age")


def test_accessors(spark, path):
    c = players(spark, path)
    s = c.select().with_("human")
    assert s.float64("balance").sum() == 40.0 and s.int16("age").avg() == 35.0 and s.any("balance").max() == (30.0, True)
    assert sorted(r[1] for r in s.string("name").rows().collect()) == ["bob", "eve"]
    for bad in (lambda: s.int32("age"), lambda: s.float64("name")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        s.any("nope")
    with pytest.raises(ValueError):
        s.key()
    with c.txn() as t:
        t.select().with_("human").int16("age").set(30).merge(1)
        t.select().with_("human").ttl().set_ttl(3_000_000_000, now_ns=0).extend(1)
    at = c.select().ttl()
    got = {r[0]: (r[1], r[2]) for r in c.select().select("name", at.ttl(1).alias("t"), at.expires_at().cast("long").alias("e")).collect()}
    assert rows(c, "age")["eve"] == 31 and got["bob"] == (2_999_999_999, 3) and got["al"] == (None, None)


def test_a_writer_that_died_is_in_nobodys_way(spark, path, monkeypatch):
    c = players(spark, path)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Store, "publish", dies)
        with pytest.raises(RuntimeError, match="killed"):
            c.insert(name="lost")
    again = Collection(spark, path)
    again.insert(name="kept", race="elf")
    c.refresh()
    assert c.count() == 5 and "kept" in rows(c, "age") and "lost" not in rows(c, "age")


def test_two_writers_race(spark, path):
    c = players(spark, path)
    other = Collection(spark, path)
    first, second = c.txn(), other.txn()
    one, two = first.__enter__(), second.__enter__()
    frame = from_rows(spark, [("x", 1)], "name string, age short")
    one.insert_many(frame)
    two.insert_many(frame)
    first.__exit__(None, None, None)
    with pytest.raises(Conflict):
        second.__exit__(None, None, None)
    c.refresh()
    assert c.count() == 5
    left = {s.getPath().getName() for s in c.store.fs.listStatus(c.store._path(f"{path}/changes"))}
    assert left == {e["path"].rsplit("/", 1)[1] for e in c.manifest.changes}
    assert not [s for s in c.store.fs.listStatus(c.store._path(path)) if s.getPath().getName().startswith("_staged-")]


def test_a_restored_collection_needs_no_snapshot(spark, path, tmp_path):
    c = players(spark, path)
    c.snapshot(f"{tmp_path}/snap")
    other = players(spark, f"{path}-other")
    other.restore(f"{tmp_path}/snap")
    other.store.delete(f"{tmp_path}/snap")
    assert rows(other, "age") == rows(c, "age")


def _pack(v):
    return struct.pack("<dd", v["x"], v["y"])


def _unpack(b):
    return dict(zip("xy", struct.unpack("<dd", b), strict=True))


@pytest.mark.parametrize("form", ["json", "python"])
def test_record_codecs(spark, path, form):
    pair = infer({"x": 1.0, "y": 1.0}).type
    codec = json_codec(pair) if form == "json" else python_codec(pair, _pack, _unpack)
    c = Collection(spark, path)
    moved = lambda v, d: F.struct((v["x"] + d["x"]).alias("x"), (v["y"] + d["y"]).alias("y"))
    c.create_column("at", kind("record", merge=moved, codec=codec))
    c.create_column("n", "int32")
    c.insert(at={"x": 1.0, "y": 2.0}, n=0)
    c.insert(n=1)  # no record
    c.insert_many(spark.createDataFrame([((5.0, 6.0), 2)], "at struct<x: double, y: double>, n int"))
    with c.txn() as t:
        t.select().with_int("n", lambda n: n != 1).merge(at={"x": 1.0, "y": 1.0})
    stored = {r.n: r["at"] for r in c.frame().collect()}
    assert stored[1] is None and isinstance(stored[0], (bytes, bytearray))
    if form == "python":
        assert bytes(stored[0]) == struct.pack("<dd", 2.0, 3.0)
    read = {r.row_id: r["at"] for r in c.select().record("at").rows().collect()}
    assert read == {0: (2.0, 3.0), 1: None, 2: (6.0, 7.0)}
    assert c.query_at(2, lambda r: r.record("at")) == (6.0, 7.0) and c.query_at(1, lambda r: r.record("at")) is None
    again = Collection(spark, path, create=False)
    assert again.query_at(0, lambda r: bytes(r.record("at"))) == bytes(stored[0])  # bytes, until the codec is given again
    again.codecs["at"] = codec
    assert again.query_at(0, lambda r: r.record("at")) == (2.0, 3.0)
    with again.txn() as t:
        t.query_at(1, lambda r: r.set_record("at", {"x": 8.0, "y": 9.0}))
    assert again.query_at(1, lambda r: r.record("at")) == (8.0, 9.0)


def test_kinds_of_ones_own(spark, path, monkeypatch):
    monkeypatch.setattr("quillon.functions.kinds.KINDS", dict(KINDS))
    slug = register(Kind("slug", T.StringType(), lambda v, d: F.concat_ws("-", v, d), store=lambda v: F.lower(F.replace(v, F.lit(" "), F.lit("-")))))
    assert register(slug) is slug
    with pytest.raises(ValueError, match="taken"):
        register(Kind("int", T.StringType()))
    with pytest.raises(ValueError, match="codec"):
        kind("slug", codec=json_codec(T.LongType()))
    c = Collection(spark, path)
    c.create_column("name", "slug")
    c.insert(name="The Old Man")
    c.insert()
    with c.txn() as t:
        t.select().merge(name="And More")
    assert [r[0] for r in Collection(spark, path, create=False).select().range("name").select("name").collect()] == ["the-old-man-and-more", "and-more"]
