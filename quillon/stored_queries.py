"""Queries of stored collections, each by way of Collection itself, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collection import EXPIRE, Collection
from .functions.kinds import Kind, json_codec, kind, register
from .functions.values import python
from .queries import nations, stored
from .sources.files import from_json, from_rows
from .sources.log import Log
from .streaming.changes import change_stream, on_change, replicate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def named(spark: SparkSession, d: str) -> Collection:
    """Nations by the key n_name."""
    c = stored(spark, "named", n_name="key", n_nationkey="int32", n_regionkey="int32")
    c.insert_many(spark.read.parquet(f"{d}/nation.parquet"))
    return c


def one(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


@query("select count(*) as n from nation")
def collection_reopened(spark, d):
    c = nations(spark, d)
    c.close()
    return one(spark, "n long", Collection(spark, c.store.root, create=False).count())


@query("select n_nationkey, n_name from nation where n_regionkey = 1")
def json_source(spark, d):
    c = stored(spark, "json", n_nationkey="int32", n_name="string", n_regionkey="int32")
    rows = spark.read.parquet(f"{d}/nation.parquet")
    rows.write.json(f"{c.store.root}/given")
    c.insert_many(from_json(spark, f"{c.store.root}/given", rows.schema, multiline=False))
    return c.select().with_int("n_regionkey", lambda r: r == 1).select("n_nationkey", "n_name")


@query("select * from (values ('a', cast(1 as bigint)), ('b', cast(2 as bigint)), ('c', null)) as t(label, n)")
def rows_source(spark, d):
    c = stored(spark, "rows", label="string", n="int64")
    c.insert_many(from_rows(spark, [("a", 1), ("b", 2), ("c", None)], "label string, n long"))
    return c.select().select("label", "n")


@query("select 'delete' as op, count(*) as n from nation where n_regionkey=2 union all select 'put', count(*) from nation where n_regionkey=0")
def log_file_sink(spark, d):
    c = nations(spark, d)
    log = Log(spark, f"{c.store.root}-log")
    c.on_commit(log.append)
    with c.txn() as t:
        t.select().with_("first").set(n_name="changed")
        t.select().with_("third").delete_all()
    return log.copy(f"{c.store.root}-copy").range().groupBy("op").agg(F.count("*").alias("n"))


@query("select count(*) as n from nation where n_regionkey in (0, 1)")
def custom_sink(spark, d):
    c, told = nations(spark, d), []
    c.on_commit(lambda changes: told.append(changes.count()))
    for index in ("first", "second"):
        with c.txn() as t:
            t.select().with_(index).set(n_name="changed")
    return one(spark, "n long", sum(told))


NUMBERS = ("int", "int16", "int32", "int64", "uint", "uint16", "uint32", "uint64", "float32", "float64")


@query("select n_nationkey, " + ", ".join(f"cast(n_nationkey + {2 * i + 1} as double) as c_{k}" for i, k in enumerate(NUMBERS)) + " from nation")
def number_accessors(spark, d):
    c = stored(spark, "numbers", n_nationkey="int32", **{f"c_{k}": k for k in NUMBERS})
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey")
    c.insert_many(rows.select("*", *(F.col("n_nationkey").cast(c.kinds[f"c_{k}"].type).alias(f"c_{k}") for k in NUMBERS)))
    with c.txn() as t:
        for i, k in enumerate(NUMBERS):
            getattr(t.select(), k)(f"c_{k}").merge(2 * i + 1)
    s = c.select()
    return s.select("n_nationkey", *(getattr(s, k)(f"c_{k}").get().cast("double").alias(f"c_{k}") for k in NUMBERS))


@query("select c_custkey, c_name || '!' as name, case when c_custkey < 10 then 'NEW' else c_mktsegment end as segment from customer")
def text_accessors(spark, d):
    c = stored(spark, "texts", c_custkey="int64", c_name="string", c_mktsegment="enum")
    c.insert_many(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"))
    with c.txn() as t:
        t.select().string("c_name").set(F.concat("c_name", F.lit("!")))
        t.select().with_int("c_custkey", lambda k: k < 10).enum("c_mktsegment").set("NEW")
    s = c.select()
    return s.select("c_custkey", s.string("c_name").get().alias("name"), s.enum("c_mktsegment").get().alias("segment"))


@query("select n_name as k, n_name is not null as there from nation")
def key_accessor(spark, d):
    s = named(spark, d).select()
    return s.select(s.key().get().alias("k"), s.any("n_name").has().alias("there"))


@query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def enum_filter(spark, d):
    c = stored(spark, "enums", c_custkey="int64", c_mktsegment="enum")
    c.insert_many(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment"))
    return c.select().with_string("c_mktsegment", lambda s: s.isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("select n_nationkey, cast(n_nationkey + 5 as bigint) * 1000000000 as ttl, true as set from nation where n_nationkey > 3")
def ttl_accessor(spark, d):
    c, now = nations(spark, d), 1_700_000_000_000_000_000
    with c.txn() as t:
        t.select().with_int("n_nationkey", lambda k: k > 3).set(expire=F.lit(now) + (F.col("n_nationkey").cast("long") + 2) * 1_000_000_000)
    with c.txn() as t:
        t.select().ttl().extend(3_000_000_000)
    s = c.select().with_int("n_nationkey", lambda k: k > 3)
    return s.select("n_nationkey", s.ttl().ttl(now).alias("ttl"), s.ttl().expires_at().isNotNull().alias("set"))


@query("select n_name, cast(n_nationkey as bigint) as a, cast(n_regionkey as bigint) as b from nation where n_nationkey = 7")
def row_getters(spark, d):
    c = named(spark, d)
    name = c.select().with_int("n_nationkey", lambda k: k == 7).select("n_name").first()[0]
    return one(spark, "n_name string, a long, b long", *c.query_key(name, lambda r: (r.key(), r.int32("n_nationkey"), r.get("n_regionkey"))))


@query("select n_nationkey, n_nationkey * 10 + n_regionkey as both from nation")
def derived_in_range(spark, d):
    return nations(spark, d).select().range("n_nationkey", (F.col("n_nationkey") * 10 + F.col("n_regionkey")).alias("both"))


@query("select count(*) filter (n_nationkey % 2 = 0) as even, count(*) as n from nation")
def row_iteration(spark, d):
    seen = [r["n_nationkey"] for r in nations(spark, d).select().iterate("n_nationkey")]
    return one(spark, "even long, n long", len([k for k in seen if k % 2 == 0]), len(seen))


@query("select sum(n_regionkey)::bigint as total from nation where n_nationkey < 5")
def lookup_while_iterating(spark, d):
    c = named(spark, d)
    wanted = [r["n_name"] for r in c.select().with_int("n_nationkey", lambda k: k < 5).iterate("n_name")]
    with c.txn() as t:
        return one(spark, "total long", sum(t.query_key(k, lambda r: r.int32("n_regionkey")) for k in wanted))


@query("select n_name, n_nationkey from nation union all select 'ATLANTIS', 77")
def insert_key(spark, d):
    c = named(spark, d)
    c.insert_key("ATLANTIS", n_nationkey=77)
    try:
        c.insert_key("ATLANTIS", n_nationkey=78)  # is there already
    except KeyError:
        pass
    return c.select().select("n_name", "n_nationkey")


@query("select n_name, case when n_nationkey = 3 then 33 else n_nationkey end as n_nationkey from nation union all select 'ATLANTIS', 77")
def upsert_by_key(spark, d):
    c = named(spark, d)
    name = c.select().with_int("n_nationkey", lambda k: k == 3).select("n_name").first()[0]
    c.upsert_key(name, n_nationkey=33)
    c.upsert_key("ATLANTIS", n_nationkey=77)
    return c.select().select("n_name", "n_nationkey")


@query("select n_name, case when n_nationkey = 4 then 104 else n_nationkey end as n_nationkey, case when n_nationkey = 4 then 9 else n_regionkey end as n_regionkey from nation where n_nationkey <> 5")
def update_and_delete_by_key(spark, d):
    c = named(spark, d)
    four, five = (c.select().with_int("n_nationkey", lambda k, n=n: k == n).select("n_name").first()[0] for n in (4, 5))
    c.query_key(four, lambda r: r.merge("n_nationkey", 100).set("n_regionkey", 9))
    c.delete_key(five)
    return c.select().select("n_name", "n_nationkey", "n_regionkey")


@query("select n_nationkey, case when n_nationkey = 6 then 'many' else n_name end as n_name, case when n_nationkey = 6 then 8 else n_regionkey end as n_regionkey from nation where n_nationkey <> 2")
def delete_and_set_at(spark, d):
    c = nations(spark, d)
    at = {r["n_nationkey"]: r["row_id"] for r in c.select().with_int("n_nationkey", lambda k: k.isin(2, 6)).select("row_id", "n_nationkey").collect()}
    c.delete_at(at[2])
    c.query_at(at[6], lambda r: r.set_many({"n_name": "many", "n_regionkey": 8}))
    return c.select().select("n_nationkey", "n_name", "n_regionkey")


@query("select n_nationkey, n_regionkey - 3 * n_nationkey as n_regionkey, n_name || ', ' || n_name || '?' as n_name from nation")
def merge_rules(spark, d):
    c = stored(spark, "merges", n_nationkey="int32")
    c.create_column("n_regionkey", kind("int32", merge=lambda now, x: now - x))
    c.create_column("n_name", kind("string", merge=lambda now, x: F.concat(now, F.lit(", "), x)))
    c.insert_many(spark.read.parquet(f"{d}/nation.parquet"))
    with c.txn() as t:
        t.select().merge(n_regionkey=F.col("n_nationkey") * 3, n_name=F.concat("n_name", F.lit("?")))
    return c.select().select("n_nationkey", "n_regionkey", "n_name")


@query("select n_nationkey, cast(n_nationkey * 4 as double) as x, cast(n_regionkey + 3 as double) as y from nation")
def merge_record(spark, d):
    pair = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    moved = lambda now, by: F.struct((now["x"] + by["x"]).alias("x"), (now["y"] + by["y"]).alias("y"))
    c = stored(spark, "records", n_nationkey="int32")
    c.create_column("at", kind("record", merge=moved, type=pair))
    given = F.struct(F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    c.insert_many(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", given.alias("at")))
    for _ in range(3):
        with c.txn() as t:
            t.select().merge(at=F.struct(F.col("n_nationkey").cast("double").alias("x"), F.lit(1.0).alias("y")))
    return c.select().select("n_nationkey", F.col("at.x").alias("x"), F.col("at.y").alias("y"))


@query("select n_nationkey, cast(n_nationkey * 2 as double) as x, cast(n_regionkey + 1 as double) as y from nation")
def record_codec(spark, d):
    pair = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    moved = lambda now, by: F.struct((now["x"] + by["x"]).alias("x"), (now["y"] + by["y"]).alias("y"))
    c = stored(spark, "codecs", n_nationkey="int32")
    c.create_column("at", kind("record", merge=moved, codec=json_codec(pair)))
    given = F.struct(F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    c.insert_many(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", given.alias("at")))
    with c.txn() as t:
        t.select().merge(at=F.struct(F.col("n_nationkey").cast("double").alias("x"), F.lit(1.0).alias("y")))
    s = c.select()
    at = s.record("at").get()
    return s.select("n_nationkey", at["x"].alias("x"), at["y"].alias("y"))


SLUG = Kind("slug", T.StringType(), lambda now, x: F.concat_ws("-", now, x), store=lambda v: F.lower(F.replace(v, F.lit(" "), F.lit("-"))))


@query("select n_nationkey, lower(replace(n_name, ' ', '-')) || '-next-one' as slug from nation")
def registered_kind(spark, d):
    register(SLUG)
    c = stored(spark, "kinds", n_nationkey="int32")
    c.create_column("slug", "slug")
    c.insert_many(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.col("n_name").alias("slug")))
    with c.txn() as t:
        t.select().merge(slug="Next One")
    return c.select().select("n_nationkey", "slug")


@query("select count(*) as before, count(*) as inside, count(*) + 1 as after from nation")
def reads_committed_data_only(spark, d):
    c = nations(spark, d)
    before = c.count()
    with c.txn() as t:
        t.insert(n_nationkey=50)
        t.select().with_("first").set(n_name="not yet")
        inside = t.count() + t.select().with_string("n_name", lambda s: s == "not yet").count()
    return one(spark, "before long, inside long, after long", before, inside, c.count())


@query("select n_nationkey, n_name from nation")
def isolation_of_versions(spark, d):
    c = nations(spark, d)
    then = c.select()  # of the version that was the newest
    with c.txn() as t:
        t.select().set(n_name="later")
        t.select().with_("third").delete_all()
    return then.select("n_nationkey", "n_name")


@query("select n_nationkey, n_name, null::bigint as age, case when n_regionkey = 0 then 1.5e0 end as score from nation")
def schema_changes(spark, d):
    c = nations(spark, d)
    c.create_columns_of({"age": 5, "score": 1.5, "gone": "x"})
    c.drop_column("gone")
    c.drop_index("second")
    with c.txn() as t:
        t.select().with_("first").set(score=1.5)
        t.select().with_("second").set(score=9.0)  # an index that is no more selects nothing
    return c.select().select("n_nationkey", "n_name", "age", "score")


@query("select * from (values ('expire', 'expire'), ('n_name', 'string'), ('n_nationkey', 'int32'), ('n_regionkey', 'int32')) as t(name, kind)")
def registry(spark, d):
    again = Collection(spark, nations(spark, d).store.root, create=False)
    return spark.createDataFrame([(n, k.name) for n, k in again.kinds.items()], "name string, kind string")


@query("select n_nationkey as value, 'put' as op from nation where n_regionkey = 0 union all select null, 'delete' from nation where n_regionkey = 2")
def trigger(spark, d):
    c, told = nations(spark, d), []
    c.create_trigger("on_key", "n_nationkey", lambda df: told.extend((r["value"], r["op"]) for r in df.collect()))
    with c.txn() as t:
        t.select().with_("first").merge(n_nationkey=0)
        t.select().with_("second").set(n_name="another column")
        t.select().with_("third").delete_all()
    c.drop_trigger("on_key")
    c.insert(n_nationkey=99)
    return spark.createDataFrame(told, "value int, op string")


@query("select n_nationkey, case when n_regionkey = 0 then 'changed' else n_name end as n_name from nation where n_regionkey <> 2")
def replicate_stream(spark, d):
    c = nations(spark, d)
    with c.txn() as t:
        t.select().with_("first").set(n_name="changed")
    with c.txn() as t:
        t.select().with_("third").delete_all()
    other = stored(spark, "copy", n_nationkey="int32", n_name="string", n_regionkey="int32")
    replicate(c, other, f"{other.store.root}-marks", per_batch=1).awaitTermination(120)
    return other.select().select("n_nationkey", "n_name")


@query("select c_custkey, c_name from customer")
def replay_split_commit(spark, d):
    c = stored(spark, "many-files", c_custkey="int64", c_name="string")
    c.insert_many(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name").repartition(6))  # one commit of several files
    other = stored(spark, "copy", c_custkey="int64", c_name="string")
    replicate(c, other, f"{other.store.root}-marks", per_batch=1).awaitTermination(120)
    return other.select().select("c_custkey", "c_name")


@query("select 'insert' as op, count(*) as n from nation union all select 'put', count(*) from nation where n_regionkey = 1")
def change_stream_batches(spark, d):
    c, seen = nations(spark, d), {}
    with c.txn() as t:
        t.select().with_("second").set(n_name="changed")

    def act(changes: DataFrame) -> None:
        for r in changes.groupBy("op").count().collect():
            seen[r["op"]] = seen.get(r["op"], 0) + r["count"]

    change_stream(c, act, f"{c.store.root}-marks", per_batch=1).awaitTermination(120)
    return spark.createDataFrame(list(seen.items()), "op string, n long")


@query("select n_name as value from nation union all select 'changed' from nation where n_regionkey = 1")
def trigger_on_stream(spark, d):
    c, told = nations(spark, d), []
    with c.txn() as t:
        t.select().with_("second").set(n_name="changed")
    on_change(c, "n_name", lambda df: told.extend((r["value"],) for r in df.collect()), f"{c.store.root}-marks").awaitTermination(120)
    return spark.createDataFrame(told, "value string")


@query("select n_nationkey, n_name from nation union all select 50, 'after'")
def txn_after_crash(spark, d):
    c = nations(spark, d)
    version = c.manifest.version + 1
    # what a writer leaves that died before it published
    c.changes().drop("chunk").write.parquet(f"{c.store.root}/changes/{version}-dead")
    c.insert(n_nationkey=50, n_name="after")
    return c.select().select("n_nationkey", "n_name")


@query("select n_nationkey from nation where n_nationkey % 3 = 1")
def python_predicate(spark, d):
    return nations(spark, d).select().with_value("n_nationkey", python(lambda k: k % 3 == 1)).select("n_nationkey")


@query("select n_nationkey, n_nationkey % 2 = 0 as even from nation")
def index_by_function(spark, d):
    c = nations(spark, d)
    c.create_index("even", "n_nationkey", lambda k: k % 2 == 0)
    return c.select().select("n_nationkey", "even")


@query("select n_nationkey, n_nationkey + 1000 as extended from nation where n_regionkey <> 0")
def eviction(spark, d):
    c, now = nations(spark, d), 1_000_000
    with c.txn() as t:
        t.select().with_("first").set_ttl(10, now_ns=now - 100)
        t.select().without("first").set(expire=F.lit(now) + F.col("n_nationkey").cast("long"))
    with c.txn() as t:
        t.select().extend(1000)
    with c.txn() as t:
        t.select().with_("first").merge(expire=-1000)
    c.vacuum(now_ns=now)
    return c.select().select("n_nationkey", (F.col(EXPIRE) - now).cast("int").alias("extended"))


@query("select n_nationkey, case when n_regionkey = 0 then 'b' else n_name end as n_name from nation where n_regionkey <> 1")
def restore_with_changes(spark, d):
    c = nations(spark, d)
    c.snapshot(f"{c.store.root}-snapshot")
    mark = c.manifest.version
    with c.txn() as t:
        t.select().with_("first").set(n_name="a")
    with c.txn() as t:
        t.select().with_("first").set(n_name="b")
        t.select().with_("second").delete_all()
    other = stored(spark, "restored", n_nationkey="int32", n_name="string", n_regionkey="int32")
    other.restore(f"{c.store.root}-snapshot", c.changes(mark))
    other.store.delete(f"{c.store.root}-snapshot")
    return other.select().select("n_nationkey", "n_name")
