import uuid

import pytest
from pyspark.sql import functions as F

from quillon.collection import Collection
from quillon.streaming import changes as S


@pytest.fixture
def pair(spark, tmp_path):
    made = []
    for name in ("source", "target"):
        c = Collection(spark, f"{tmp_path}/{name}")
        c.create_column("name", "string")
        c.create_column("n", "int")
        made.append(c)
    return made


def run(query):
    query.processAllAvailable()
    query.awaitTermination(60)


def rows(c):
    c.refresh()
    return sorted((r["row_id"], r["name"], r["n"]) for r in c.frame().collect())


def test_replicate_in_steps(spark, pair, tmp_path):
    source, target = pair
    for i in range(3):
        source.insert(name=f"p{i}", n=i)
    run(S.replicate(source, target, f"{tmp_path}/cp"))
    assert rows(target) == rows(source) and len(rows(source)) == 3
    with source.txn() as t:
        t.select().with_int("n", lambda c: c > 0).merge(n=10)
    source.delete_at(0)
    run(S.replicate(source, target, f"{tmp_path}/cp"))
    assert rows(target) == rows(source) == [(1, "p1", 11), (2, "p2", 12)]
    run(S.replicate(source, target, f"{tmp_path}/another"))  # all of it once more
    assert rows(target) == rows(source)


def test_commits_are_streamed_whole_and_only_once_published(spark, pair, tmp_path):
    source, target = pair
    source.insert_many(spark.range(100).selectExpr("concat('p', id) as name", "id as n").repartition(4))
    source.insert(name="last", n=1)
    # a writer that died before it published
    source.changes().withColumn("row_id", F.col("row_id") + 1000).withColumn("commit_id", F.lit(99).cast("long")).drop("chunk").write.parquet(f"{source.store.root}/changes/99-dead")
    batches = []
    run(S.change_stream(source, lambda df: batches.append(sorted(r[0] for r in df.groupBy("commit_id").count().collect())), f"{tmp_path}/seen", per_batch=1))
    newest = source.manifest.version
    assert sorted(x for b in batches for x in b) == [newest - 1, newest] and all(len(b) <= 1 for b in batches)
    run(S.replicate(source, target, f"{tmp_path}/cp", per_batch=1))
    assert len(rows(target)) == 101 and rows(target) == rows(source)


def test_on_change(spark, pair, tmp_path):
    source, _ = pair
    told = []
    source.insert(name="a", n=1)
    with source.txn() as t:
        t.select().set(name="b")
    source.delete_at(0)
    run(S.on_change(source, "n", lambda df: told.extend(tuple(r) for r in df.orderBy("commit_id").select("row_id", "op", "value").collect()), f"{tmp_path}/cp"))
    assert told == [(0, "put", 1), (0, "delete", None)]


def test_sweep(spark, pair, tmp_path):
    source, _ = pair
    source.insert(name="stays")
    source.insert(name="goes", expire=100)
    own = S.sweep(source, f"{tmp_path}/cp", every="200 milliseconds", now_ns=lambda: 101)
    for _ in range(60):
        own.awaitTermination(1)
        if source.count() == 1:
            break
    source.close()
    assert [r["name"] for r in source.frame().collect()] == ["stays"] and not own.isActive


def test_running_state(spark, tmp_path):
    schema = "k string, seq long, v double, s string"
    first, second = [("a", 1, 1.10, "x"), ("a", 2, 2.2, "y"), ("b", 1, 5.0, "z")], [("a", 3, 3.3, "w")]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def result(df, mode):
        name = f"q{uuid.uuid4().hex}"
        own = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        run(own)
        return spark.table(name)

    assert {tuple(r) for r in result(S.running_last(stream(), "k", "seq"), "complete").collect()} == {("a", 3), ("b", 1)}
    assert {tuple(r) for r in result(S.running_sum(stream(), "k", "v"), "complete").collect()} == {("a", 6.6), ("b", 5.0)}
    folded = result(S.running_merge(stream(), "k", "seq", "s", lambda now, d: now + d, ""), "update")
    longest = folded.groupBy("k").agg(F.max_by("s", F.length("s")).alias("s"))
    assert {tuple(r) for r in longest.collect()} == {("a", "xyw"), ("b", "z")}
