"""Collections: mutable tables with indexes, keys, expiry, triggers, transactions, snapshots and a change log.

A collection is a versioned folder (sources/store.py). Reads are DataFrames of one version. A transaction holds
the expressions of its writes and computes the changed rows in one pass over the version it began with; when its
block ends without an error they are written and the next version is published, else nothing is.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import kinds as K
from .functions.kinds import Codec, Kind, MergeRule
from .functions.values import Rule, holds, rule
from .operators import keys
from .plans.accessor import SAME
from .plans.selection import ROW, Selection, Table
from .sources.store import CHANGE, Conflict, Manifest, Store, change_schema, folded, read

EXPIRE = "expire"
#: Versions since the base after which a commit writes a new base.
COMPACT = 64


class Collection:
    def __init__(self, spark: SparkSession, path: str, strict: bool = False, create: bool = True, compact: int = COMPACT):
        self.spark, self.store, self.strict, self.compact = spark, Store(spark, path), strict, compact
        self.merges: dict[str, MergeRule] = {}  # functions aren't stored: give them again after opening
        self.codecs: dict[str, Codec] = {}  # likewise
        self.rules: dict[str, tuple[str, Rule]] = {}
        self.triggers: dict[str, tuple[str, Callable[[DataFrame], None]]] = {}
        self._closing: list = []
        self._sinks: list[Callable[[DataFrame], None]] = []
        try:
            self.manifest = self.store.load()
        except FileNotFoundError:
            if not create:
                raise
            self.manifest = Manifest(kinds={EXPIRE: {"name": "expire", "type": T.LongType().json()}})
            self.store.publish(self.manifest)

    # what there is

    @property
    def kinds(self) -> dict[str, Kind]:
        return {c: K.kind(k["name"], self.merges.get(c), T._parse_datatype_json_string(k["type"]), self.codecs.get(c)) for c, k in self.manifest.kinds.items()}

    @property
    def key(self) -> str | None:
        return next((c for c, k in self.manifest.kinds.items() if k["name"] == "key"), None)

    @property
    def indexes(self) -> dict[str, tuple[str, Rule]]:
        return {**{n: (c, r) for n, (c, r) in self.manifest.indexes.items()}, **self.rules}

    def refresh(self) -> None:
        self.manifest = self.store.load()

    def table(self, version: int | None = None) -> Table:
        """The rows of a version, for selections."""
        manifest = self.manifest if version is None else self.store.load(version)
        found = self.kinds
        df = read(self.store, manifest, {c: k.type for c, k in found.items()})
        return Table(df, found, self.indexes, dict(self.manifest.sorts), self.key, self.strict)

    def select(self) -> Selection:
        return self.table().select()

    def frame(self) -> DataFrame:
        return self.table().df

    def count(self) -> int:
        return self.frame().count()

    # schema

    def _free(self, name: str) -> None:
        if name in self.manifest.kinds or name in self.indexes or name in self.manifest.sorts or name in self.triggers:
            raise ValueError(f"{name} is taken")

    def _redefine(self, **new) -> None:
        changed = replace(self.manifest, version=self.manifest.version + 1, **new)
        self.store.publish(changed)
        self.manifest = changed

    def create_column(self, name: str, kind: Kind | str) -> None:
        self._free(name)
        if name in (ROW, "op", "written"):
            raise ValueError(f"{name} is reserved")
        kind = K.kind(kind) if isinstance(kind, str) else kind
        if kind.name == "key" and self.key is not None:
            raise ValueError("there is a key already")
        known = K.kind(kind.name, type=kind.type)
        stored = {"name": kind.name, "type": kind.type.json()}
        if kind.merge is not None and kind.merge is not known.merge:
            self.merges[name] = kind.merge
            stored["own_merge"] = True
        if kind.codec is not None:
            self.codecs[name] = kind.codec
        self._redefine(kinds={**self.manifest.kinds, name: stored})

    def create_columns_of(self, sample: dict) -> None:
        """Columns whose kinds come from sample values."""
        for name, kind in {n: K.infer(v) for n, v in sample.items()}.items():
            self.create_column(name, kind)

    def drop_column(self, name: str) -> None:
        """Does nothing if there is none. Indexes of the column go too."""
        if name == EXPIRE or name not in self.manifest.kinds:
            return
        self.merges.pop(name, None)
        self.codecs.pop(name, None)
        self.rules = {n: x for n, x in self.rules.items() if x[0] != name}
        self._redefine(
            kinds={c: k for c, k in self.manifest.kinds.items() if c != name},
            indexes={n: x for n, x in self.manifest.indexes.items() if x[0] != name},
            sorts={n: c for n, c in self.manifest.sorts.items() if c != name},
        )
        self.snapshot()  # a later column of this name must not find the old values

    def create_index(self, name: str, column: str, given: Rule) -> None:
        """A named rule over one column. Rules as SQL text are stored; others are this object's."""
        self._free(name)
        if column not in self.manifest.kinds:
            raise ValueError(f"no column {column}")
        if isinstance(given, str):
            rule(given, F.col(column))
            self._redefine(indexes={**self.manifest.indexes, name: [column, given]})
        else:
            self.rules[name] = (column, given)

    def create_sort_index(self, name: str, column: str) -> None:
        self._free(name)
        if column not in self.manifest.kinds:
            raise ValueError(f"no column {column}")
        self._redefine(sorts={**self.manifest.sorts, name: column})

    def drop_index(self, name: str) -> None:
        if name in self.rules:
            del self.rules[name]
        elif name in self.manifest.indexes or name in self.manifest.sorts:
            self._redefine(indexes={n: x for n, x in self.manifest.indexes.items() if n != name}, sorts={n: c for n, c in self.manifest.sorts.items() if n != name})
        else:
            raise ValueError(f"no index {name}")

    def on_commit(self, append: Callable[[DataFrame], None]) -> None:
        """After each commit append gets its changes, as changes() has them: a sink of one's own."""
        self._sinks.append(append)

    def create_trigger(self, name: str, column: str, act: Callable[[DataFrame], None]) -> None:
        """After each commit act gets the column's changes: row_id, op (put or delete), value. Earlier ones aren't told."""
        self._free(name)
        if column not in self.manifest.kinds:
            raise ValueError(f"no column {column}")
        self.triggers[name] = (column, act)

    def drop_trigger(self, name: str) -> None:
        if name not in self.triggers:
            raise ValueError(f"no trigger {name}")
        del self.triggers[name]

    # transactions

    @contextmanager
    def txn(self):
        """Commits at the end of the block; an error rolls everything back."""
        own = Txn(self)
        yield own
        own._commit()

    def query(self, act: Callable[[Txn], object]) -> object:
        with self.txn() as own:
            return act(own)

    def insert(self, **values) -> int:
        with self.txn() as t:
            return t.insert(**values)

    def insert_many(self, rows: DataFrame) -> None:
        with self.txn() as t:
            t.insert_many(rows)

    def delete_at(self, row_id: int) -> bool:
        with self.txn() as t:
            return t.delete_at(row_id)

    def query_at(self, row_id: int, act: Callable[[Row], object]) -> object:
        with self.txn() as t:
            return t.query_at(row_id, act)

    def insert_key(self, key: str, **values) -> int:
        with self.txn() as t:
            return t.insert_key(key, **values)

    def upsert_key(self, key: str, **values) -> int:
        with self.txn() as t:
            return t.upsert_key(key, **values)

    def query_key(self, key: str, act: Callable[[Row], object]) -> object:
        with self.txn() as t:
            return t.query_key(key, act)

    def delete_key(self, key: str) -> None:
        with self.txn() as t:
            t.delete_key(key)

    # expiry

    def vacuum(self, now_ns: int | None = None) -> int:
        """Delete the rows whose time has come; how many. now_ns fixes the clock."""
        now = time.time_ns() if now_ns is None else now_ns
        with self.txn() as t:
            gone = t.select().where((F.col(EXPIRE) != 0) & (F.col(EXPIRE) < F.lit(now)))
            n = gone.count()
            if n:
                gone.delete_all()
        return n

    # versions

    def snapshot(self, path: str | None = None) -> str:
        """Write the current version as one base: this collection's new one, or a collection of its own under path."""
        rows = self.frame()
        if path is None:
            base = f"{self.store.root}/base-{uuid.uuid4().hex}"
            self._blooms(rows.write).parquet(base)
            self._redefine(base=base, base_commit=self.manifest.version)
            return base
        other = Store(self.spark, path)
        base = f"{other.root}/base-{uuid.uuid4().hex}"
        self._blooms(rows.write).parquet(base)
        other.publish(replace(self.manifest, version=max([0, *other.versions()]) + 1, base=base, base_commit=self.manifest.version, changes=[]))
        return base

    def restore(self, path: str, changes: DataFrame | None = None) -> None:
        """Take the rows of a snapshot, and of changes those after it. Columns must be there as they were."""
        other = Store(self.spark, path).load()
        if {c: k["type"] for c, k in other.kinds.items()} != {c: k["type"] for c, k in self.manifest.kinds.items()}:
            raise ValueError("the snapshot has other columns")
        base = f"{self.store.root}/base-{uuid.uuid4().hex}"  # of its own: the snapshot may be deleted
        self._blooms(self.spark.read.parquet(other.base).write).parquet(base)
        self._redefine(base=base, base_commit=self.manifest.version + 1, changes=[], next_row=max(other.next_row, self.manifest.next_row), applied={**self.manifest.applied, "snapshot": other.base_commit})
        if changes is not None:
            self.replay(changes, "snapshot")

    def _blooms(self, writer, prefix: str = ""):
        """Files with a Bloom filter of the key, so that a look-up by key leaves out what can't hold it."""
        return writer if self.key is None else writer.option(f"parquet.bloom.filter.enabled#{prefix}{self.key}", "true")

    def changes(self, since: int = 0, until: int | None = None) -> DataFrame:
        """The change log: commit_id, row_id, chunk, op, written, row; from commits after `since`, up to `until`."""
        found = self.kinds
        schema = change_schema({c: k.type for c, k in found.items()})
        paths = [c["path"] for c in self.manifest.changes if c["version"] > since and (until is None or c["version"] <= until)]
        df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df.withColumn("chunk", F.shiftright(ROW, 14).cast("int"))

    def replay(self, changes: DataFrame, source: str) -> int:
        """Apply another collection's changes (as changes() gives them), each commit once; the newest commit applied."""
        done = self.manifest.applied.get(source, 0)
        fresh = changes.where(F.col("commit_id") > done)
        newest = fresh.agg(F.max("commit_id")).first()[0]
        if newest is None:
            return done
        columns = [c for c in self.manifest.kinds if c in changes.schema["row"].dataType.names]
        fold = folded(fresh, columns)
        last = lambda c: F.col("last").getField(c)
        row = F.struct(*((last(c).getField("v") if c in columns else F.lit(None)).cast(k.type).alias(c) for c, k in self.kinds.items()))
        wrote = F.filter(F.array(*(F.when(last(c).isNotNull(), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
        op = F.when(F.col("gone"), "delete").when(F.col("new"), "insert").otherwise("put")
        rows = fold.select(ROW, op.alias("op"), wrote.alias("written"), row.alias("row"))
        top = fresh.agg(F.max(ROW)).first()[0]
        self._publish(rows, max(self.manifest.next_row, top + 1), {**self.manifest.applied, source: newest})
        return newest

    def _publish(self, rows: DataFrame, next_row: int, applied: dict | None = None, adds: bool = False) -> None:
        version = self.manifest.version + 1
        if version in self.store.versions():
            raise Conflict(f"version {version} is there already")
        path = f"{self.store.root}/changes/{version}-{uuid.uuid4().hex}"
        self._blooms(rows.withColumn(CHANGE, F.lit(version).cast("long")).write, "row.").parquet(path)
        entry = {"version": version, "path": path, "bytes": self.store.size(path), "adds": adds}
        changed = replace(self.manifest, version=version, changes=[*self.manifest.changes, entry], next_row=next_row, applied=self.manifest.applied if applied is None else applied)
        try:
            self.store.publish(changed)
        except Conflict:
            self.store.delete(path)
            raise
        self.manifest = changed
        for append in self._sinks:
            append(self.changes(version - 1))
        for column, act in self.triggers.values():
            own = self.changes(version - 1).where(F.array_contains("written", column) | (F.col("op") == "delete"))
            act(own.select(ROW, F.when(F.col("op") == "delete", "delete").otherwise("put").alias("op"), F.col("row").getField(column).alias("value")))
        if sum(1 for c in changed.changes if c["version"] > changed.base_commit) >= self.compact:
            self.snapshot()

    def close(self) -> None:
        for own in self._closing:
            own.stop()
        self._closing = []


class Bound(Selection):
    """A selection of a transaction: it can also write. Writes show after the commit."""

    def __init__(self, table: Table, sel: Column | None = None, txn: Txn | None = None):
        super().__init__(table, sel)
        object.__setattr__(self, "txn", txn)

    def _with(self, sel: Column) -> Bound:
        return Bound(self.table, sel, self.txn)

    def set(self, **values) -> Bound:
        for c, v in values.items():
            self.txn._write(holds(self.condition), c, lambda old, kind, v=v: kind.stored(v if isinstance(v, Column) else _literal(v, kind)))
        return self

    def merge(self, **deltas) -> Bound:
        for c, d in deltas.items():
            if self.txn._kind(c).merge is not None:
                self.txn._has_rule(c)
                self.txn._write(holds(self.condition), c, lambda old, kind, d=d: kind.merged(old, d if isinstance(d, Column) else _literal(d, kind)))
        return self

    def extend(self, ns: int) -> Bound:
        """More time for rows that have a time to live; the others never expire."""
        now = F.col(EXPIRE)
        self.txn._write(holds(self.condition) & holds(now != 0), EXPIRE, lambda old, kind: old + F.lit(ns))
        return self

    def set_ttl(self, ns: int, now_ns: int | None = None) -> Bound:
        at = 0 if ns == 0 else (time.time_ns() if now_ns is None else now_ns) + ns
        return self.set(**{EXPIRE: at})

    def delete_all(self) -> None:
        self.txn._delete(holds(self.condition))


def _literal(value, kind: Kind) -> Column:
    if value is None:
        return F.lit(None).cast(kind.given)
    if isinstance(kind.given, T.StructType) and isinstance(value, dict):
        unknown = set(value) - set(kind.given.names)
        if unknown:
            raise ValueError(f"no such fields: {sorted(unknown)}")
        return F.struct(*(F.lit(value.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.given.fields)).cast(kind.given)
    if isinstance(value, bytes):
        value = bytearray(value)
    return F.lit(value)


class Txn:
    """Writes of one transaction. Reads are of the version that it began with."""

    def __init__(self, collection: Collection):
        self.collection, self.table = collection, collection.table()
        self.manifest = collection.manifest
        self._new: dict[str, Column] = {}
        self._touched: dict[str, Column] = {}
        self._gone: Column | None = None
        self._rows: list[dict] = []
        self._frames: list[DataFrame] = []
        self._dropped: set[int] = set()
        self._staged: list[str] = []

    def select(self) -> Bound:
        return Bound(self.table, None, self)

    def count(self) -> int:
        return self.select().count()

    def _kind(self, column: str) -> Kind:
        found = self.collection.kinds.get(column)
        if found is None:
            raise ValueError(f"no column {column}")
        return found

    def _has_rule(self, column: str) -> None:
        own = self.collection
        if own.manifest.kinds[column].get("own_merge") and column not in own.merges:
            raise ValueError(f"the merge rule of {column} isn't stored: set it in `merges` after opening")

    def _write(self, on: Column, column: str, value: Callable[[Column, Kind], Column]) -> None:
        kind = self._kind(column)
        old = self._new.get(column, F.col(column))
        self._new[column] = F.when(on, value(old, kind)).otherwise(old)
        self._touched[column] = on if column not in self._touched else self._touched[column] | on

    def _delete(self, on: Column) -> None:
        self._gone = on if self._gone is None else self._gone | on

    # rows that are added

    def insert(self, **values) -> int:
        """A new row; its id."""
        if self.collection.key is not None and self.collection.key not in values:
            raise ValueError("a collection with a key takes insert_key")
        if self.collection.key is not None:
            raise ValueError("a collection with a key takes insert_key")
        return self._add(values)

    def _add(self, values: dict) -> int:
        for c in values:
            self._kind(c)
        row_id = self.manifest.next_row + len(self._rows)
        self._rows.append(dict(values))
        return row_id

    def insert_many(self, rows: DataFrame) -> None:
        """New rows of a DataFrame, with the collection's columns or some of them."""
        unknown = set(rows.columns) - set(self.collection.kinds)
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)}")
        if self.collection.key is not None and self.collection.key not in rows.columns:
            raise ValueError("rows without the key")
        self._frames.append(rows)

    def insert_key(self, key: str, **values) -> int:
        if self._at_key(key) is not None or any(r.get(self._key()) == key for r in self._rows):
            raise KeyError(f"{key} is there already")
        return self._add({self._key(): key, **values})

    def upsert_key(self, key: str, **values) -> int:
        found = self._at_key(key)
        if found is None:
            for i, r in enumerate(self._rows):
                if r.get(self._key()) == key:
                    r.update(values)
                    return self.manifest.next_row + i
            return self._add({self._key(): key, **values})
        self.select().at(found).set(**values)
        return found

    def upsert_many(self, rows: DataFrame) -> None:
        """Rows of a DataFrame with the key and some columns, one for each key: a join, not a loop."""
        key, name = self._key(), "_upsert"
        if self._new or self._gone is not None or name in self.table.df.columns:
            raise ValueError("upsert_many comes before other writes of a transaction")
        if not keys.taken(rows.limit(0), rows, key).isEmpty():
            raise KeyError("a key twice, or null")
        new = [c for c in rows.columns if c != key]
        hits = rows.select(F.col(key).alias("_k"), F.struct(*new).alias(name))
        self.table = replace(self.table, df=self.table.df.join(hits, F.col(key) == F.col("_k"), "left").drop("_k"))
        for c in new:
            self._write(F.col(name).isNotNull(), c, lambda old, kind, c=c: kind.stored(F.col(name).getField(c)))
        self._frames.append(rows.join(self.collection.frame().select(key), key, "left_anti"))

    def _key(self) -> str:
        if self.collection.key is None:
            raise ValueError("the collection has no key")
        return self.collection.key

    def _at_key(self, key: str) -> int | None:
        found = self.select().where(F.col(self._key()) == F.lit(key)).rows().select(ROW).first()
        return None if found is None or found[0] in self._dropped else found[0]

    def query_key(self, key: str, act: Callable[[Row], object]) -> object:
        found = self._at_key(key)
        if found is None:
            raise KeyError(key)
        return act(Row(self, found))

    def delete_key(self, key: str) -> None:
        found = self._at_key(key)
        if found is None:
            raise KeyError(key)
        self._drop(found)

    def query_at(self, row_id: int, act: Callable[[Row], object]) -> object:
        return act(Row(self, row_id))

    def delete_at(self, row_id: int) -> bool:
        """Whether there was such a row."""
        if row_id in self._dropped or self.select().at(row_id).rows().isEmpty():
            return False
        self._drop(row_id)
        return True

    def _drop(self, row_id: int) -> None:
        self._dropped.add(row_id)
        self._delete(F.col(ROW) == F.lit(row_id))

    # the end

    def _changes(self) -> DataFrame | None:
        c = self.collection
        found = c.kinds
        if not self._new and self._gone is None:
            return None
        gone = F.lit(False) if self._gone is None else holds(self._gone)
        wrote = {n: holds(t) for n, t in self._touched.items()}
        changed = gone
        for t in wrote.values():
            changed = changed | t
        row = F.struct(*((F.when(wrote[n] & ~gone, self._new[n]) if n in wrote else F.lit(None)).cast(k.type).alias(n) for n, k in found.items()))
        names = F.filter(F.array(*(F.when(t & ~gone, F.lit(n)) for n, t in wrote.items())), lambda x: x.isNotNull()) if wrote else F.array().cast("array<string>")
        return self.table.df.where(changed).select(ROW, F.when(gone, "delete").otherwise("put").alias("op"), names.alias("written"), row.alias("row"))

    def _added(self) -> tuple[DataFrame | None, int]:
        c, spark = self.collection, self.collection.spark
        found, first = c.kinds, self.manifest.next_row + len(self._rows)
        out = None
        if self._rows:
            rows = None
            for group in {tuple(sorted(r)): None for r in self._rows}:
                own = [(self.manifest.next_row + i, r) for i, r in enumerate(self._rows) if tuple(sorted(r)) == group]
                schema = T.StructType([T.StructField(ROW, T.LongType()), *(T.StructField(n, found[n].given) for n in group)])
                df = spark.createDataFrame([(i, *(_plain(r[n], found[n]) for n in group)) for i, r in own], schema)
                df = self._as_inserts(df, list(group))
                rows = df if rows is None else rows.unionByName(df)
            out = rows
        for frame in self._frames:
            numbered = frame.withColumn("_n", F.monotonically_increasing_id())
            staged = f"{c.store.root}/_staged-{uuid.uuid4().hex}"
            self._staged.append(staged)
            numbered.write.parquet(staged)  # once, so that the numbers stay
            numbered = spark.read.schema(numbered.schema).parquet(staged)
            part = F.shiftright("_n", 33)
            sizes = {r[0]: r[1] for r in numbered.groupBy(part).count().collect()}  # a row for each partition
            starts, at = {}, first
            for p in sorted(sizes):
                starts[p], at = at, at + sizes[p]
            offset = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[part] if starts else F.lit(0)
            first = at
            df = self._as_inserts(numbered.withColumn(ROW, (offset + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_n"), frame.columns)
            out = df if out is None else out.unionByName(df)
        return out, first

    def _as_inserts(self, df: DataFrame, given: list[str]) -> DataFrame:
        found = self.collection.kinds
        row = F.struct(*((found[n].stored(F.col(n)) if n in given else found[n].stored(F.lit(None))).alias(n) for n in found))
        return df.select(ROW, F.lit("insert").alias("op"), F.array(*(F.lit(n) for n in found)).alias("written"), row.alias("row"))

    def _commit(self) -> None:
        c = self.collection
        if c.manifest is not self.manifest and c.manifest.version != self.manifest.version:
            raise Conflict("the collection has a newer version")
        try:
            self._write_all()
        finally:
            for path in self._staged:
                c.store.delete(path)

    def _write_all(self) -> None:
        c = self.collection
        rows = self._changes()
        added, next_row = self._added()
        if added is not None:
            if c.key is not None:
                self._check_keys(added)
            adds = rows is None
            rows = added if adds else rows.unionByName(added)
        else:
            adds = False
        if rows is not None:
            c._publish(rows, next_row, adds=adds)

    def _check_keys(self, added: DataFrame) -> None:
        key = self.collection.key
        held = self.table.df if self._gone is None else self.table.df.where(~holds(self._gone))
        if key in self._new:
            held = held.withColumn(key, self._new[key])
        if not keys.taken(held, added.select(F.col("row").getField(key).alias(key)), key).isEmpty():
            raise KeyError("a key twice, or null")


def _plain(value, kind: Kind):
    import decimal

    if isinstance(kind.type, T.DecimalType) and isinstance(value, int) and not isinstance(value, bool):
        return decimal.Decimal(value)
    if isinstance(kind.type, (T.FloatType, T.DoubleType)) and isinstance(value, int):
        return float(value)
    return value


class Row:
    """One row of a transaction. Reads are of the version that the transaction began with, writes go to its commit."""

    def __init__(self, txn: Txn, row_id: int):
        self._txn, self._id = txn, row_id
        self._at = txn.select().at(row_id)

    def index(self) -> int:
        return self._id

    def get(self, column: str):
        """The value, None where there is none."""
        found = self._at.select(self._txn._kind(column).loaded(F.col(column)).alias("value")).first()
        return None if found is None else found[0]

    def _must_be(self) -> None:
        if self._at.rows().isEmpty():
            raise KeyError(f"no row {self._id}")

    def set(self, column: str, value) -> Row:
        self._must_be()
        self._at.set(**{column: value})
        return self

    def set_many(self, values: dict) -> Row:
        for c in values:
            self._txn._kind(c)
        self._must_be()
        self._at.set(**values)
        return self

    def merge(self, column: str, delta) -> Row:
        self._must_be()
        self._at.merge(**{column: delta})
        return self

    def bool(self, name: str) -> bool:
        found = self._at.select(self._at.bool_(name).alias("b")).first()
        return bool(found and found[0])

    def key(self) -> str | None:
        return self.get(self._txn._key())

    def set_key(self, value: str) -> Row:
        if self._txn._at_key(value) not in (None, self._id):
            raise KeyError(f"{value} is there already")
        return self.set(self._txn._key(), value)

    def ttl(self, now_ns: int | None = None) -> int | None:
        """Nanoseconds left, None for never."""
        at = self.get(EXPIRE)
        return at - (time.time_ns() if now_ns is None else now_ns) if at else None

    def set_ttl(self, ns: int, now_ns: int | None = None) -> Row:
        self._at.set_ttl(ns, now_ns)
        return self

    any, set_any = get, set


def _typed(name: str):
    def read_(self, column: str):
        if self._txn._kind(column).name not in SAME.get(name, (name,)):
            raise TypeError(f"{column} isn't of kind {name}")
        return self.get(column)

    def write(self, column: str, value):
        if self._txn._kind(column).name not in SAME.get(name, (name,)):
            raise TypeError(f"{column} isn't of kind {name}")
        return self.set(column, value)

    return read_, write, lambda self, column, delta: self.merge(column, delta)


for _name in ("int", "int16", "int32", "int64", "uint", "uint16", "uint32", "uint64", "float32", "float64", "string", "enum", "record"):
    for _prefix, _method in zip(("", "set_", "merge_"), _typed(_name), strict=True):
        setattr(Row, _prefix + _name, _method)
Row.set_bool = Row.set
