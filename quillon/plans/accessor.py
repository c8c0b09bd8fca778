"""Typed access to one column of a selection: its values, aggregates and, in a transaction, writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import expires_at, remaining

#: Kinds that an accessor of another name also takes.
SAME = {"int": ("int", "int64"), "int64": ("int", "int64"), "uint": ("uint", "uint64"), "uint64": ("uint", "uint64"), "string": ("string", "enum", "key")}


class Accessor:
    def __init__(self, selection, column: str, kind: str | None = None):
        found = selection.table.kinds.get(column)
        if found is None:
            raise ValueError(f"no column {column}")
        if kind is not None and found.name not in SAME.get(kind, (kind,)):
            raise TypeError(f"{column} is of kind {found.name}, not {kind}")
        self.selection, self.name, self.kind = selection, column, found

    def get(self) -> Column:
        """The value, null where there is none."""
        return self.kind.loaded(F.col(self.name))

    def has(self) -> Column:
        return F.col(self.name).isNotNull()

    def rows(self) -> DataFrame:
        return self.selection.select("row_id", self.get().alias(self.name))

    def sum(self):
        return self.selection.sum(self.name)

    def avg(self):
        return self.selection.avg(self.name)

    def min(self):
        return self.selection.min(self.name)

    def max(self):
        return self.selection.max(self.name)

    def set(self, value) -> Accessor:
        self.selection.set(**{self.name: value})
        return self

    def merge(self, delta) -> Accessor:
        self.selection.merge(**{self.name: delta})
        return self


class Expiry(Accessor):
    """The time to live of a selection's rows."""

    def ttl(self, now_ns: int) -> Column:
        """Nanoseconds left, null for never."""
        return remaining(F.col(self.name), now_ns)

    def expires_at(self) -> Column:
        """The time of expiry, null for never."""
        return expires_at(F.col(self.name))

    def set_ttl(self, ns: int, now_ns: int | None = None) -> Expiry:
        self.selection.set_ttl(ns, now_ns)
        return self

    def extend(self, ns: int) -> Expiry:
        self.selection.extend(ns)
        return self
