"""Global aggregates. By default nulls don't count and sums widen; strict aggregates take a null as zero and keep the column's own width."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import wrapped

_BITS = {"int": 64, "int64": 64, "int32": 32, "int16": 16, "uint": 64, "uint64": 64, "uint32": 32, "uint16": 16}


@dataclass(frozen=True)
class Aggregate:
    """op: count, sum, avg, min, max, any (whether there is a row at all)."""

    op: str
    column: str | None = None

    def of(self, kinds: dict, strict: bool) -> Column:
        if self.op == "count":
            return F.count(F.lit(1))
        if self.op == "any":
            return F.count(F.lit(1)) > 0
        kind = kinds[self.column]
        if not kind.numeric:
            raise TypeError(f"{self.column} isn't a number")
        c = F.col(self.column)
        if strict:
            c = F.coalesce(c, F.lit(0).cast(kind.type))
        if self.op == "sum":
            return self._sum(c, kind, strict)
        if self.op == "avg":
            return F.coalesce(F.avg(c.cast("double")), F.lit(float("nan"))) if strict else F.avg(c)
        return {"min": F.min, "max": F.max}[self.op](c)

    @staticmethod
    def _sum(c: Column, kind, strict: bool) -> Column:
        if isinstance(kind.type, (T.FloatType, T.DoubleType)):
            total = F.coalesce(F.sum(c), F.lit(0.0))
            return total.cast(kind.type) if strict else total
        if not strict:
            return F.coalesce(F.sum(c), F.lit(0))
        return wrapped(F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)), _BITS[kind.name], not kind.name.startswith("u")).cast(kind.type)


count = Aggregate("count")
any_row = Aggregate("any")


def sum_of(column: str) -> Aggregate:
    return Aggregate("sum", column)


def avg_of(column: str) -> Aggregate:
    return Aggregate("avg", column)


def min_of(column: str) -> Aggregate:
    return Aggregate("min", column)


def max_of(column: str) -> Aggregate:
    return Aggregate("max", column)


def exact_sum(column: str, scale: int = 2) -> Column:
    """The sum of a double that holds decimals, whatever the order of its rows."""
    return F.sum(F.col(column).cast(f"decimal(18,{scale})")).cast("double")
