"""Conversions that filters and aggregates share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a filter or an index may be given: a Column, SQL text, or a function of a Column.
Rule = Column | str | Callable[[Column], Column]


def python(fn: Callable[[object], bool]) -> Callable[[Column], Column]:
    """A rule by a Python function of one value, run on Arrow batches. It hides the rule from the optimizer: the last resort."""

    @F.pandas_udf("boolean")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: bool(fn(v)), na_action="ignore").fillna(False).astype(bool)

    return apply


def rule(given: Rule, on: Column) -> Column:
    if isinstance(given, Column):
        return given
    found = F.expr(given) if isinstance(given, str) else given(on)
    if not isinstance(found, Column):
        raise TypeError("a rule gives a Column; wrap a plain Python predicate in python()")
    return found


def holds(p: Column) -> Column:
    """p, where null is false."""
    return F.coalesce(p, F.lit(False))


def as_float(c: Column) -> Column:
    return c.cast("double")


def as_int(c: Column) -> Column:
    """Cut towards zero; null where it doesn't fit."""
    return c.try_cast("bigint")


def as_uint(c: Column, type: T.DataType, wrap: bool = False) -> Column:
    """Cut towards zero; negative numbers are null, or wrap around if they were whole ones."""
    wide = T.DecimalType(20, 0)
    if isinstance(type, (T.FloatType, T.DoubleType)):
        whole = F.when(c >= 0, F.floor(c.cast("double"))).try_cast(wide)
        return F.when(whole >= 0, whole)
    whole = c.try_cast(wide)
    if wrap:
        return F.when(whole < 0, (whole.cast("decimal(38,0)") + F.lit(Decimal(2**64)).cast("decimal(38,0)")).cast(wide)).otherwise(whole)
    return F.when(whole >= 0, whole)


def wrapped(total: Column, bits: int, signed: bool = True) -> Column:
    """A whole number as it is left in so many bits."""
    span, half = F.lit(Decimal(2**bits)).cast("decimal(38,0)"), F.lit(Decimal(2 ** (bits - 1) if signed else 0)).cast("decimal(38,0)")
    return F.pmod(total.cast("decimal(38,0)") + half, span) - half


def expires_at(expire: Column) -> Column:
    """The time of an expiry in nanoseconds; null for never."""
    return F.when(expire != 0, F.timestamp_micros(F.floor(expire / 1000).cast("bigint")))


def remaining(expire: Column, now_ns: int) -> Column:
    """Nanoseconds that are left; null for never."""
    return F.when(expire != 0, expire - F.lit(now_ns))


def alive(expire: Column, now_ns: int) -> Column:
    return holds(expire.isNull() | (expire == 0) | (expire >= F.lit(now_ns)))
