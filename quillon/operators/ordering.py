"""Ordered iteration by a sorted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.selection import ROW


def ascending(df: DataFrame, column: str, distinct_keys: bool = False) -> DataFrame:
    """Rows with a key, by key and then by row. distinct_keys: of equal keys only the last written row, the one with the largest row id."""
    there = df.where(F.col(column).isNotNull())
    if distinct_keys:
        # pre-aggregated before the shuffle, unlike a window's rows; by column, so that numbers are aggregated in place
        fields = [c for c in df.columns if c not in (column, ROW)]
        last = there.groupBy(column).agg(F.max(ROW).alias(ROW), *(F.max_by(c, ROW).alias(c) for c in fields))
        there = last.select(*df.columns)
    return there.orderBy(F.col(column).asc(), F.col(ROW).asc())


def top(df: DataFrame, column: str, n: int, descending: bool = False) -> DataFrame:
    key = F.col(column).desc() if descending else F.col(column).asc()
    return df.where(F.col(column).isNotNull()).orderBy(key, F.col(ROW).asc()).limit(n)


def last_of_each(df: DataFrame, by: str, order: str) -> DataFrame:
    """One row for each value of `by`: the one with the largest `order`."""
    window = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")
