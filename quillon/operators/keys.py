"""Inserts, upserts and deletes by key, from one DataFrame to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taken(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys of rows that df has, or that rows has twice, or that are null."""
    twice = rows.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).select(key)
    return rows.select(key).join(df.select(key), key, "left_semi").unionByName(twice).distinct()


def upserted(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df, where rows (key and some of the columns; one row for a key) replace what they hold, and new keys are added."""
    new = [c for c in rows.columns if c != key]
    both = df.join(rows.select(F.col(key).alias("_key"), F.struct(*rows.columns).alias("_new")), F.col(key) == F.col("_key"), "full")
    there = F.col("_key").isNotNull()
    return both.select(*(F.coalesce(key, "_key").alias(key) if c == key else F.when(there, F.col("_new").getField(c)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def deleted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")
