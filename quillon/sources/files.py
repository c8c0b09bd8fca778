"""Row sources for bulk loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def from_rows(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def from_json(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = True) -> DataFrame:
    """Objects of a JSON file: an array of them, or one on each line. The schema is given, so nothing is read twice."""
    return spark.read.schema(schema).json(path, multiLine=multiline)


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
