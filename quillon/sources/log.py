"""A change log as files of its own, apart from the collection: appended to, read back, copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Log:
    """Changes as Collection.changes() gives them, by commit. Its append fits Collection.on_commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.name = spark, path.rstrip("/")

    def append(self, changes: DataFrame) -> None:
        """A commit that is there already is written again, not twice."""
        changes.write.mode("overwrite").partitionBy("commit_id").option("partitionOverwriteMode", "dynamic").parquet(self.name)

    def range(self, schema: T.StructType | None = None, since: int = 0) -> DataFrame:
        """The changes after a commit. Whole folders of earlier commits are left out."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        df = reader.parquet(self.name)
        return df.withColumn("commit_id", df["commit_id"].cast("long")).where(df["commit_id"] > since)

    def copy(self, path: str) -> Log:
        own = Log(self.spark, path)
        own.append(self.range())
        return own
