"""JSON documents in and out, with the two ways to treat damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lanternfish.schema import DOC


def read(spark: SparkSession, path: str, schema: T.StructType = DOC, recoverable: bool = False) -> DataFrame:
    """Rows of JSON files. Damage fails the query, or (recoverable) its rows are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if recoverable else "FAILFAST")


def write(df: DataFrame, path: str) -> None:
    """Spark's committer publishes all files at once."""
    df.write.mode("overwrite").json(path)
