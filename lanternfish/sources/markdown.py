"""A folder of markdown files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.schema import DEFAULT_TYPE


def read(spark: SparkSession, folder: str) -> DataFrame:
    """source (file name), content, type of each *.md directly in folder. File names give corpus order."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("content"), F.lit(DEFAULT_TYPE).alias("type"))
