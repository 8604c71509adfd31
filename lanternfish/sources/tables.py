"""Parquet tables, with the work of small ones spread over all cores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """columns (default: all) of a Parquet table.

    A table in fewer splits than there are cores (one small file, say) is dealt by its first column, or all
    that follows would run in one task. A table with enough splits is read as it is, without a shuffle.
    """
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, df.columns[0]) if df.rdd.getNumPartitions() < cores else df


#: Rows of an Arrow batch of whole texts or pages: a batch is held whole on both sides of the worker's pipe.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows where it has more, so that a worker's memory doesn't grow with its split."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def local(spark: SparkSession, columns: list, schema: str) -> DataFrame:
    """A few rows of the driver as part of the plan: no job reads them, and their size is known when joins are planned.

    columns: the values of each column of schema.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds), schema)
