"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import inspect
import math
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space characters between words; bytes.split() cuts at just these.
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(col):
    """Lower-case A-Z only, inside the JVM."""
    return F.translate(col, UPPER, UPPER.lower())


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; where that is unset, one in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lanternfish-checkpoints"
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended first: the cluster's own cleaning of the folder applies
        pass


def _collect_soon(spark: SparkSession) -> None:
    """Collect the driver's garbage in a second: until its event queue is empty, Spark still holds the finished plan."""

    def collect():
        with contextlib.suppress(Exception):  # the session may have ended
            gc.collect()
            spark.sparkContext._jvm.System.gc()

    timer = threading.Timer(1.0, collect)
    timer.daemon = True
    timer.start()


#: Whether Spark deletes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the driver ends. The shuffle files of its plan go as soon as it is written, or soon after,
    once the driver's objects for them are collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lanternfish-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before or "false")
    atexit.register(_remove, spark, path)
    del df
    _collect_soon(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table made by materialize() that nothing will read any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(spark, f)


def partitions_for(spark: SparkSession, weight: float, per_partition: float) -> int:
    """As many partitions as the input's measured weight asks for, and no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / per_partition))


#: Rows of one key from which its rows are dealt over several tasks, whatever the table's size.
HUB_LEAST = 1000


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], n: str, by) -> DataFrame:
    """rows joined with facts, a written table with a row per key and in n the number of its rows, or more.

    Keys of more than HUB_LEAST rows and more than a thousandth of all, under a thousand whatever the data, are
    dealt over all tasks by the column by, and their facts repeated in each. n is left out.
    """
    spark = rows.sparkSession
    total = facts.agg(F.sum(n)).first()[0] or 0
    hubs = facts.filter(F.col(n) > max(HUB_LEAST, total // 1000)).select(*on).collect()  # under a thousand rows
    facts = facts.drop(n)
    if not hubs:
        return rows.join(facts.hint("merge"), on)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.broadcast(spark.createDataFrame(hubs, facts.select(*on).schema).withColumn("s_hub", F.lit(True)))
    dealt = rows.join(known, on, "left").withColumn("s_salt", F.when(F.col("s_hub"), F.pmod(by, F.lit(parts)).cast("int")).otherwise(F.lit(0)))
    salts = F.when(F.col("s_hub"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    wide = facts.join(known, on, "left").withColumn("s_salt", F.explode(salts)).drop("s_hub")
    return dealt.drop("s_hub").join(wide.hint("merge"), [*on, "s_salt"]).drop("s_salt")


def clash_free(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that carry the name of an output column (case ignored, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: Rows of an Arrow batch: texts are long, and a batch is held whole on both sides of the worker's pipe.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows where it has Spark's default or more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages and are many."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(task):
    """A function of Arrow batches (or of tables) that gives memory back at its end."""

    def over_batches(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    def over_table(table):
        try:
            return task(table)
        finally:
            give_back()

    def over_two(left, right):
        try:
            return task(left, right)
        finally:
            give_back()

    if inspect.isgeneratorfunction(task):
        return over_batches
    return over_table if len(inspect.signature(task).parameters) == 1 else over_two


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
