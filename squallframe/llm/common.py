"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Upper-case ASCII letters and their lower-case forms (fixed values of the tokenisation rules).
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word of the white-space tokenisation.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a local master uses its warehouse; others are refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Cut the lineage in the shared folder, so that lost executors don't start the work again.

    With ``drop_shuffles`` the shuffle files behind it are deleted as soon as the checkpoint stands, as nothing reads them again.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    if not drop_shuffles:
        return df.checkpoint()
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint()  # a plan of its own, made under the setting


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Exchange batches of at most so many rows with Python in the actions inside, which bounds what tasks hold of wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidied(batches: Iterator) -> Iterator:
    """The batches; when they end, memory that is free goes back to the system, as Python workers wait for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, but for those of map type."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType)))


def hash_unit(seed: int, *columns: Column) -> Column:
    """A reproducible number in (0, 1) from the columns; any engine with MD5 gets the same one."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def running_position(df: DataFrame, groups: list[str], unit: str, order: list[str], value: str | None = None) -> DataFrame:
    """Rank (and running sum) of each row in its group, without one task for a whole group.

    ``unit`` is a column in [0, 1] that never falls along ``order``. Groups are cut into ranges of it, about as many as
    a range of a group of all rows would have rows, so that neither the ranges of a hot group nor the table of ranges
    gets large. Rows are only ever dealt by group and range. ``df`` should be materialized: its rows are counted first.
    Adds __n (rows of the group), __rank (from 1), and for a value __cum (sum up to and with the row).
    """
    rows = df.count()
    ranges = max(1, math.ceil(rows / max(1000.0, math.sqrt(rows))))
    keys = [*groups, "__range"]
    placed = df.withColumn("__range", F.least(F.floor(F.col(unit) * ranges), F.lit(ranges - 1)))
    group = Window.partitionBy(*groups)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"), *([F.sum(value).alias("__s")] if value else []))
    starts = sums.select(*keys, F.sum("__c").over(group).alias("__n"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c0"), *([F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0")] if value else []))
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = placed.join(starts, keys).withColumn("__rank", F.col("__c0") + F.row_number().over(inside))
    if value:
        so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("__cum", F.col("__s0") + F.sum(value).over(so_far)).drop("__s0")
    return out.drop("__c0", "__range")
