"""Windowed counts of an observation stream, with a watermark for late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.operators.observing import ORACLES, QUERIES

WIDTH_S, LATE_S = 21_600, 3_600


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the cluster's shared folder. Where the session names none, a local master uses its warehouse; others are refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/stream/{label}-{uuid.uuid4().hex}"


def closed_windows(stream: DataFrame, at: str, keys: list[str], width_s: int, late_s: int, *, id_col: str | None = None) -> DataFrame:
    """Rows of each key and tumbling window (start_s, n), given out once the watermark has passed the window's end.

    Rows later than ``late_s`` are dropped, so state is bounded by the windows still open; with ``id_col``, rows that
    come again within that time count once. Null times are never in a window.
    """
    rows = stream.withWatermark(at, f"{late_s} seconds")
    rows = rows.dropDuplicatesWithinWatermark([id_col]) if id_col else rows
    counted = rows.groupBy(F.window(at, f"{width_s} seconds").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_seconds("w.start").alias("start_s"), *keys, "n")


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that its source has now, exactly once, and read what it has written."""
    spark = stream.sparkSession
    out, state = shared_path(spark, label), shared_path(spark, f"{label}-state")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern may also name a single file
    rows = events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    return drain(closed_windows(rows, "at", ["event_type"], WIDTH_S, LATE_S, id_col="event_id"), "windows")


QUERIES["ST_closed_windows"] = stream_windows
ORACLES["ST_closed_windows"] = f"""
SELECT CAST(epoch_us(ts) // {WIDTH_S * 1_000_000} * {WIDTH_S} AS BIGINT) AS start_s, event_type, count(DISTINCT event_id) AS n FROM events
GROUP BY 1, 2 HAVING (start_s + {WIDTH_S}) * 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - {LATE_S * 1000}
"""
