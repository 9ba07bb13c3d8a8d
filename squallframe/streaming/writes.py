"""Frames written by batches of a stream, each batch as a whole and once, a frame's rows replaced by those of the newest batch that has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.operators.observing import ORACLES, QUERIES
from squallframe.sources.observations import OBS_SQL
from squallframe.streaming.state import event_stream
from squallframe.streaming.windows import shared_path

BATCH = "batch"


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch's rows as the partition of its number. A batch that is played again, after a failure, takes the place of its own
    partition only, whatever it had written before, so it changes nothing."""

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)

    return write


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of each frame (keys) that its newest batch wrote; those of earlier batches are replaced as a whole, nulls in keys are a key.

    The newest batch of each frame is found from keys and partition numbers alone; one row a frame is joined back, so points aren't sorted.
    """
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*keys).agg(F.max(BATCH).alias("__newest"))
    same = rows[BATCH] == newest["__newest"]
    for k in keys:
        same = same & rows[k].eqNullSafe(newest[k])
    return rows.join(newest, same, "left_semi")


def compact(spark: SparkSession, path: str, keys: list[str], to: str) -> None:
    """The current rows as a table of their own, as their last batches; more batches can follow there."""
    current(spark, path, keys).write.partitionBy(BATCH).parquet(to)


def frames_by_batch(spark, sf_dir):
    """Radar points of the events as a first batch, and then frames that come again, corrected, with their stronger points only: what is read of each frame."""
    path, state = shared_path(spark, "frames"), shared_path(spark, "frames-state")
    write = by_batch(path)
    radar = event_stream(spark, sf_dir, "radar").select("source", "frame_s", "event_id", "dbz")

    def both(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        write(rows, 2 * number)
        write(rows.where("frame_s % 900 = 0 AND dbz >= 20"), 2 * number + 1)
        rows.unpersist()

    radar.writeStream.foreachBatch(both).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    out = current(spark, path, ["source", "frame_s"])
    return out.groupBy("source", "frame_s").agg(F.count(F.lit(1)).alias("points"), F.min("dbz").alias("weakest"), F.max("dbz").alias("strongest"), F.max(BATCH).alias("batch"))


QUERIES["K3_M1_frames_by_batch"] = frames_by_batch
ORACLES["K3_M1_frames_by_batch"] = OBS_SQL + """
, again AS (SELECT source, frame_s FROM obs WHERE kind = 'radar' AND frame_s % 900 = 0 AND dbz >= 20 GROUP BY 1, 2)
SELECT source, frame_s, count(*) AS points, min(dbz) AS weakest, max(dbz) AS strongest, CAST(CASE WHEN (source, frame_s) IN (SELECT (source, frame_s) FROM again) THEN 1 ELSE 0 END AS INT) AS batch
FROM obs WHERE kind = 'radar' AND (dbz >= 20 OR (source, frame_s) NOT IN (SELECT (source, frame_s) FROM again)) GROUP BY 1, 2
"""
