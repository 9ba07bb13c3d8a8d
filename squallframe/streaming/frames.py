"""Radar frames of several sources matched with each other as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallframe.operators.observing import ORACLES, PAIRS_SQL, QUERIES, grid_cells
from squallframe.sources.observations import OBS_SQL
from squallframe.streaming.windows import drain, shared_path

#: How long a frame waits for those of the same minute (a fixed value).
KEPT_S = 180 * 60


def matched_frames(stream: DataFrame, late_s: int = KEPT_S) -> DataFrame:
    """Each unordered pair of sources with a frame at the same time in a region, once: region, at, a, b (a before b), na, nb, overlap.

    stream: region, source, ``at`` (a timestamp) and cells, the different occupied cells of the frame. Both sides of the join have the watermark: a frame waits
    for others until the newest time is ``late_s`` beyond it, then it leaves the state; frames that come later are
    dropped from the second batch after that on. Of a frame that comes again in that time the first one counts. Rows with nulls in region, source or time match nothing.
    """
    frames = stream.dropna(subset=["region", "source", "at"]).withWatermark("at", f"{late_s} seconds").dropDuplicatesWithinWatermark(["region", "source", "at"])
    a = frames.select("region", "at", F.col("source").alias("a"), F.col("cells").alias("ca"))
    b = frames.select(F.col("region").alias("region_b"), F.col("at").alias("at_b"), F.col("source").alias("b"), F.col("cells").alias("cb"))
    pairs = a.join(b, (F.col("region") == F.col("region_b")) & (F.col("at") == F.col("at_b")) & (F.col("a") < F.col("b")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return pairs.select("region", "at", "a", "b", size("ca").alias("na"), size("cb").alias("nb"), size(F.array_intersect("ca", "cb")).alias("overlap"))


def frame_records(spark, sf_dir) -> DataFrame:
    """The occupied cells of each source's frame; a source's frame of a region has as many as its raster at most."""
    cells = grid_cells(spark, sf_dir).groupBy("source", "frame_s").agg(F.collect_list(F.struct("y", "x")).alias("cells"))
    return cells.select(F.lit("all").alias("region"), "source", F.timestamp_seconds(F.col("frame_s") + 86_400).alias("at"), "cells")


def stream_pairs(spark, sf_dir):
    """Frames written as records, every fourth one twice, and matched as a stream."""
    path, records = shared_path(spark, "records"), frame_records(spark, sf_dir)
    records.unionByName(records.where(F.unix_seconds("at") % 1200 == 0)).write.parquet(path)
    pairs = drain(matched_frames(spark.readStream.schema(records.schema).parquet(path)), "pairs")
    return pairs.select((F.unix_seconds("at") - 86_400).alias("frame_s"), "a", "b", "na", "nb", "overlap")


QUERIES["ST11_matched_frames"] = stream_pairs
ORACLES["ST11_matched_frames"] = f"{OBS_SQL}{PAIRS_SQL} SELECT frame_s, a, b, CAST(na AS INT) AS na, CAST(nb AS INT) AS nb, CAST(overlap AS INT) AS overlap FROM pairs"
