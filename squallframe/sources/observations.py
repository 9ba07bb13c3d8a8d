"""Observations, gauges and dimensions derived from the ``events`` table.

The tables hold no weather, so a fixed rule turns each event into a lightning strike, a radar cell or a gauge reading:
30 days are squeezed into half a day, and four storms drift to the north-east.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000
#: Regions (id, centre, radius in km) and targets (id, place): small fixed dimensions.
REGIONS = [("r0", 50.1, 4.8, 150.0), ("r1", 51.0, 5.5, 150.0), ("r2", 51.9, 6.2, 150.0), ("r3", 52.8, 6.9, 150.0)]
TARGETS = [("home", 50.1, 4.5), ("t1", 50.9, 5.0), ("t2", 51.8, 6.6), ("t3", 52.9, 7.4), ("t4", 40.0, 2.0)]

#: The same rule for the oracle: a common table expression ``obs``, with the dimensions ``regions`` and ``targets``.
OBS_SQL = f"""
WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
sim AS (SELECT *, CAST((us - {EPOCH_US}) // 60000000 AS BIGINT) AS sim_s, CAST(user_id % 4 AS BIGINT) AS blob FROM ev),
obs AS (SELECT event_id, user_id AS station_id, blob, sim_s, CAST((sim_s // 300) * 300 AS BIGINT) AS frame_s,
  CASE WHEN event_type IN ('view', 'click') THEN 'lightning' WHEN event_type IN ('purchase', 'signup') THEN 'radar' ELSE 'rain' END AS kind,
  CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'comp' WHEN 1 THEN 'nat' ELSE 'tile' END AS source,
  (50000 + blob * 900 + sim_s // 240 + (event_id * 7919) % 101 - 50) / 1000.0e0 AS lat,
  (3000 + blob * 700 + (sim_s // 60) * 5 + (event_id * 104729) % 151 - 75) / 1000.0e0 AS lon,
  CAST(CASE WHEN value >= 60 THEN 8 WHEN value >= 1 THEN 1 + CAST(floor(value) AS BIGINT) % 7 ELSE 0 END AS BIGINT) AS intensity,
  least(value, 60.0e0) AS dbz, k / 100.0e0 AS quality, value / 10.0e0 AS rain_mm, 1000 + (k - 50) / 10.0e0 AS pressure FROM sim),
regions(region_id, c_lat, c_lon, radius_km) AS (VALUES {", ".join(f"('{r}', {a}e0, {b}e0, {k}e0)" for r, a, b, k in REGIONS)}),
targets(target_id, t_lat, t_lon) AS (VALUES {", ".join(f"('{t}', {a}e0, {b}e0)" for t, a, b in TARGETS)})
"""


#: Event types of each kind of observation; all others are rain.
EVENT_TYPES = {"lightning": ["view", "click"], "radar": ["purchase", "signup"]}


def observations(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """event_id, station_id, blob, sim_s, frame_s, kind, source, lat, lon, intensity, dbz, quality, rain_mm, pressure.

    With a kind, only events of its types are read, by a filter that reaches the scan.
    """
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), kind)


def from_events(events: DataFrame, kind: str | None = None) -> DataFrame:
    """Observations of a table or stream of events."""
    if kind:
        others = [t for types in EVENT_TYPES.values() for t in types]
        of_kind = F.col("event_type").isin(EVENT_TYPES[kind]) if kind in EVENT_TYPES else F.col("event_type").isNull() | ~F.col("event_type").isin(others)
        events = events.where(of_kind)
    rows = events.select(
        "event_id", F.col("user_id").alias("station_id"), (F.col("user_id") % 4).alias("blob"), "event_type", "value",
        F.expr(f"(unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_US}) DIV 60000000").alias("sim_s"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    value = F.col("value")
    return rows.select(
        "event_id", "station_id", "blob", "sim_s", F.expr("(sim_s DIV 300) * 300").alias("frame_s"),
        F.when(F.col("event_type").isin(EVENT_TYPES["lightning"]), "lightning").when(F.col("event_type").isin(EVENT_TYPES["radar"]), "radar").otherwise("rain").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, "comp").when(F.col("event_id") % 3 == 1, "nat").otherwise("tile").alias("source"),
        F.expr("(50000 + blob * 900 + sim_s DIV 240 + (event_id * 7919) % 101 - 50) / 1000.0D").alias("lat"),
        F.expr("(3000 + blob * 700 + (sim_s DIV 60) * 5 + (event_id * 104729) % 151 - 75) / 1000.0D").alias("lon"),
        F.when(value >= 60, 8).when(value >= 1, 1 + F.floor(value) % 7).otherwise(0).cast("long").alias("intensity"),
        F.least(value, F.lit(60.0)).alias("dbz"), (F.col("k") / 100.0).alias("quality"), (value / 10.0).alias("rain_mm"), (1000 + (F.col("k") - 50) / 10.0).alias("pressure"),
    )


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region_id string, c_lat double, c_lon double, radius_km double")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, "target_id string, t_lat double, t_lon double")
