"""Forecasts of weather models for targets: JSON documents with ragged arrays, their summaries, and those of whole fleets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.operators.observing import query
from squallframe.sources.observations import observations

#: Variables that are asked for, in natural order, and how many steps of them count (fixed values).
MINUTELY = ["precipitation", "rain", "showers", "cape", "lightning_potential", "wind_gusts_10m", "weather_code", "freezing_level_height"]
HOURLY = [
    "precipitation_probability", "pressure_msl", "lifted_index", "convective_inhibition", "wind_speed_850hPa", "wind_direction_850hPa", "wind_speed_700hPa", "wind_direction_700hPa",
    "relative_humidity_700hPa", "cloud_cover",
]
STEPS, NEAR_STEPS, STEP_MIN, HOURS = 13, 7, 15, 6


def number(text: Column) -> Column:
    """The finite number of a text, else null: unknown, which isn't dry."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def series(text: Column, steps: int) -> Column:
    """The first steps of a JSON array, of numbers, numbers as texts and nulls; what isn't an array is empty."""
    values = F.from_json(text, "array<string>")
    return F.coalesce(F.transform(F.slice(values, 1, steps), number), F.array().cast("array<double>"))


def known(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def total(values: Column) -> Column:
    """Sum of the known values, null without any."""
    return F.when(F.size(known(values)) > 0, F.aggregate(known(values), F.lit(0.0), lambda a, v: a + v))


def first(values: Column) -> Column:
    return F.get(known(values), F.lit(0))


def shared_locations(targets: DataFrame, fleet: str) -> DataFrame:
    """Targets (fleet, target_id, lat, lon) with valid places, and ``location``: the first of the targets of their fleet in the same hundredth of a degree.

    One location is asked for all of them. It is named by a target and not numbered, which would put a fleet into one order.
    """
    valid = targets.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    keyed = valid.withColumns({"__y": F.bround("lat", 2), "__x": F.bround("lon", 2)})
    led = keyed.groupBy(fleet, "__y", "__x").agg(F.min("target_id").alias("location"))
    return keyed.join(led, [fleet, "__y", "__x"]).drop("__y", "__x")


def summaries(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with the summary of each forecast in the column ``text``, which goes. Missing sections, series and values are unknown (null).

    The text is parsed once a level: sections, series, values; each level has its own nulls, so a broken series leaves the others.
    """
    top = F.from_json(text, "current string, minutely_15 string, hourly string, latitude string, longitude string, elevation string, timezone string, generationtime_ms string")
    rows = documents.withColumn("__top", top)
    rows = rows.withColumns({
        "__now": F.from_json("__top.current", "precipitation string"),
        "__m": F.from_json("__top.minutely_15", ", ".join(f"{v} string" for v in MINUTELY)), "__h": F.from_json("__top.hourly", ", ".join(f"{v} string" for v in HOURLY)),
    })
    rows = rows.withColumn("__s", F.struct(*(series(F.col(f"__m.{v}"), STEPS).alias(v) for v in MINUTELY), *(series(F.col(f"__h.{v}"), HOURS).alias(v) for v in HOURLY)))
    s = lambda v: F.col(f"__s.{v}")
    near, wet = F.slice(s("precipitation"), 1, NEAR_STEPS), lambda v: F.coalesce(v > 0, F.lit(False))
    wet_at = F.array_position(F.transform(near, wet), True)
    some = lambda *names: F.exists(F.concat(*(s(v) for v in names)), lambda v: v.isNotNull())
    out = {
        "current_mm": F.bround(number(F.col("__now.precipitation")), 2),
        "max_90m_mm": F.bround(F.array_max(near), 2), "total_90m_mm": F.bround(total(near), 2),
        "wet_steps_90m": F.when(F.size(known(near)) > 0, F.size(F.filter(near, wet))), "first_wet_90m_min": F.when(wet_at > 0, (wet_at - 1) * STEP_MIN),
        "max_3h_mm": F.bround(F.array_max(s("precipitation")), 2), "total_3h_mm": F.bround(total(s("precipitation")), 2),
        "probability_max_6h": F.bround(F.array_max(s("precipitation_probability")), 1),
        "cape_max_3h": F.bround(F.array_max(s("cape")), 1), "lightning_max_3h": F.bround(F.array_max(s("lightning_potential")), 1),
        "gusts_max_3h_kmh": F.bround(F.array_max(s("wind_gusts_10m")), 1), "freezing_min_3h_m": F.bround(F.array_min(s("freezing_level_height")), 0),
        "pressure_hpa": F.bround(first(s("pressure_msl")), 1), "lifted_min_6h": F.bround(F.array_min(s("lifted_index")), 1),
        "inhibition_min_6h": F.bround(F.array_min(s("convective_inhibition")), 1),
        "wind_850_kmh": F.bround(first(s("wind_speed_850hPa")), 1), "wind_850_deg": F.bround(first(s("wind_direction_850hPa")), 0),
        "wind_700_kmh": F.bround(first(s("wind_speed_700hPa")), 1), "wind_700_deg": F.bround(first(s("wind_direction_700hPa")), 0),
        "humidity_700": F.bround(first(s("relative_humidity_700hPa")), 1), "cloud_cover": F.bround(first(s("cloud_cover")), 1),
        "convective": some("cape", "lightning_potential", "lifted_index", "convective_inhibition"),
        "aloft_wind": some("wind_speed_700hPa") & some("wind_direction_700hPa"),
        "variables": F.array_compact(F.array(*(F.when(some(v), v) for v in [*MINUTELY, *HOURLY]))),
        "precipitation_90m": F.transform(near, lambda v: F.bround(v, 2)), "rain_90m": F.transform(F.slice(s("rain"), 1, NEAR_STEPS), lambda v: F.bround(v, 2)),
        "showers_90m": F.transform(F.slice(s("showers"), 1, NEAR_STEPS), lambda v: F.bround(v, 2)), "precipitation_3h": F.transform(s("precipitation"), lambda v: F.bround(v, 2)),
        "model_lat": number(F.col("__top.latitude")), "model_lon": number(F.col("__top.longitude")), "elevation": number(F.col("__top.elevation")),
        "timezone": F.coalesce("__top.timezone", F.lit("UTC")), "generation_ms": number(F.col("__top.generationtime_ms")),
    }
    return rows.withColumns(out).drop(text, "__top", "__now", "__m", "__h", "__s")


def target_guidance(targets: DataFrame, documents: DataFrame, fleet: str) -> DataFrame:
    """Each target with the summary of its location's document (fleet, location, document), with nulls if there is none; ``model_lat`` and ``model_lon`` fall back to the target's place."""
    of_location = summaries(documents.select(fleet, "location", "document"), "document")
    rows = shared_locations(targets, fleet).join(of_location, [fleet, "location"], "left")
    return rows.withColumns({"model_lat": F.coalesce("model_lat", "lat"), "model_lon": F.coalesce("model_lon", "lon")})


def fleet_summary(guided: DataFrame, fleet: str) -> DataFrame:
    """One row a fleet: targets and locations, how many are wet now and in 90 minutes, the largest rain and the gear (HIGH: some wet; LOW: all known are dry; PARTIAL: none known)."""
    now, soon = F.col("current_mm"), F.col("max_90m_mm")
    known_any, is_wet = (F.count(now) + F.count(soon)) > 0, lambda c: F.coalesce(c > 0, F.lit(False))
    wet = guided.groupBy(fleet).agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.col("target_id") == F.col("location")).alias("locations"),  # every location is named by one of its targets
        F.when(F.count(now) > 0, F.count_if(is_wet(now))).alias("wet_now"), F.when(F.count(soon) > 0, F.count_if(is_wet(soon))).alias("wet_90m"),
        F.when(known_any, F.count_if(is_wet(now) | is_wet(soon))).alias("wet_targets"), F.bround(F.greatest(F.max(now), F.max(soon)), 2).alias("max_mm"),
    )
    some = (F.coalesce("wet_now", F.lit(0)) > 0) | (F.coalesce("wet_90m", F.lit(0)) > 0)
    return wet.withColumns({"raining": F.col("wet_now") > 0, "gear": F.when(some, "HIGH").when(F.col("max_mm").isNotNull(), "LOW").otherwise("PARTIAL")})


def nowcast_summary(documents: DataFrame, text: str) -> DataFrame:
    """``documents`` with steps, sum and maximum of the known 15-minute values of a place's nowcast (its first feature's); without any 0."""
    kind = "reference_time string, features array<struct<properties:struct<parameters:struct<rr:struct<data:array<string>>>>>>"
    rows = documents.withColumn("__d", F.from_json(text, kind))
    data = F.get(F.col("__d.features"), F.lit(0))["properties"]["parameters"]["rr"]["data"]
    rows = rows.withColumn("__v", F.coalesce(known(F.transform(data, number)), F.array().cast("array<double>")))
    return rows.select(
        *documents.drop(text).columns, F.col("__d.reference_time").alias("reference_time"), F.size("__v").alias("steps"),
        F.bround(F.aggregate("__v", F.lit(0.0), lambda a, v: a + v), 2).alias("rain_3h_mm"), F.bround(F.coalesce(F.array_max("__v"), F.lit(0.0)), 2).alias("max_15min_mm"),
    )


#: Steps that a document of the model holds; more than count.
SENT = 16
K = "CAST(round(quality * 100) AS BIGINT)"


def rain_steps(spark, sf_dir) -> DataFrame:
    """The first readings of each station in order, as steps of its model: station_id, i, p, cape (a text), wind, way, lifted, pressure."""
    r = observations(spark, sf_dir, "rain").withColumn("k", F.expr(K))
    r = r.withColumn("i", F.row_number().over(Window.partitionBy("station_id").orderBy("sim_s", "event_id")) - 1).where(F.col("i") < SENT)
    return r.select(
        "station_id", "i", F.when(F.col("k") % 7 != 0, F.floor(F.col("rain_mm") * 100) / 100.0).alias("p"), F.when(F.col("k") % 5 != 0, F.col("k") * 10).cast("string").alias("cape"),
        F.when(F.col("k") % 11 != 0, F.col("k")).alias("wind"), (F.col("k") * 3).alias("way"), ((F.col("k") - 50) / 10.0).alias("lifted"), "pressure",
    )


def model_documents(spark, sf_dir) -> DataFrame:
    """A document for each station: its steps as ragged arrays with nulls, no quarter-hours for some stations, and the rain of its newest reading as the current one."""
    steps = rain_steps(spark, sf_dir).groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("i", "p", "cape", "wind", "way", "lifted", "pressure"))).alias("s"))
    newest = observations(spark, sf_dir, "rain").groupBy("station_id").agg(F.max_by(F.struct("blob", "lat", "lon", "rain_mm", F.expr(K).alias("k")), F.struct("sim_s", "event_id")).alias("n"))
    rows = steps.join(newest, "station_id")
    hourly = F.struct(F.col("s.pressure").alias("pressure_msl"), F.col("s.lifted").alias("lifted_index"), F.col("s.wind").alias("wind_speed_700hPa"), F.col("s.way").alias("wind_direction_700hPa"))
    body = F.struct(
        F.struct(F.when(F.col("n.k") % 7 != 0, F.floor(F.col("n.rain_mm") * 100) / 100.0).alias("precipitation")).alias("current"),
        F.when(F.col("station_id") % 13 != 0, F.struct(F.col("s.p").alias("precipitation"), F.col("s.cape").alias("cape"))).alias("minutely_15"), hourly.alias("hourly"),
    )
    return rows.select(F.col("n.blob").alias("blob"), F.concat(F.lit("t"), "station_id").alias("target_id"), F.col("n.lat").alias("lat"), F.col("n.lon").alias("lon"), F.to_json(body).alias("document"))


def guided(spark, sf_dir) -> DataFrame:
    """Stations as targets where they were last, with the model of their location's first one."""
    d = model_documents(spark, sf_dir)
    return target_guidance(d.select("blob", "target_id", "lat", "lon"), d.select("blob", F.col("target_id").alias("location"), "document"), "blob")


_EVEN = "CASE WHEN {0} % 10 = 5 THEN {0} // 10 + ({0} // 10) % 2 ELSE ({0} + 5) // 10 END"
STEPS_SQL = f"""
, r AS (SELECT *, CAST(round(quality * 100) AS BIGINT) AS k FROM obs WHERE kind = 'rain'),
s AS (
    SELECT blob, station_id, station_id % 13 <> 0 AS quarters, lat, lon, pressure, row_number() OVER (PARTITION BY station_id ORDER BY sim_s, event_id) - 1 AS i,
        row_number() OVER (PARTITION BY station_id ORDER BY sim_s DESC, event_id DESC) AS back, CASE WHEN k % 7 <> 0 THEN floor(rain_mm * 100) / 100.0e0 END AS p,
        CASE WHEN k % 5 <> 0 THEN k * 10.0e0 END AS cape, CASE WHEN k % 11 <> 0 THEN k * 1.0e0 END AS wind, (k - 50) / 10.0e0 AS lifted, k
    FROM r
)"""
GUIDED_SQL = STEPS_SQL + f""",
m AS (
    SELECT 't' || station_id AS location, round(max(p) FILTER (back = 1), 2) AS current_mm, round(max(p) FILTER (quarters AND i < 7), 2) AS max_90m_mm, round(sum(p) FILTER (quarters AND i < 7), 2) AS total_90m_mm,
        CAST(CASE WHEN count(p) FILTER (quarters AND i < 7) > 0 THEN count(*) FILTER (quarters AND i < 7 AND p > 0) END AS INT) AS wet_steps_90m,
        CAST(15 * min(i) FILTER (quarters AND i < 7 AND p > 0) AS BIGINT) AS first_wet_90m_min,
        round(max(p) FILTER (quarters AND i < 13), 2) AS max_3h_mm, round(sum(p) FILTER (quarters AND i < 13), 2) AS total_3h_mm, round(max(cape) FILTER (quarters AND i < 13), 1) AS cape_max_3h,
        round(arg_min(pressure, i) FILTER (i < 6 AND pressure IS NOT NULL), 1) AS pressure_hpa, round(min(lifted) FILTER (i < 6), 1) AS lifted_min_6h,
        round(arg_min(wind, i) FILTER (i < 6 AND wind IS NOT NULL), 1) AS wind_700_kmh, count(cape) FILTER (quarters AND i < 13) + count(lifted) FILTER (i < 6) > 0 AS convective,
        count(wind) FILTER (i < 6) > 0 AND count(k) FILTER (i < 6) > 0 AS aloft_wind,
        concat_ws(',', CASE WHEN count(p) FILTER (quarters AND i < 13) > 0 THEN 'precipitation' END, CASE WHEN count(cape) FILTER (quarters AND i < 13) > 0 THEN 'cape' END,
            CASE WHEN count(pressure) FILTER (i < 6) > 0 THEN 'pressure_msl' END, CASE WHEN count(lifted) FILTER (i < 6) > 0 THEN 'lifted_index' END,
            CASE WHEN count(wind) FILTER (i < 6) > 0 THEN 'wind_speed_700hPa' END, CASE WHEN count(k) FILTER (i < 6) > 0 THEN 'wind_direction_700hPa' END) AS variables
    FROM s GROUP BY station_id
),
placed AS (SELECT blob, 't' || station_id AS target_id, CAST(round(lat * 1000) AS BIGINT) AS a, CAST(round(lon * 1000) AS BIGINT) AS b FROM s WHERE back = 1),
t AS (SELECT blob, target_id, min(target_id) OVER (PARTITION BY blob, {_EVEN.format('a')}, {_EVEN.format('b')}) AS location FROM placed),
g AS (SELECT * FROM t JOIN m USING (location))
"""
SHOWN = [
    "blob", "target_id", "location", "current_mm", "max_90m_mm", "total_90m_mm", "wet_steps_90m", "first_wet_90m_min", "max_3h_mm", "total_3h_mm", "cape_max_3h", "pressure_hpa", "lifted_min_6h", "wind_700_kmh",
    "convective", "aloft_wind",
]


@query("S31_SC25_X14_guidance", GUIDED_SQL + f"SELECT {', '.join(SHOWN)}, variables FROM g")
def guidance(spark, sf_dir):
    """The model's summary of each target, read from its location's document."""
    return guided(spark, sf_dir).select(*SHOWN, F.array_join("variables", ",").alias("variables"))


@query("A18_X20_fleets", GUIDED_SQL + """
, f AS (
    SELECT blob, count(*) AS targets, count(DISTINCT location) AS locations, CASE WHEN count(current_mm) > 0 THEN count(*) FILTER (current_mm > 0) END AS wet_now,
        CASE WHEN count(max_90m_mm) > 0 THEN count(*) FILTER (max_90m_mm > 0) END AS wet_90m, count(*) FILTER (current_mm > 0 OR max_90m_mm > 0) AS wet_targets, max(greatest(current_mm, max_90m_mm)) AS max_mm
    FROM g GROUP BY 1
)
SELECT blob, targets, locations, wet_now, wet_90m, CASE WHEN max_mm IS NOT NULL THEN wet_targets END AS wet_targets, max_mm, wet_now > 0 AS raining,
    CASE WHEN coalesce(wet_now, 0) + coalesce(wet_90m, 0) > 0 THEN 'HIGH' WHEN max_mm IS NOT NULL THEN 'LOW' ELSE 'PARTIAL' END AS gear FROM f
""")
def fleets(spark, sf_dir):
    return fleet_summary(guided(spark, sf_dir), "blob")


@query("S32_nowcast", STEPS_SQL + """
SELECT station_id, CAST(count(p) FILTER (i < 13 AND station_id % 17 <> 0) AS INT) AS steps, round(coalesce(sum(p) FILTER (i < 13 AND station_id % 17 <> 0), 0), 2) AS rain_3h_mm,
    round(coalesce(max(p) FILTER (i < 13 AND station_id % 17 <> 0), 0), 2) AS max_15min_mm FROM s GROUP BY 1
""")
def nowcasts(spark, sf_dir):
    """Sum and maximum of each station's nowcast, read from a document with its steps (for some stations without a feature)."""
    steps = rain_steps(spark, sf_dir).where(F.col("i") < STEPS).groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("s"))
    feature = F.struct(F.struct(F.struct(F.struct(F.col("s.p").alias("data")).alias("rr")).alias("parameters")).alias("properties"))
    features = F.when(F.col("station_id") % 17 != 0, F.array(feature)).otherwise(F.slice(F.array(feature), 1, 0))
    return nowcast_summary(steps.select("station_id", F.to_json(F.struct(features.alias("features"))).alias("document")), "document").drop("reference_time")
