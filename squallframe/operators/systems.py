"""Radar systems of storms over time: their frames, and which storms are mesoscale convective systems (MCS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions import geo
from squallframe.functions.geo import haversine
from squallframe.operators.observing import query, routed

#: Limits of convective and intense cells in dBZ and of a system's shape, run and history (fixed values).
CONVECTIVE_DBZ, INTENSE_DBZ = 40.0, 50.0
MIN_CONVECTIVE, MIN_INTENSE, MIN_SPAN_KM = 2, 1, 100.0
MIN_MINUTES, MAX_GAP_MIN, HISTORY_H = 180.0, 20.0, 6


def spans(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """About the largest distance of each group's points (keys, lat, lon, order) in kilometres, to six places: ``span_km``.

    From the first point to the farthest, and from that to the farthest; the first of equally far ones counts. Two
    aggregations and joins by key, so that no group is collected.
    """
    start = points.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon"), order).alias("__s"))
    far = F.round(haversine(*map(F.col, ("__s.lat", "__s.lon", "lat", "lon"))), 6)
    one = points.join(start, keys).groupBy(*keys).agg(F.max_by(F.struct("lat", "lon"), F.struct(far, -F.col(order))).alias("__o"))
    return points.join(one, keys).groupBy(*keys).agg(F.round(F.max(haversine(*map(F.col, ("__o.lat", "__o.lon", "lat", "lon")))), 6).alias("span_km"))


def ring_span(points: Column) -> Column:
    """The same of the points of one row, an array of (lat, lon); 0 for fewer than two and for null."""
    def farthest(origin: Column) -> Column:
        each = F.transform(points, lambda p, i: F.struct(haversine(origin["lat"], origin["lon"], p["lat"], p["lon"]).alias("km"), (-i).alias("i"), p.alias("at")))
        return F.array_max(each)

    # a transform of one element names the end that was found, so that it is looked for once
    ends = F.transform(F.array(farthest(F.get(points, F.lit(0)))["at"]), farthest)
    return F.when(F.size(points) > 1, F.round(F.get(ends, F.lit(0))["km"], 6)).otherwise(0.0)


def parent_frames(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each parent system of a storm: first, ts, area_km2, precipitation_span_km, children, max_dbz, convective, intense, span_km and ``shape``.

    cells: keys, parent, cell_id, ts, lat, lon, max_dbz, area_km2, parent_area_km2, parent_footprint (array of lat, lon), and
    a number by which they came. A cell that comes again in its parent changes nothing; time, area and footprint are those
    of the parent's first cell; an area of 0 is none, and then the cell's own counts. A null dBZ is 0. Cells without a parent go.
    """
    group = [*keys, "parent"]
    some = lambda c: F.nullif(F.col(c), F.lit(0.0))
    fields = ["ts", "lat", "lon", "max_dbz", "area_km2", "parent_area_km2", "parent_footprint"]
    once = cells.where("parent <> ''").groupBy(*group, "cell_id").agg(F.min(order).alias("__n"), F.min_by(F.struct(*fields), order).alias("__c")).select(*group, "__n", "__c.*")
    once = once.withColumn("max_dbz", F.coalesce("max_dbz", F.lit(0.0)))
    head = F.min_by(F.struct("ts", F.coalesce(some("parent_area_km2"), some("area_km2"), F.lit(0.0)).alias("area_km2"), "parent_footprint"), "__n")
    convective = once.where(F.col("max_dbz") >= CONVECTIVE_DBZ)
    frames = once.groupBy(*group).agg(
        F.min("__n").alias("first"), head.alias("__h"), F.count(F.lit(1)).alias("children"), F.greatest(F.max("max_dbz"), F.lit(0.0)).alias("max_dbz"),
        F.count_if(F.col("max_dbz") >= CONVECTIVE_DBZ).alias("convective"), F.count_if(F.col("max_dbz") >= INTENSE_DBZ).alias("intense"),
    )
    frames = frames.join(spans(convective, group, "__n"), group, "left").withColumn("span_km", F.coalesce("span_km", F.lit(0.0)))
    shape = (F.col("convective") >= MIN_CONVECTIVE) & (F.col("span_km") >= MIN_SPAN_KM) & (F.col("intense") >= MIN_INTENSE)
    return frames.select(
        *group, "first", "__h.ts", "__h.area_km2", ring_span(F.col("__h.parent_footprint")).alias("precipitation_span_km"), "children", "max_dbz", "convective", "intense", "span_km", shape.alias("shape"),
    )


def classify(frames: DataFrame, keys: list[str], storms: DataFrame | None = None) -> DataFrame:
    """Status, type and reason of each storm by its parent frames; storms (rows of keys) without any aren't evaluated.

    Of parents at one time the strongest counts: by shape, span, dBZ, area, then the first. The run of frames with the shape
    goes back from the newest one, over gaps of at most MAX_GAP_MIN; a storm whose newest frame lacks the shape has none.
    Frames of a storm are as many as its history holds, so its window is bounded.
    """
    rank = F.struct("shape", "span_km", "max_dbz", "area_km2", -F.col("first"))
    kept = ["shape", "span_km", "precipitation_span_km", "convective", "intense", "area_km2"]
    best = frames.groupBy(*keys, "ts").agg(F.max_by(F.struct(*kept), rank).alias("__b")).select(*keys, "ts", "__b.*")
    back = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    broke = ~F.col("shape") | F.coalesce(F.lag("ts").over(back) - F.col("ts") > MAX_GAP_MIN * 60, F.lit(False))
    in_run = F.sum(broke.cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)) == 0
    out = best.withColumn("__run", in_run).groupBy(*keys).agg(
        F.max("ts").alias("latest"), F.max_by(F.struct(*kept), "ts").alias("__l"), F.min(F.when(F.col("__run"), F.col("ts"))).alias("since"), F.count_if("__run").alias("frames"),
    )
    out = out.select(*keys, "latest", "since", "frames", F.coalesce((F.col("latest") - F.col("since")) / 60.0, F.lit(0.0)).alias("minutes"), "__l.*")
    if storms is not None:
        out = storms.join(out, keys, "left")
    long_enough, none = F.col("minutes") >= MIN_MINUTES, F.col("latest").isNull()
    lacks = F.array_compact(F.array(
        F.when(F.col("convective") < MIN_CONVECTIVE, "insufficient_convective_cells"), F.when(F.col("span_km") < MIN_SPAN_KM, "insufficient_convective_span"),
        F.when(F.col("intense") < MIN_INTENSE, "no_intense_cell"),
    ))
    cluster = F.when(F.col("convective") > 0, "convective_cluster").otherwise("rain_area")
    case = lambda nothing, other, confirmed, candidate: F.when(none, nothing).when(~F.col("shape"), other).when(long_enough, confirmed).otherwise(candidate)
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
    return out.select(
        *keys, case("not_evaluated", "not_mcs", "confirmed", "candidate").alias("status"), case("unknown", cluster, "mcs", "mcs_candidate").alias("system_type"),
        case("no_radar_history", F.array_join(lacks, ","), "duration_confirmed", "duration_pending").alias("reason"), "since", "latest",
        F.round(zero("minutes", "double"), 1).alias("minutes"), zero("frames", "long").alias("frames"), F.round(zero("span_km", "double"), 1).alias("convective_span_km"),
        F.round(zero("precipitation_span_km", "double"), 1).alias("precipitation_span_km"), zero("convective", "long").alias("convective_cells"), zero("intense", "long").alias("intense_cells"),
        zero("area_km2", "double").alias("parent_area_km2"),
    )


def with_checks(classified: DataFrame) -> DataFrame:
    """Classified storms with ``checks`` (which conditions hold, by the rounded figures) and the ``thresholds`` that these were held against."""
    checks = F.struct(
        (F.col("convective_cells") >= MIN_CONVECTIVE).alias("convective_cells"), (F.col("convective_span_km") >= MIN_SPAN_KM).alias("convective_span"),
        (F.col("intense_cells") >= MIN_INTENSE).alias("intense_cells"), (F.col("minutes") >= MIN_MINUTES).alias("duration"),
    )
    limits = {
        "convective_dbz": CONVECTIVE_DBZ, "intense_dbz": INTENSE_DBZ, "min_convective_cells": MIN_CONVECTIVE, "min_convective_span_km": MIN_SPAN_KM, "min_intense_cells": MIN_INTENSE,
        "min_duration_minutes": MIN_MINUTES, "max_frame_gap_minutes": MAX_GAP_MIN,
    }
    return classified.withColumns({"checks": checks, "thresholds": F.struct(*(F.lit(v).alias(k) for k, v in limits.items()))})


def in_history(frames: DataFrame) -> DataFrame:
    """Frames once for each full hour (``hour_s``) in whose history of HISTORY_H hours they are."""
    hours = F.sequence(F.floor(F.col("ts") / 3600), F.floor(F.col("ts") / 3600) + HISTORY_H)
    return frames.withColumn("hour_s", F.explode(F.transform(hours, lambda h: h * 3600))).where(f"ts BETWEEN hour_s - {HISTORY_H * 3600} AND hour_s")


def region_cells(spark, sf_dir) -> DataFrame:
    """Radar cells as those of regions: a source's cells of a quarter of an hour are one parent, whose footprint is a box around its first cell."""
    box = F.array(*[F.struct((F.col("lat") + dy).alias("lat"), (F.col("lon") + dx).alias("lon")) for dy, dx in ((-0.1, -0.1), (-0.1, 0.1), (0.1, 0.1), (0.1, -0.1))])
    k = F.expr("CAST(round(quality * 100) AS BIGINT)")
    return routed(spark, sf_dir, "radar").select(
        "region_id", F.concat_ws(":", "source", F.expr("sim_s DIV 900")).alias("parent"), F.col("station_id").alias("cell_id"), F.expr("(sim_s DIV 900) * 900").alias("ts"), "lat", "lon",
        F.col("dbz").alias("max_dbz"), k.cast("double").alias("area_km2"), F.when(k % 3 != 0, (k % 5) * 100.0).alias("parent_area_km2"), box.alias("parent_footprint"), "event_id",
    )


def region_classes(spark, sf_dir) -> DataFrame:
    keys = ["region_id", "hour_s"]
    return classify(in_history(parent_frames(region_cells(spark, sf_dir), ["region_id"], "event_id")), keys)


_HAV = geo.haversine_sql("o.lat", "o.lon", "r.c_lat", "r.c_lon")
_KM = geo.haversine_sql("a.lat", "a.lon", "p.lat", "p.lon")
CLASSES_SQL = f"""
, cells AS (
    SELECT region_id, source, sim_s // 900 AS slot, station_id, min(event_id) AS n, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon, arg_min(dbz, event_id) AS dbz,
        arg_min(CAST(round(quality * 100) AS BIGINT), event_id) AS k
    FROM obs o JOIN regions r ON {_HAV} <= radius_km WHERE kind = 'radar' GROUP BY ALL
),
heads AS (
    SELECT region_id, source, slot, min(n) AS first, arg_min(k, n) AS k, arg_min(lat, n) AS lat, arg_min(lon, n) AS lon, count(*) AS children, max(dbz) AS max_dbz,
        count(*) FILTER (dbz >= 40) AS convective, count(*) FILTER (dbz >= 50) AS intense
    FROM cells GROUP BY ALL
),
points AS (SELECT * FROM cells WHERE dbz >= 40),
begun AS (SELECT region_id, source, slot, arg_min(lat, n) AS lat, arg_min(lon, n) AS lon FROM points GROUP BY ALL),
ends AS (
    SELECT region_id, source, slot, arg_max(p.lat, (round({_KM}, 6), -n)) AS lat, arg_max(p.lon, (round({_KM}, 6), -n)) AS lon
    FROM points p JOIN begun a USING (region_id, source, slot) GROUP BY ALL
),
spans AS (SELECT region_id, source, slot, round(max({_KM}), 6) AS span FROM points p JOIN ends a USING (region_id, source, slot) GROUP BY ALL),
frames AS (
    SELECT h.*, coalesce(span, 0) AS span, slot * 900 AS ts, convective >= 2 AND coalesce(span, 0) >= 100 AND intense >= 1 AS shape,
        CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN (k % 5) * 100.0e0 ELSE CAST(k AS DOUBLE) END AS area
    FROM heads h LEFT JOIN spans USING (region_id, source, slot)
),
seen AS (SELECT f.*, h * 3600 AS hour_s FROM frames f, unnest(generate_series(ts // 3600, ts // 3600 + 7)) g(h) WHERE ts <= h * 3600 AND h * 3600 - ts <= 21600),
best AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY region_id, hour_s, ts ORDER BY shape DESC, span DESC, max_dbz DESC, area DESC, first) = 1),
newest AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY region_id, hour_s ORDER BY ts DESC) = 1),
gaps AS (SELECT *, lead(ts) OVER (PARTITION BY region_id, hour_s ORDER BY ts) AS later FROM best),
-- the run begins behind the last frame that breaks it
stops AS (SELECT region_id, hour_s, max(ts) AS stop FROM gaps WHERE NOT shape OR later - ts > 1200 GROUP BY ALL),
runs AS (SELECT b.region_id, b.hour_s, min(ts) AS since, count(*) AS frames FROM best b LEFT JOIN stops s USING (region_id, hour_s) WHERE stop IS NULL OR ts > stop GROUP BY ALL),
classes AS (
    SELECT region_id, hour_s, since, ts AS latest, coalesce(frames, 0) AS frames, coalesce((ts - since) / 60.0e0, 0) AS mins, shape, convective, intense, span, area,
        {geo.haversine_sql('(lat - 0.1e0)', '(lon - 0.1e0)', '(lat + 0.1e0)', '(lon + 0.1e0)')} AS wide
    FROM newest LEFT JOIN runs USING (region_id, hour_s)
),
classified AS (
    SELECT region_id, hour_s, CASE WHEN NOT shape THEN 'not_mcs' WHEN mins >= 180 THEN 'confirmed' ELSE 'candidate' END AS status,
        CASE WHEN shape AND mins >= 180 THEN 'mcs' WHEN shape THEN 'mcs_candidate' WHEN convective > 0 THEN 'convective_cluster' ELSE 'rain_area' END AS system_type,
        CASE WHEN shape AND mins >= 180 THEN 'duration_confirmed' WHEN shape THEN 'duration_pending' ELSE concat_ws(',', CASE WHEN convective < 2 THEN 'insufficient_convective_cells' END,
            CASE WHEN span < 100 THEN 'insufficient_convective_span' END, CASE WHEN intense < 1 THEN 'no_intense_cell' END) END AS reason,
        since, latest, round(mins, 1) AS minutes, frames, round(span, 1) AS convective_span_km, round(wide, 1) AS precipitation_span_km, convective AS convective_cells, intense AS intense_cells,
        area AS parent_area_km2
    FROM classes
)
"""


@query("C1_C2_A1_W1_W2_mcs", CLASSES_SQL + """
SELECT *, convective_cells >= 2 AS has_cells, convective_span_km >= 100 AS has_span, intense_cells >= 1 AS has_intense, minutes >= 180 AS has_duration FROM classified
""")
def mcs_classes(spark, sf_dir):
    """Whether each region's systems are an MCS at each full hour, by the six hours before it, with the conditions that hold."""
    checked = with_checks(region_classes(spark, sf_dir))
    checks = {"has_cells": "convective_cells", "has_span": "convective_span", "has_intense": "intense_cells", "has_duration": "duration"}
    return checked.select("*", *(F.col(f"checks.{c}").alias(a) for a, c in checks.items())).drop("checks", "thresholds")


@query("A20_W10_mcs_transitions", CLASSES_SQL + """
, l AS (SELECT hour_s, status, lag(status) OVER (PARTITION BY region_id ORDER BY hour_s) AS before FROM classified)
SELECT hour_s, status, count(*) AS storms, count(*) FILTER (before <> status) AS changed FROM l GROUP BY 1, 2
""")
def mcs_transitions(spark, sf_dir):
    """Storms of each status by hour, and how many of them had another one the hour before."""
    before = F.lag("status").over(Window.partitionBy("region_id").orderBy("hour_s"))
    rows = region_classes(spark, sf_dir).select("hour_s", "status", before.alias("before"))
    return rows.groupBy("hour_s", "status").agg(F.count(F.lit(1)).alias("storms"), F.count_if(F.col("before") != F.col("status")).alias("changed"))
