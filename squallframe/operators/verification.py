"""Cells of a composite radar, accepted by quality, by structure or by other radars; of the latter only the confirmed part stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallframe.functions import geo
from squallframe.functions.relational import within_km
from squallframe.operators.observing import query
from squallframe.sources.observations import observations

#: Quality that suffices; structure that suffices (mean and largest reflectivity, area); reach of a confirmation in space and time (fixed values).
QUALITY, MEAN_DBZ, MAX_DBZ, AREA_KM2, RADIUS_KM, AGE_S = 0.5, 20.0, 30.0, 50.0, 12.0, 900
#: Degrees of the grid that rings and points meet in.
TILE = 0.5


def _has(ring: str) -> Column:
    return F.coalesce(F.size(ring) > 0, F.lit(False))


def _slot(at: str) -> Column:
    return F.floor(F.col(at) / AGE_S)


def _slots(at: str) -> Column:
    return F.explode(F.sequence(_slot(at) - 1, _slot(at) + 1))


def _within(ring: Column, lat: Column, lon: Column) -> Column:
    """Whether a place is inside a ring of (lat, lon), by the even-odd rule."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))

    def crosses(p: Column, q: Column) -> Column:
        return F.coalesce(((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]), F.lit(False))

    return F.size(F.filter(F.zip_with(ring, before, crosses), lambda c: c)) % 2 == 1


def confirmed_points(cells: DataFrame, references: DataFrame) -> DataFrame:
    """The confirmed part of each cell with a footprint: cell and ``ring``, closed where it has three points or more.

    A reference of the same quarter of an hour (AGE_S) confirms those points of the cell that are within RADIUS_KM of one of its own points (its place, if it has no
    footprint), and adds those of its own that lie inside the cell's footprint. Points stand in the order in which the references, by their ids, find them, each once.
    Points of references that share time and place are joined once, by grid cells; a cell's found points are grouped before they are
    put together, so only a footprint's worth of points is ever in a row.
    """
    own = cells.where(_has("footprint"))
    points = own.select("cell", F.col("at").alias("c_at"), _slot("at").alias("slot"), F.posexplode("footprint").alias("pos", "p"))
    points = points.select("cell", "c_at", "slot", "pos", F.col("p.lat").alias("y"), F.col("p.lon").alias("x"))
    place = F.array(F.struct("lat", "lon"))
    theirs = references.select("reference", "at", _has("footprint").alias("shaped"), F.posexplode(F.when(_has("footprint"), F.col("footprint")).otherwise(place)).alias("r_pos", "p"))
    theirs = theirs.select("reference", "at", "shaped", "r_pos", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))

    any_of = theirs.groupBy("at", "lat", "lon").agg(F.min("reference").alias("reference")).withColumn("slot", _slots("at"))
    near = within_km(points, any_of, "y", "x", "lat", "lon", RADIUS_KM, ["slot"]).where(F.abs(F.col("c_at") - F.col("at")) <= AGE_S)
    found = near.select("cell", "y", "x", F.struct("reference", F.lit(0).alias("kind"), F.col("pos").alias("pos")).alias("o"))

    rings = own.where(F.size("footprint") >= 3).select("cell", F.col("at").alias("c_at"), _slot("at").alias("slot"), "footprint")
    for axis, name in (("gy", "lat"), ("gx", "lon")):
        rings = rings.withColumn(axis, F.explode(F.sequence(F.floor(F.array_min(f"footprint.{name}") / TILE), F.floor(F.array_max(f"footprint.{name}") / TILE))))
    shaped = theirs.where("shaped").groupBy("at", "lat", "lon").agg(F.min(F.struct("reference", "r_pos")).alias("r")).withColumn("slot", _slots("at"))
    shaped = shaped.withColumns({"gy": F.floor(F.col("lat") / TILE), "gx": F.floor(F.col("lon") / TILE)})
    held = rings.join(shaped, ["slot", "gy", "gx"]).where((F.abs(F.col("c_at") - F.col("at")) <= AGE_S) & _within(F.col("footprint"), F.col("lat"), F.col("lon")))
    found = found.unionByName(held.select("cell", F.col("lat").alias("y"), F.col("lon").alias("x"), F.struct(F.col("r.reference").alias("reference"), F.lit(1).alias("kind"), F.col("r.r_pos").alias("pos")).alias("o")))

    once = found.groupBy("cell", "y", "x").agg(F.min("o").alias("o"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("o", F.col("y").alias("lat"), F.col("x").alias("lon")))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return once.groupBy("cell").agg(ring.alias("ring")).withColumn("ring", F.when(F.size("ring") >= 3, F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring")))


def verified(cells: DataFrame, references: DataFrame) -> DataFrame:
    """``cells`` with ``verdict``: quality, structure, corroborated or rejected.

    cells: cell (an id), at (seconds), lat, lon, quality, mean_dbz, max_dbz, area_km2 and footprint (array of (lat, lon) in ring order; null or empty: none); nulls never
    suffice. references: reference (an id), at, lat, lon, footprint. A corroborated cell with a footprint is cut to its confirmed part: the area goes down (or
    up) with the number of points, place and footprint are the part's. One without is confirmed by a reference's place near its own and stays as it is.
    """
    structure = (F.col("mean_dbz") >= MEAN_DBZ) & (F.col("max_dbz") >= MAX_DBZ) & (F.col("area_km2") >= AREA_KM2)
    judged = cells.withColumn("__own", F.when(F.col("quality") >= QUALITY, "quality").when(structure, "structure"))
    doubtful = judged.where("__own IS NULL")
    bare = doubtful.where(~_has("footprint")).select("cell", F.col("at").alias("c_at"), _slot("at").alias("slot"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    places = references.select("at", "lat", "lon").distinct().withColumn("slot", _slots("at"))
    seen = within_km(bare, places, "y", "x", "lat", "lon", RADIUS_KM, ["slot"]).where(F.abs(F.col("c_at") - F.col("at")) <= AGE_S)
    parts = confirmed_points(doubtful, references).unionByName(seen.select("cell").distinct().withColumn("ring", F.lit(None).cast("array<struct<lat:double,lon:double>>")))
    rows = judged.join(parts.withColumn("__seen", F.lit(True)), "cell", "left")
    mean = lambda c: F.aggregate(F.col(f"ring.{c}"), F.lit(0.0), lambda a, v: a + v) / F.size("ring")
    cut = F.col("ring").isNotNull()
    changed = {
        "verdict": F.coalesce("__own", F.when(F.col("__seen"), "corroborated"), F.lit("rejected")),
        "lat": F.when(cut, mean("lat")).otherwise(F.col("lat")), "lon": F.when(cut, mean("lon")).otherwise(F.col("lon")),
        "area_km2": F.when(cut, F.col("area_km2") * (F.size("ring") / F.size("footprint"))).otherwise(F.col("area_km2")), "footprint": F.when(cut, F.col("ring")).otherwise(F.col("footprint")),
    }
    return rows.withColumns(changed).select(*cells.columns, "verdict")


#: Degrees of the squares that pixels of a frame are taken together in, and the area of a pixel.
PART, PIXEL_KM2 = 0.05, 20.0


def radar_parts(spark, sf_dir) -> DataFrame:
    """Pixels (places) of a source's frame, in squares: an id, newest time, middle, lowest quality, reflectivities, area and, from two pixels on, the pixels around the middle as a ring.

    A square has 2,500 places at most, however many rows are at one.
    """
    o = observations(spark, sf_dir, "radar").where("source = 'comp' OR intensity >= 2")
    px = o.groupBy("source", "frame_s", "lat", "lon").agg(F.min("event_id").alias("event_id"), F.max("sim_s").alias("sim_s"), F.max("dbz").alias("dbz"), F.min("quality").alias("quality"))
    square = ["source", "frame_s", geo.grid_key(F.col("lat"), PART).alias("gy"), geo.grid_key(F.col("lon"), PART).alias("gx")]
    g = px.groupBy(*square).agg(
        F.min("event_id").alias("cell"), F.max("sim_s").alias("at"), F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"), F.min("quality").alias("quality"), F.avg("dbz").alias("mean_dbz"),
        F.max("dbz").alias("max_dbz"), (F.count(F.lit(1)) * PIXEL_KM2).alias("area_km2"), F.collect_list(F.struct("lat", "lon")).alias("places"),
    )
    turn = lambda p: F.round(F.atan2(p["lat"] - F.col("c_lat"), p["lon"] - F.col("c_lon")), 6)
    around = F.transform(F.array_sort(F.transform("places", lambda p: F.struct(turn(p).alias("turn"), p["lat"].alias("lat"), p["lon"].alias("lon")))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return g.select("source", "cell", "at", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), "quality", "mean_dbz", "max_dbz", "area_km2", F.when(F.size("places") >= 2, around).alias("footprint"))


_KM = geo.haversine_sql("c.lat", "c.lon", "r.lat", "r.lon")


@query("D4_J6_verified_cells", f"""
, px AS (SELECT source, frame_s, lat, lon, min(event_id) AS event_id, max(sim_s) AS sim_s, max(dbz) AS dbz, min(quality) AS quality FROM obs WHERE kind = 'radar' AND (source = 'comp' OR intensity >= 2) GROUP BY 1, 2, 3, 4),
parts AS (
    SELECT source, frame_s, floor(lat / {PART}e0) AS gy, floor(lon / {PART}e0) AS gx, min(event_id) AS cell, max(sim_s) AS time_s, avg(lat) AS c_lat, avg(lon) AS c_lon, min(quality) AS quality,
        count(*) AS n, count(*) * {PIXEL_KM2}e0 AS area_km2, CASE WHEN min(quality) >= {QUALITY} THEN 'quality' WHEN avg(dbz) >= {MEAN_DBZ} AND max(dbz) >= {MAX_DBZ} AND count(*) * {PIXEL_KM2}e0 >= {AREA_KM2} THEN 'structure' END AS own
    FROM px GROUP BY 1, 2, 3, 4
),
pts AS (
    SELECT p.source, cell, time_s, n, own, lat, lon, row_number() OVER (PARTITION BY cell ORDER BY round(atan2(lat - c_lat, lon - c_lon), 6), lat, lon) AS pos
    FROM px JOIN parts p ON p.source = px.source AND p.frame_s = px.frame_s AND p.gy = floor(px.lat / {PART}e0) AND p.gx = floor(px.lon / {PART}e0)
),
c AS (SELECT * FROM pts WHERE source = 'comp' AND own IS NULL),
r AS (SELECT * FROM pts WHERE source <> 'comp'),
own_points AS (SELECT c.cell, c.lat, c.lon, min((r.cell, 0, c.pos)) AS o FROM c JOIN r ON c.n >= 2 AND abs(c.time_s - r.time_s) <= {AGE_S} AND {_KM} <= {RADIUS_KM} GROUP BY 1, 2, 3),
sides AS (SELECT c.cell, c.time_s, c.lat, c.lon, b.lat AS q_lat, b.lon AS q_lon FROM c JOIN c b ON b.cell = c.cell AND b.pos = CASE WHEN c.pos = 1 THEN c.n ELSE c.pos - 1 END WHERE c.n >= 3),
held AS (
    SELECT s.cell, r.lat, r.lon, r.cell AS reference, r.pos FROM sides s JOIN r ON r.n >= 2 AND abs(s.time_s - r.time_s) <= {AGE_S} AND (s.lat > r.lat) <> (s.q_lat > r.lat) AND r.lon < (s.q_lon - s.lon) * (r.lat - s.lat) / (s.q_lat - s.lat) + s.lon
    GROUP BY 1, 2, 3, 4, 5 HAVING count(*) % 2 = 1
),
found AS (SELECT cell, lat, lon, min(o) AS o FROM (SELECT * FROM own_points UNION ALL SELECT cell, lat, lon, (reference, 1, pos) FROM held) GROUP BY 1, 2, 3),
ringed AS (SELECT cell, count(*) AS k, sum(lat) AS lats, sum(lon) AS lons, arg_min(lat, o) AS f_lat, arg_min(lon, o) AS f_lon FROM found GROUP BY 1),
closed AS (SELECT cell, CASE WHEN k >= 3 THEN k + 1 ELSE k END AS k, CASE WHEN k >= 3 THEN lats + f_lat ELSE lats END AS lats, CASE WHEN k >= 3 THEN lons + f_lon ELSE lons END AS lons FROM ringed),
bare AS (SELECT DISTINCT c.cell FROM c JOIN (SELECT time_s, c_lat AS lat, c_lon AS lon FROM parts WHERE source <> 'comp') r ON c.n = 1 AND abs(c.time_s - r.time_s) <= {AGE_S} AND {_KM} <= {RADIUS_KM})
SELECT p.cell, coalesce(own, CASE WHEN k IS NOT NULL OR p.cell IN (SELECT cell FROM bare) THEN 'corroborated' END, 'rejected') AS verdict, round(coalesce(lats / k, c_lat), 5) AS lat, round(coalesce(lons / k, c_lon), 5) AS lon,
    round(coalesce(area_km2 * k / n, area_km2), 3) AS area_km2, CAST(coalesce(k, CASE WHEN n >= 2 THEN n END, 0) AS INT) AS points
FROM parts p LEFT JOIN closed USING (cell) WHERE source = 'comp'
""")
def verified_cells(spark, sf_dir):
    """The composite's parts, held against those of the other sources."""
    parts = radar_parts(spark, sf_dir)
    out = verified(parts.where("source = 'comp'").drop("source"), parts.where("source <> 'comp'").select(F.col("cell").alias("reference"), "at", "lat", "lon", "footprint"))
    return out.select("cell", "verdict", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("area_km2", 3).alias("area_km2"), F.coalesce(F.size("footprint"), F.lit(0)).alias("points"))
