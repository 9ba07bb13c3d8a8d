"""Where moving storms pass targets: distance of a footprint along its track, statuses of targets and geometry of storms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallframe.functions import geo, rules
from squallframe.functions.shapes import hull_radius, hulls, ring_sides, sides_distance
from squallframe.operators.observing import ORACLES, QUERIES
from squallframe.sources.observations import OBS_SQL, observations, targets

# Horizon and steps in minutes, what counts as a hit (km), bounds of the uncertainty (km) and radius of the earth (km).
HORIZON, HIT_KM, MOST_UNSURE_KM, LEAST_ERROR_KM = 90, 0.1, 60.0, 0.5
UNSURE_KM = {"Hoog": 4.0, "Matig": 8.0}
UNSURE_OTHERS_KM = 15.0
RADIUS = 6371.0088
NEWEST_S, HISTORY_S, STRIKE_S = 60, 3600, 900


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return geo.haversine(lat1, lon1, lat2, lon2, RADIUS)


def motion_to_target(rows: DataFrame) -> DataFrame:
    """Add how each row's storm passes its target, sampled every minute of the horizon.

    rows: s_lat, s_lon, heading, speed, east, north (km/h), east2, north2 (km/h2), error_km, confidence, model and status of a storm, rings (array of
    footprints, arrays of (lat, lon); null or empty: none), the target's t_lat and t_lon, and distance (km to the storm's edge; null: to its centre).
    Footprints are convex and move as a whole, so a sample's distance is that of the target, moved the other way, to
    them. Adds bearing_to_target, approach_speed, moving_towards, eta_minutes, eta_basis, closest_pass_km, closest_pass_minutes, footprint_pass_km,
    footprint_pass_minutes, passage and unsure_km; all but the bearing are null for a storm without heading or speed, or with footprints but not confirmed.
    """
    c = F.col
    centre_km = haversine(c("s_lat"), c("s_lon"), c("t_lat"), c("t_lon"))
    rows = rows.withColumns({"__centre": centre_km, "distance": F.coalesce("distance", centre_km), "bearing_to_target": F.round(geo.bearing(c("s_lat"), c("s_lon"), c("t_lat"), c("t_lon")), 1)})
    has_rings = F.size(F.coalesce("rings", F.array())) > 0
    moves = c("heading").isNotNull() & (c("speed") > 0) & ~(has_rings & ~c("status").eqNullSafe(F.lit("bevestigd")))
    way = F.radians("heading")
    rows = rows.withColumns({"__moves": F.coalesce(moves, F.lit(False)), "__e": F.coalesce("east", c("speed") * F.sin(way)), "__n": F.coalesce("north", c("speed") * F.cos(way)), "__e2": F.coalesce("east2", F.lit(0.0)), "__n2": F.coalesce("north2", F.lit(0.0))})
    local = lambda p: F.struct(*(v.alias(n) for n, v in zip("xy", geo.local_km(p["lat"], p["lon"], c("t_lat"), c("t_lon")), strict=True)))
    rows = rows.withColumn("__rings", F.transform(F.coalesce("rings", F.array()), lambda ring: ring_sides(F.transform(ring, local))))
    wide = geo.KM_EAST * F.greatest(F.lit(0.05), F.cos(F.radians("s_lat")))
    base = F.lit(UNSURE_OTHERS_KM)
    for tier, km in UNSURE_KM.items():
        base = F.when(c("confidence") == tier, km).otherwise(base)
    error = F.greatest(F.lit(LEAST_ERROR_KM), F.coalesce("error_km", F.lit(0.0)))
    reach = F.greatest(F.lit(0.0), c("__centre") - c("distance"))

    def place(minute: Column) -> Column:
        hours = minute / 60.0
        east, north = (c(f"__{v}") * hours + c(f"__{v}2") * hours * hours / 2 for v in "en")
        centre = haversine(c("s_lat") + north / geo.KM_NORTH, c("s_lon") + east / wide, c("t_lat"), c("t_lon"))
        unsure = F.least(F.lit(MOST_UNSURE_KM), base + error * F.sqrt(F.greatest(minute, F.lit(1)) / 5.0) + F.hypot("__e2", "__n2") * hours * hours * 0.15)
        return F.struct(minute.alias("minute"), east.alias("east"), north.alias("north"), centre.alias("centre"), unsure.alias("unsure"))

    def sample(at: Column) -> Column:
        of_rings = F.array_min(F.transform("__rings", lambda sides: sides_distance(sides, at["east"], at["north"])))
        edge = F.when(has_rings, F.least(of_rings, F.when(at["minute"] == 0, c("distance")))).otherwise(F.greatest(F.lit(0.0), at["centre"] - reach))
        return F.struct(edge.alias("edge"), *(at[v].alias(v) for v in ("minute", "centre", "unsure")))

    samples = F.when(c("__moves"), F.transform(F.transform(F.sequence(F.lit(0), F.lit(HORIZON)), place), sample))
    rows = rows.withColumn("__s", samples)
    first = lambda kept: F.get(F.filter("__s", kept), F.lit(0))["minute"]
    bearing = F.radians(geo.bearing(c("s_lat"), c("s_lon"), c("t_lat"), c("t_lon")))
    rows = rows.withColumns({
        "__approach": F.when(c("__moves"), c("__e") * F.sin(bearing) + c("__n") * F.cos(bearing)),
        "__hit": first(lambda s: s["edge"] <= HIT_KM), "__near": first(lambda s: s["edge"] <= s["unsure"]),
        "__by_edge": F.array_min("__s"), "__by_centre": F.array_min(F.transform("__s", lambda s: F.struct(s["centre"].alias("centre"), s["minute"].alias("minute")))),
    })
    sure = c("__moves") & c("confidence").isin(*UNSURE_KM)
    told = sure & ((c("__approach") > 1) | c("__hit").isNotNull() | c("__near").isNotNull())
    # a storm without footprints on a straight track passes as its great circle does
    straight = told & ~has_rings & ~c("model").eqNullSafe(F.lit("constant_acceleration"))
    angle = F.radians(F.abs(F.pmod(c("heading") - F.degrees(bearing) + 180, F.lit(360.0)) - 180))
    edge, unsure = c("__by_edge.edge"), c("__by_edge.unsure")
    out = rows.withColumns({
        "approach_speed": F.round("__approach", 1), "moving_towards": c("__approach") > 1,
        "eta_minutes": F.when(sure, F.coalesce("__hit", "__near")).cast("double"), "eta_basis": F.when(sure & c("__hit").isNotNull(), "radarcontour").when(sure & c("__near").isNotNull(), "onzekerheidscorridor"),
        "closest_pass_km": F.round(F.when(straight, c("__centre") * F.abs(F.sin(angle))).when(told, c("__by_centre.centre")), 1),
        "closest_pass_minutes": F.round(F.when(straight, c("__centre") * F.cos(angle) / c("speed") * 60).when(told, c("__by_centre.minute")), 0),
        "footprint_pass_km": F.round(F.when(told, edge), 1), "footprint_pass_minutes": F.when(told, c("__by_edge.minute")).cast("double"),
        "passage": F.when(told, F.when(edge <= HIT_KM, "raak").when(edge <= unsure, "rand").otherwise("mist")), "unsure_km": F.round(F.when(told, unsure), 1),
    })
    return out.drop("__centre", "__moves", "__e", "__n", "__e2", "__n2", "__rings", "__s", "__approach", "__hit", "__near", "__by_edge", "__by_centre")


def straight_motion(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The least squares track of each storm's frames (frame_s, lat, lon) of the last hour, at each frame; the frames are few, so each is sent to the hour behind it."""
    hour = F.sequence(F.col("frame_s"), F.col("frame_s") + HISTORY_S, F.lit(300).cast("long"))
    spread = frames.select(*keys, F.col("frame_s").alias("t"), "lat", "lon", F.explode(hour).alias("frame_s"))
    now = frames.select(*keys, "frame_s", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    history = spread.join(now, [*keys, "frame_s"])
    x, y = (F.col("lon") - F.col("s_lon")) * geo.KM_EAST * F.greatest(F.lit(0.05), F.cos(F.radians("s_lat"))), (F.col("lat") - F.col("s_lat")) * geo.KM_NORTH
    history = history.withColumns({"__h": (F.col("t") - F.col("frame_s")) / 3600.0, "__x": x, "__y": y})
    h, many = F.col("__h"), F.count(F.lit(1)) > 1
    left = lambda v: F.greatest(F.lit(0.0), F.regr_syy(v, h) - F.regr_sxy(v, h) * F.regr_sxy(v, h) / F.nullif(F.regr_sxx(v, h), F.lit(0.0)))
    quality = lambda v: F.when(F.regr_syy(v, h) > 1e-12, F.greatest(F.lit(0.0), 1 - left(v) / F.nullif(F.regr_syy(v, h), F.lit(0.0)))).otherwise(1.0)
    out = history.groupBy(*keys, "frame_s", "s_lat", "s_lon").agg(
        F.when(many, F.regr_slope("__x", h)).alias("east"), F.when(many, F.regr_slope("__y", h)).alias("north"), F.count(F.lit(1)).cast("int").alias("points"),
        ((F.max("t") - F.min("t")) / 60.0).alias("minutes"), F.round((quality("__x") + quality("__y")) / 2, 3).alias("fit"), F.round(F.sqrt((left("__x") + left("__y")) / F.count(F.lit(1))), 3).alias("error_km"),
    )
    speed = F.hypot("east", "north")
    shown = (F.col("points") >= 4) & (speed <= 150)
    out = out.withColumn("speed", F.when(shown, speed)).withColumn("heading", F.when(shown & (speed >= 0.5), F.pmod(F.degrees(F.atan2("east", "north")), F.lit(360.0))))
    tier = rules.motion_confidence(F.col("points"), F.col("minutes"), F.col("heading"), F.col("speed"), F.col("fit"), F.col("error_km"))
    return out.withColumns({"confidence": tier, "model": F.lit("linear"), "east2": F.lit(0.0), "north2": F.lit(0.0)})


def cells_of(radar: DataFrame) -> DataFrame:
    """The cell that each source sees of a storm in a frame: its newest time, strongest echo, footprint, the hull of its points, and the places where its sides start."""
    keys = ["blob", "frame_s", "source"]
    summed = radar.groupBy(*keys).agg(F.max("sim_s").alias("cell_s"), F.max("dbz").alias("dbz"))
    return summed.join(hulls(radar, keys, "lat", "lon", starts=True), keys)


def targets_of_storms(spark, sf_dir) -> DataFrame:
    """Each storm of each frame with each target: motion, footprints of the newest minute, distance to the nearest corner and how it passes.

    Targets are a literal of a few rows, sent along as an array.
    """
    radar = observations(spark, sf_dir, "radar").select("blob", "frame_s", "source", "sim_s", "dbz", "lat", "lon")
    frames = radar.groupBy("blob", "frame_s").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    cells = cells_of(radar).groupBy("blob", "frame_s").agg(F.max("cell_s").alias("newest"), F.collect_list(F.struct("cell_s", "dbz", "ring", "starts")).alias("cells"))
    storms = straight_motion(frames, ["blob"]).join(cells, ["blob", "frame_s"])
    newest = F.filter("cells", lambda x: x["cell_s"] >= F.col("newest") - NEWEST_S)
    storms = storms.withColumns({
        "rings": F.transform(newest, lambda x: x["ring"]), "starts": F.flatten(F.transform(newest, lambda x: x["starts"])), "max_dbz": F.array_max(F.transform("cells", lambda x: x["dbz"])), "status": F.when(F.col("points") >= 2, "bevestigd").otherwise("waargenomen"),
    })
    places = targets(spark).agg(F.collect_list(F.struct("target_id", "t_lat", "t_lon")).alias("places"))
    rows = storms.drop("cells").join(F.broadcast(places)).select("*", F.inline("places")).drop("places")  # one row of literals
    rows = rows.withColumn("distance", F.array_min(F.transform("starts", lambda p: haversine(F.col("t_lat"), F.col("t_lon"), p["lat"], p["lon"])))).drop("starts")
    return motion_to_target(rows)


PASSAGE = ["approach_speed", "moving_towards", "eta_minutes", "eta_basis", "closest_pass_km", "closest_pass_minutes", "footprint_pass_km", "footprint_pass_minutes", "passage", "unsure_km"]


def passages(spark, sf_dir):
    return targets_of_storms(spark, sf_dir).select("target_id", "blob", "frame_s", F.round("distance", 3).alias("distance"), "confidence", "bearing_to_target", *PASSAGE)


def target_statuses(storms: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each target: that of the system that matters most to it, and the nearest precipitation, which may be another's.

    storms: rows of ``motion_to_target`` with blob, frame counts (points) and max_dbz. Keys name a target and a moment; both choices are minima, so
    nothing but the two best rows of a task is shuffled for a key.
    """
    rank = rules.candidate_rank(F.col("status"), F.col("distance"), F.col("passage"), F.col("closest_pass_minutes"), F.col("approach_speed"))
    kept = F.struct("blob", "distance", "status", "confidence", "points", "max_dbz", "approach_speed", "eta_minutes", "closest_pass_minutes", "passage")
    best = storms.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), "blob", kept.alias("s"))).alias("b"), F.min(F.struct("distance", "blob", "max_dbz")).alias("near"), F.count(F.lit(1)).alias("systems"))
    s = lambda c: F.col(f"b.s.{c}")
    sure = (s("status") == "bevestigd") & s("confidence").isin(*UNSURE_KM)
    meets = s("eta_minutes").isNotNull() & s("passage").isin("raak", "rand") & s("closest_pass_minutes").between(0, HORIZON)
    towards = F.when(F.coalesce(meets, F.lit(False)) | (s("approach_speed") > 1), "naderend").when(s("approach_speed") < -1, "wegtrekkend").when(s("approach_speed").isNotNull(), "langs_trekkend")
    seen = F.when(s("status") == "bevestigd", "bevestigd").otherwise("waargenomen")
    block = rules.forecast_block(s("status"), s("confidence"), s("closest_pass_minutes"), s("passage"), s("max_dbz"))
    status = F.coalesce(F.when(sure, towards), seen)
    reliable = sure & s("eta_minutes").isNotNull()
    return best.select(
        *keys, "systems", status.alias("status"), F.col("b.rank.relevance").alias("reason"), F.col("b.blob").alias("tracked"), F.col("near.blob").alias("nearest"),
        F.when(F.col("near.blob") == F.col("b.blob"), "zelfde_systeem").otherwise("verschillende_systemen").alias("relation"),
        F.round("near.distance", 1).alias("nearest_km"), F.round("near.max_dbz", 1).alias("nearest_dbz"), F.round(s("distance"), 1).alias("tracked_km"), s("eta_minutes").alias("eta_minutes"),
        F.coalesce(reliable, F.lit(False)).alias("eta_reliable"), block.alias("block"),
        F.when(block.isNull(), rules.forecast_confidence(s("confidence"), s("points"), s("closest_pass_minutes"))).alias("confidence"), rules.warning_stage(status, F.coalesce(reliable, F.lit(False)), s("passage"), s("eta_minutes")).alias("stage"),
    )


def statuses(spark, sf_dir):
    return target_statuses(targets_of_storms(spark, sf_dir), ["target_id", "frame_s"])


def geometry(spark, sf_dir):
    """Hull, box and radius of each storm and frame from its strikes of fifteen minutes and its cells of the frame."""
    rows = observations(spark, sf_dir).where("kind <> 'rain'").select("blob", "kind", "frame_s", "lat", "lon")
    later = F.when(F.col("kind") == "lightning", F.sequence(F.col("frame_s"), F.col("frame_s") + (STRIKE_S - 300), F.lit(300).cast("long"))).otherwise(F.array("frame_s"))
    points = rows.select("blob", "kind", F.explode(later).alias("frame_s"), "lat", "lon")
    keys = ["blob", "frame_s"]
    centres = points.groupBy(*keys).agg(
        F.avg(F.when(F.col("kind") == "radar", F.col("lat"))).alias("s_lat"), F.avg(F.when(F.col("kind") == "radar", F.col("lon"))).alias("s_lon"), F.count(F.lit(1)).alias("points"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
    ).where("s_lat IS NOT NULL")
    shaped = centres.join(hulls(points, keys, "lat", "lon"), keys)
    radius = F.when(F.col("points") >= 3, hull_radius(F.col("ring"), F.col("s_lat"), F.col("s_lon"), geo.haversine)).otherwise(0.0)
    return shaped.select(*keys, "points", F.round(radius, 3).alias("radius_km"), "south", "north", "west", "east")


#: Corners of a hull are the ends of its sides, those pairs of points that have all others to their left. Least squares by sums; storms and targets in one list.
_TRACKS_SQL = OBS_SQL + f"""
, radar AS (SELECT blob, frame_s, source, sim_s, dbz, lat, lon FROM obs WHERE kind = 'radar'),
frames AS (SELECT blob, frame_s, avg(lat) AS lat, avg(lon) AS lon FROM radar GROUP BY 1, 2),
history AS (
    SELECT n.blob, n.frame_s, n.lat AS s_lat, n.lon AS s_lon, h.frame_s AS t, (h.frame_s - n.frame_s) / 3600.0e0 AS h,
        (h.lon - n.lon) * {geo.KM_EAST}e0 * greatest(0.05e0, cos(radians(n.lat))) AS x, (h.lat - n.lat) * {geo.KM_NORTH}e0 AS y
    FROM frames n JOIN frames h ON h.blob = n.blob AND h.frame_s BETWEEN n.frame_s - {HISTORY_S} AND n.frame_s
),
sums AS (
    SELECT blob, frame_s, s_lat, s_lon, CASE WHEN count(*) > 1 THEN regr_slope(x, h) END AS east, CASE WHEN count(*) > 1 THEN regr_slope(y, h) END AS north,
        count(*) AS points, (max(t) - min(t)) / 60.0e0 AS minutes, regr_syy(x, h) AS sx, regr_syy(y, h) AS sy,
        greatest(0, regr_syy(x, h) - regr_sxy(x, h) * regr_sxy(x, h) / nullif(regr_sxx(x, h), 0)) AS lx, greatest(0, regr_syy(y, h) - regr_sxy(y, h) * regr_sxy(y, h) / nullif(regr_sxx(y, h), 0)) AS ly
    FROM history GROUP BY 1, 2, 3, 4
),
moving AS (
    SELECT *, hypot_km AS v, round((CASE WHEN sx > 1e-12 THEN greatest(0, 1 - lx / sx) ELSE 1 END + CASE WHEN sy > 1e-12 THEN greatest(0, 1 - ly / sy) ELSE 1 END) / 2, 3) AS fit,
        round(sqrt((lx + ly) / points), 3) AS error_km
    FROM (SELECT *, sqrt(east * east + north * north) AS hypot_km FROM sums)
),
tracked AS (
    SELECT *, CASE WHEN points >= 4 AND v <= 150 THEN v END AS speed, CASE WHEN points >= 4 AND v <= 150 AND v >= 0.5 THEN (degrees(atan2(east, north)) + 360) % 360 END AS heading FROM moving
),
storms AS (
    SELECT *, CASE WHEN heading IS NULL OR points < 4 OR minutes < 5 THEN 'Onvoldoende data'
        WHEN points >= 6 AND minutes >= 15 AND fit >= 0.80 AND coalesce(error_km, 1e9) <= 3.0 AND coalesce(speed > 1, false) THEN 'Hoog'
        WHEN minutes >= 10 AND fit >= 0.55 AND coalesce(error_km, 1e9) <= 8.0 THEN 'Matig' ELSE 'Laag' END AS confidence,
        CASE WHEN points >= 2 THEN 'bevestigd' ELSE 'waargenomen' END AS status FROM tracked
),
top AS (SELECT blob, frame_s, max(sim_s) AS newest, max(dbz) AS max_dbz FROM radar GROUP BY 1, 2),
fresh AS (SELECT blob, frame_s, source FROM radar JOIN top USING (blob, frame_s) GROUP BY blob, frame_s, source, newest HAVING max(sim_s) >= newest - {NEWEST_S}),
pts AS (SELECT DISTINCT blob, frame_s, source, lat, lon FROM radar SEMI JOIN fresh USING (blob, frame_s, source)),
crossed AS (
    SELECT a.blob, a.frame_s, a.source, a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2, min((b.lon - a.lon) * (k.lat - a.lat) - (b.lat - a.lat) * (k.lon - a.lon)) AS least,
        max((b.lon - a.lon) * (k.lat - a.lat) - (b.lat - a.lat) * (k.lon - a.lon)) AS most
    FROM pts a JOIN pts b USING (blob, frame_s, source) JOIN pts k USING (blob, frame_s, source) GROUP BY ALL
),
flat AS (SELECT blob, frame_s, source, max(most) <= 0 AS flat FROM crossed GROUP BY 1, 2, 3),
sides AS (SELECT c.*, flat FROM crossed c JOIN flat USING (blob, frame_s, source) WHERE flat OR (least >= 0 AND most > 0)),
near AS (
    SELECT blob, frame_s, target_id, t_lat, t_lon, min({geo.haversine_sql('t_lat', 't_lon', 'y1', 'x1', RADIUS)}) AS distance FROM sides, targets GROUP BY ALL
),
pairs AS (
    SELECT s.*, n.target_id, n.t_lat, n.t_lon, n.distance, t.max_dbz, ((degrees(atan2(sin(radians(t_lon - s_lon)) * cos(radians(t_lat)),
        cos(radians(s_lat)) * sin(radians(t_lat)) - sin(radians(s_lat)) * cos(radians(t_lat)) * cos(radians(t_lon - s_lon)))) + 360) % 360 + 360) % 360 AS b
    FROM storms s JOIN near n USING (blob, frame_s) JOIN top t USING (blob, frame_s)
),
moved AS (
    SELECT p.blob, p.frame_s, p.target_id, m, (x1 - t_lon) * {geo.KM_EAST}e0 * cos(radians(t_lat)) + east * m / 60 AS x, (y1 - t_lat) * {geo.KM_NORTH}e0 + north * m / 60 AS y,
        (x2 - x1) * {geo.KM_EAST}e0 * cos(radians(t_lat)) AS dx, (y2 - y1) * {geo.KM_NORTH}e0 AS dy, d.source, flat
    FROM pairs p JOIN sides d USING (blob, frame_s), range(0, {HORIZON + 1}) r(m) WHERE heading IS NOT NULL AND speed > 0 AND status = 'bevestigd'
),
spaced AS (
    SELECT blob, frame_s, target_id, m, source, flat, x * dy - y * dx AS turn,
        sqrt(pow(x + f * dx, 2) + pow(y + f * dy, 2)) AS d
    FROM (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, -(x * dx + y * dy) / (dx * dx + dy * dy))) END AS f FROM moved)
),
rings AS (SELECT blob, frame_s, target_id, m, source, CASE WHEN NOT bool_or(flat) AND min(turn) > 0 THEN 0 ELSE min(d) END AS edge FROM spaced GROUP BY ALL),
samples AS (
    SELECT r.blob, r.frame_s, r.target_id, r.m, CASE WHEN m = 0 THEN least(min(edge), p.distance) ELSE min(edge) END AS edge,
        least({MOST_UNSURE_KM}e0, CASE confidence WHEN 'Hoog' THEN 4e0 WHEN 'Matig' THEN 8e0 ELSE 15e0 END + greatest({LEAST_ERROR_KM}e0, coalesce(error_km, 0)) * sqrt(greatest(m, 1) / 5.0e0)) AS unsure,
        {geo.haversine_sql(f'(s_lat + north * m / 60 / {geo.KM_NORTH}e0)', f'(s_lon + east * m / 60 / ({geo.KM_EAST}e0 * greatest(0.05e0, cos(radians(s_lat)))))', 't_lat', 't_lon', RADIUS)} AS centre
    FROM rings r JOIN pairs p USING (blob, frame_s, target_id) GROUP BY r.blob, r.frame_s, r.target_id, r.m, p.distance, confidence, error_km, s_lat, s_lon, t_lat, t_lon, north, east
),
best AS (
    SELECT blob, frame_s, target_id, min(m) FILTER (edge <= {HIT_KM}) AS hit, min(m) FILTER (edge <= unsure) AS nearby, min((edge, m, unsure)) AS by_edge, min((centre, m)) AS by_centre
    FROM samples GROUP BY 1, 2, 3
),
told AS (
    SELECT p.*, CASE WHEN k.by_edge IS NOT NULL THEN east * sin(radians(b)) + north * cos(radians(b)) END AS v_to, hit, nearby, by_edge, by_centre,
        k.by_edge IS NOT NULL AND confidence IN ('Hoog', 'Matig') AS sure FROM pairs p LEFT JOIN best k USING (blob, frame_s, target_id)
),
passing AS (
    SELECT target_id, blob, frame_s, distance, confidence, status, points, max_dbz, round(b, 1) AS bearing_to_target, round(v_to, 1) + 0.0e0 AS approach_speed, v_to > 1 AS moving_towards,
        CAST(CASE WHEN sure THEN coalesce(hit, nearby) END AS DOUBLE) AS eta_minutes, CASE WHEN sure AND hit IS NOT NULL THEN 'radarcontour' WHEN sure AND nearby IS NOT NULL THEN 'onzekerheidscorridor' END AS eta_basis,
        CASE WHEN shown THEN round(by_centre[1], 1) END AS closest_pass_km, CAST(CASE WHEN shown THEN by_centre[2] END AS DOUBLE) AS closest_pass_minutes,
        CASE WHEN shown THEN round(by_edge[1], 1) END AS footprint_pass_km, CAST(CASE WHEN shown THEN by_edge[2] END AS DOUBLE) AS footprint_pass_minutes,
        CASE WHEN shown THEN CASE WHEN by_edge[1] <= {HIT_KM} THEN 'raak' WHEN by_edge[1] <= by_edge[3] THEN 'rand' ELSE 'mist' END END AS passage, CASE WHEN shown THEN round(by_edge[3], 1) END AS unsure_km
    FROM (SELECT *, sure AND (v_to > 1 OR hit IS NOT NULL OR nearby IS NOT NULL) AS shown FROM told)
)
"""

QUERIES["SC6_N2_passages"] = passages
ORACLES["SC6_N2_passages"] = _TRACKS_SQL + f" SELECT target_id, blob, frame_s, round(distance, 3) AS distance, confidence, bearing_to_target, {', '.join(PASSAGE)} FROM passing"

QUERIES["N5_target_statuses"] = statuses
ORACLES["N5_target_statuses"] = _TRACKS_SQL + """
, ranked AS (
    SELECT *, coalesce(closest_pass_minutes BETWEEN 0 AND 90, false) AS ahead FROM passing
),
ordered AS (
    SELECT *, CASE WHEN status <> 'bevestigd' THEN 1 ELSE 0 END AS c1, CASE WHEN status <> 'bevestigd' THEN 8 WHEN distance <= 5 THEN 0 WHEN ahead AND passage = 'raak' THEN 1 WHEN ahead AND passage = 'rand' THEN 2
        WHEN approach_speed > 1 AND ahead AND passage IS DISTINCT FROM 'mist' THEN 3 WHEN approach_speed > 1 THEN 4 WHEN abs(approach_speed) <= 1 THEN 5 WHEN approach_speed < -1 THEN 6 ELSE 7 END AS c2 FROM ranked
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY target_id, frame_s ORDER BY c1, c2, CASE WHEN c2 IN (1, 2, 3) THEN closest_pass_minutes ELSE 0 END, distance, blob) AS place,
        count(*) OVER (PARTITION BY target_id, frame_s) AS systems, min((distance, blob, max_dbz)) OVER (PARTITION BY target_id, frame_s) AS near FROM ordered
),
chosen AS (
    SELECT *, status = 'bevestigd' AND confidence IN ('Hoog', 'Matig') AS sure, coalesce(eta_minutes IS NOT NULL AND passage IN ('raak', 'rand') AND ahead, false) AS meets,
        CASE WHEN status <> 'bevestigd' THEN 'systeem_nog_niet_bevestigd' WHEN confidence NOT IN ('Hoog', 'Matig') THEN 'bewegingsvector_onvoldoende_betrouwbaar'
            WHEN closest_pass_minutes IS NULL OR passage IS NULL THEN 'passage_nog_niet_berekenbaar' WHEN passage = 'mist' THEN 'geen_passage_binnen_corridor'
            WHEN closest_pass_minutes < 0 OR closest_pass_minutes > 90 THEN 'buiten_prognosehorizon' WHEN max_dbz IS NULL THEN 'intensiteit_onbekend' END AS block FROM placed WHERE place = 1
),
named AS (
    SELECT *, CASE WHEN sure AND (meets OR approach_speed > 1) THEN 'naderend' WHEN sure AND approach_speed < -1 THEN 'wegtrekkend' WHEN sure AND approach_speed IS NOT NULL THEN 'langs_trekkend' ELSE status END AS state FROM chosen
)
SELECT target_id, frame_s, systems, state AS status, (['current_precipitation', 'forecast_hit', 'forecast_edge', 'approaching', 'approaching', 'lateral', 'moving_away', 'confirmed', 'observed'])[c2 + 1] AS reason,
    blob AS tracked, near[2] AS nearest, CASE WHEN near[2] = blob THEN 'zelfde_systeem' ELSE 'verschillende_systemen' END AS relation, round(near[1], 1) AS nearest_km, round(near[3], 1) AS nearest_dbz,
    round(distance, 1) AS tracked_km, eta_minutes, sure AND eta_minutes IS NOT NULL AS eta_reliable, block,
    CASE WHEN block IS NULL THEN CAST(greatest(25, least(95, CASE WHEN confidence = 'Hoog' THEN 82 ELSE 64 END + least(10, greatest(0, points - 2) * 3) - round_even(closest_pass_minutes / 90.0e0 * 24, 0))) AS INT) END AS confidence,
    CASE WHEN state = 'naderend' AND sure AND eta_minutes IS NOT NULL AND passage IN ('raak', 'rand') THEN CASE WHEN eta_minutes <= 15 THEN 'imminent' WHEN eta_minutes <= 45 THEN 'dichtbij' WHEN eta_minutes <= 90 THEN 'vroeg' END END AS stage
FROM named
"""

QUERIES["SC7_SC8_G1_geometry"] = geometry
ORACLES["SC7_SC8_G1_geometry"] = OBS_SQL + f"""
, pts AS (
    SELECT blob, kind, frame_s, lat, lon FROM obs WHERE kind = 'radar'
    UNION ALL
    SELECT blob, kind, frame_s + i * 300, lat, lon FROM obs, range(0, {STRIKE_S // 300}) r(i) WHERE kind = 'lightning'
),
centres AS (
    SELECT blob, frame_s, avg(lat) FILTER (kind = 'radar') AS s_lat, avg(lon) FILTER (kind = 'radar') AS s_lon, count(*) AS points, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM pts GROUP BY 1, 2
),
spots AS (SELECT DISTINCT blob, frame_s, lat, lon FROM pts),
crossed AS (
    SELECT a.blob, a.frame_s, a.lat, a.lon, b.lat AS y2, b.lon AS x2, min((b.lon - a.lon) * (k.lat - a.lat) - (b.lat - a.lat) * (k.lon - a.lon)) AS least,
        max((b.lon - a.lon) * (k.lat - a.lat) - (b.lat - a.lat) * (k.lon - a.lon)) AS most
    FROM spots a JOIN spots b USING (blob, frame_s) JOIN spots k USING (blob, frame_s) GROUP BY ALL
),
corners AS (SELECT DISTINCT blob, frame_s, lat, lon FROM crossed WHERE least >= 0 AND most > 0),
few AS (SELECT blob, frame_s, lat, lon FROM spots s WHERE (SELECT count(*) FROM spots t WHERE t.blob = s.blob AND t.frame_s = s.frame_s) <= 2),
every AS (SELECT * FROM corners UNION SELECT * FROM few)
SELECT blob, frame_s, points, round(CASE WHEN points >= 3 THEN max({geo.haversine_sql('s_lat', 's_lon', 'lat', 'lon')}) ELSE 0 END, 3) AS radius_km, south, north, west, east
FROM centres JOIN every USING (blob, frame_s) WHERE s_lat IS NOT NULL GROUP BY blob, frame_s, points, south, north, west, east
"""
