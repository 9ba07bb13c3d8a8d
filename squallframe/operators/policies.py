"""Statuses, ranks, source choices and tables for maps and sensors, made from observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from squallframe.functions import geo, rules
from squallframe.operators.observing import AS_OF, in_regions, query
from squallframe.sources.observations import REGIONS, observations, regions, targets

#: The sources of the observations as the rules name them.
SOURCE_NAMES = {"nat": "national", "comp": "opera", "tile": "rainviewer"}

STORMS_SQL = """, storms AS (
    SELECT blob, CAST(frame_s AS BIGINT) AS frame_s, round(avg(lat), 6) AS s_lat, round(avg(lon), 6) AS s_lon, count(*) AS cells, max(dbz) AS max_dbz, max(sim_s) AS last_s
    FROM obs WHERE kind = 'radar' GROUP BY blob, frame_s
)
"""


def storms(spark, sf_dir):
    """A storm of each blob and frame: centre, cells, strongest cell and time of the last one."""
    radar = observations(spark, sf_dir, "radar")
    return radar.groupBy("blob", "frame_s").agg(
        F.round(F.avg("lat"), 6).alias("s_lat"), F.round(F.avg("lon"), 6).alias("s_lon"), F.count(F.lit(1)).alias("cells"), F.max("dbz").alias("max_dbz"), F.max("sim_s").alias("last_s"),
    )


def haversine(a: str, b: str, c: str, d: str):
    return geo.haversine(F.col(a), F.col(b), F.col(c), F.col(d))


@query("SC2_SC4_SC5_geodesy", """
SELECT blob, round(avg(((degrees(atan2((5.2e0 - lon) * cos(radians(lat)), 51.3e0 - lat)) % 360) + 360) % 360), 5) AS mean_bearing,
    round(avg(degrees(asin(sin(radians(lat)) * cos(10 / 6371e0) + cos(radians(lat)) * sin(10 / 6371e0) * cos(radians(30.0e0))))), 6) AS mean_lat_after,
    round(avg((lon - 5.2e0) * 111.32e0 * cos(radians(51.3e0))), 5) AS mean_east, round(avg((lat - 51.3e0) * 110.574e0), 5) AS mean_north
FROM obs GROUP BY blob
""")
def geodesy(spark, sf_dir):
    lat, lon, lat0, lon0 = F.col("lat"), F.col("lon"), F.lit(51.3), F.lit(5.2)
    east, north = geo.local_km(lat, lon, lat0, lon0)
    return observations(spark, sf_dir).groupBy("blob").agg(
        F.round(F.avg(geo.planar_bearing(lat, lon, lat0, lon0)), 5).alias("mean_bearing"),
        F.round(F.avg(geo.destination(lat, lon, F.lit(30.0), F.lit(10.0))["lat"]), 6).alias("mean_lat_after"),
        F.round(F.avg(east), 5).alias("mean_east"), F.round(F.avg(north), 5).alias("mean_north"),
    )


@query("SC10_tiles", """
SELECT CAST(floor((lon + 180) / 360 * 128) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 128) AS BIGINT) AS y, count(*) AS n
FROM obs WHERE kind = 'radar' GROUP BY 1, 2
""")
def tiles(spark, sf_dir):
    x, y = geo.tile(F.col("lat"), F.col("lon"), 7)
    return observations(spark, sf_dir, "radar").groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SC14_SC15_dbz_levels", """
SELECT CAST(CASE WHEN dbz < 15 THEN 1 WHEN dbz < 20 THEN 2 WHEN dbz < 25 THEN 3 WHEN dbz < 30 THEN 4 WHEN dbz < 35 THEN 5 WHEN dbz < 40 THEN 6 WHEN dbz < 50 THEN 7 ELSE 8 END AS INT) AS overlay_level,
    CASE WHEN dbz < 20 THEN 'zeer licht' WHEN dbz < 30 THEN 'licht' WHEN dbz < 40 THEN 'matig' WHEN dbz < 50 THEN 'zwaar' ELSE 'zeer zwaar' END AS label, count(*) AS n
FROM obs WHERE kind = 'radar' GROUP BY 1, 2
""")
def dbz_levels(spark, sf_dir):
    return observations(spark, sf_dir, "radar").groupBy(geo.overlay_level(F.col("dbz")).alias("overlay_level"), geo.dbz_name(F.col("dbz")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SC19_SC22_X16_state_texts", """
SELECT CASE WHEN t IN ('unknown', 'none', '') THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS number, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, iso, count(*) AS n
FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE CAST(intensity AS VARCHAR) END AS t, source || ' - ' || kind || '!' AS name,
    strftime(make_timestamp(frame_s * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM obs) GROUP BY 1, 2, 3
""")
def state_texts(spark, sf_dir):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE CAST(intensity AS STRING) END")
    name = F.concat("source", F.lit(" - "), "kind", F.lit("!"))
    iso = F.date_format(F.timestamp_seconds("frame_s"), "yyyy-MM-dd'T'HH:mm:ss")
    return observations(spark, sf_dir).groupBy(rules.numeric_state(text).alias("number"), rules.slug(name).alias("slug"), iso.alias("iso")).agg(F.count(F.lit(1)).alias("n"))


@query("F2_F4_F10_F12_boxes", f"""
SELECT count(*) FILTER (lat BETWEEN 50.5 AND 51.5 AND lon BETWEEN 4.5 AND 5.5) AS in_box, count(*) AS all_without_box,
    count(*) FILTER (abs(lat - 51.0) <= 60 / 110.574e0 AND {geo.haversine_sql('lat', 'lon', '51.0e0', '5.0e0')} <= 60) AS in_circle, count(*) FILTER (NOT (source = 'nat' AND intensity < 2)) AS usable
FROM obs WHERE kind = 'radar'
""")
def boxes(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    circle = (F.abs(lat - 51.0) <= 60 / geo.KM_NORTH) & (geo.haversine(lat, lon, F.lit(51.0), F.lit(5.0)) <= 60)
    return observations(spark, sf_dir, "radar").agg(
        F.count_if(lat.between(50.5, 51.5) & lon.between(4.5, 5.5)).alias("in_box"), F.count(F.lit(1)).alias("all_without_box"),
        F.count_if(circle).alias("in_circle"), F.count_if(~((F.col("source") == "nat") & (F.col("intensity") < 2))).alias("usable"),
    )


@query("F7_active_cells", """
SELECT source, count(*) AS n FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) ELSE source || ':' || event_id END AS cell FROM obs WHERE kind = 'radar')
WHERE position(':' IN cell) = 0 OR split_part(cell, ':', 1) = 'comp' GROUP BY 1
""")
def active_cells(spark, sf_dir):
    cell = F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string")).otherwise(F.concat("source", F.lit(":"), "event_id"))
    rows = observations(spark, sf_dir, "radar").withColumn("cell", cell)
    return rows.where(~F.col("cell").contains(":") | (F.substring_index("cell", ":", 1) == "comp")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("J2_D1_selected_source", f"""
, seen AS (SELECT r.region_id, CAST(sim_s // 3600 AS BIGINT) AS hour, o.source, max(sim_s) AS last_s, count(*) AS n FROM obs o JOIN regions r ON {geo.haversine_sql('o.lat', 'o.lon', 'r.c_lat', 'r.c_lon')} <= r.radius_km WHERE o.kind = 'radar' GROUP BY 1, 2, 3),
healthy AS (SELECT * FROM seen WHERE hour * 3600 + 3600 - last_s <= {60 * rules.HEALTHY_MINUTES['national']}),
decision AS (
    SELECT region_id, hour, coalesce(max(source) FILTER (source = 'nat'), max(source) FILTER (source = 'comp'), max(source) FILTER (source = 'tile')) AS source FROM healthy GROUP BY 1, 2
)
SELECT region_id, hour, source, n FROM seen JOIN decision USING (region_id, hour, source)
""")
def selected_source(spark, sf_dir):
    """Rows of each region and hour of the source that is chosen for them: the national one if its last product is young enough at the hour's end, else a healthy fallback."""
    radar = in_regions(observations(spark, sf_dir, "radar"), spark)
    seen = radar.groupBy("region_id", F.expr("sim_s DIV 3600").alias("hour"), "source").agg(F.max("sim_s").alias("last_s"), F.count(F.lit(1)).alias("n"))
    name = F.create_map(*[F.lit(v) for pair in SOURCE_NAMES.items() for v in pair])[F.col("source")]
    young = F.col("hour") * 3600 + 3600 - F.col("last_s") <= 60 * rules.HEALTHY_MINUTES["national"]
    each = seen.groupBy("region_id", "hour").agg(F.collect_list(F.when(young, name)).alias("healthy"), F.collect_list(F.struct(name.alias("name"), "source", "n")).alias("rows"))
    chosen = each.withColumn("chosen", rules.chosen_source(F.array(F.lit(SOURCE_NAMES["nat"])), F.col("healthy")))
    return chosen.select("region_id", "hour", "chosen", F.inline("rows")).where("name = chosen").select("region_id", "hour", "source", "n")


@query("J18_O2_N3_candidates", f"""{STORMS_SQL}
, pairs AS (
    SELECT target_id, blob, frame_s, round({geo.haversine_sql('s_lat', 's_lon', 't_lat', 't_lon')}, 4) AS distance, cells, max_dbz - 40 AS approach,
        CASE WHEN blob % 2 = 0 THEN 'raak' ELSE 'mist' END AS passage, CAST(blob * 35 AS DOUBLE) AS minutes FROM storms, targets
), ranked AS (
    SELECT *, CASE WHEN cells < 3 THEN 1 ELSE 0 END AS c1,
        CASE WHEN cells < 3 THEN 8 WHEN distance <= 5 THEN 0 WHEN minutes <= 90 AND passage = 'raak' THEN 1 WHEN approach > 1 AND minutes <= 90 AND passage <> 'mist' THEN 3
            WHEN approach > 1 THEN 4 WHEN abs(approach) <= 1 THEN 5 WHEN approach < -1 THEN 6 ELSE 7 END AS c2 FROM pairs
)
SELECT target_id, frame_s, blob, CAST(c1 AS INT) AS c1, CAST(c2 AS INT) AS c2, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY target_id, frame_s ORDER BY c1, c2, CASE WHEN c2 IN (1, 3) THEN minutes ELSE 0 END, distance, blob) AS place FROM ranked) WHERE place = 1
""")
def candidates(spark, sf_dir):
    """The storm that matters most to each target in each frame. Targets are a literal of a few rows, sent along as one array."""
    places = targets(spark).agg(F.collect_list(F.struct("target_id", "t_lat", "t_lon")).alias("places"))
    pairs = storms(spark, sf_dir).join(F.broadcast(places)).select("*", F.inline("places")).drop("places")
    status = F.when(F.col("cells") < 3, "waargenomen").otherwise("bevestigd")
    passage = F.when(F.col("blob") % 2 == 0, "raak").otherwise("mist")
    pairs = pairs.withColumn("distance", F.round(haversine("s_lat", "s_lon", "t_lat", "t_lon"), 4))
    rank = rules.candidate_rank(status, F.col("distance"), passage, (F.col("blob") * 35).cast("double"), F.col("max_dbz") - 40)
    best = pairs.groupBy("target_id", "frame_s").agg(F.min(F.struct(rank.alias("rank"), "blob")).alias("best"))
    return best.select("target_id", "frame_s", "best.blob", "best.rank.c1", "best.rank.c2", "best.rank.distance")


@query("J19_near_storms", f"""{STORMS_SQL}
SELECT a.frame_s, a.blob AS a, b.blob AS b, round({geo.haversine_sql('a.s_lat', 'a.s_lon', 'b.s_lat', 'b.s_lon')}, 4) AS km FROM storms a JOIN storms b ON a.frame_s = b.frame_s AND a.blob < b.blob
WHERE {geo.haversine_sql('a.s_lat', 'a.s_lon', 'b.s_lat', 'b.s_lon')} <= 160
""")
def near_storms(spark, sf_dir):
    a, b = (storms(spark, sf_dir).select(F.col("frame_s").alias(f"f{x}"), F.col("blob").alias(x), F.col("s_lat").alias(f"lat_{x}"), F.col("s_lon").alias(f"lon_{x}")) for x in "ab")
    km = haversine("lat_a", "lon_a", "lat_b", "lon_b")
    return a.join(b, (F.col("fa") == F.col("fb")) & (F.col("a") < F.col("b"))).where(km <= 160).select(F.col("fa").alias("frame_s"), "a", "b", F.round(km, 4).alias("km"))


@query("A1_W1_parent_frames", """
, cells AS (SELECT blob, sim_s // 900 AS slot, source AS parent, station_id, max(dbz) AS dbz FROM obs WHERE kind = 'radar' GROUP BY ALL),
frames AS (SELECT blob, slot, parent, count(*) AS children, max(dbz) AS max_dbz, count(*) FILTER (dbz >= 40) AS convective, count(*) FILTER (dbz >= 50) AS intense FROM cells GROUP BY ALL)
SELECT blob, CAST(slot AS BIGINT) AS slot, parent, children, max_dbz, convective, intense FROM (
    SELECT *, row_number() OVER (PARTITION BY blob, slot ORDER BY convective >= 2 AND intense >= 1 DESC, convective DESC, max_dbz DESC, children DESC, parent) AS place FROM frames) WHERE place = 1
""")
def parent_frames(spark, sf_dir):
    """The strongest parent of each storm and quarter of an hour: a child counts once, by its strongest echo."""
    cells = observations(spark, sf_dir, "radar").groupBy("blob", F.expr("sim_s DIV 900").alias("slot"), F.col("source").alias("parent"), "station_id").agg(F.max("dbz").alias("dbz"))
    frames = cells.groupBy("blob", "slot", "parent").agg(F.count(F.lit(1)).alias("children"), F.max("dbz").alias("max_dbz"), F.count_if(F.col("dbz") >= 40).alias("convective"), F.count_if(F.col("dbz") >= 50).alias("intense"))
    shaped = F.struct(-((F.col("convective") >= 2) & (F.col("intense") >= 1)).cast("int"), -F.col("convective"), -F.col("max_dbz"), -F.col("children"), "parent")
    best = frames.groupBy("blob", "slot").agg(F.min_by(F.struct("parent", "children", "max_dbz", "convective", "intense"), shaped).alias("best"))
    return best.select("blob", "slot", "best.*")


@query("A14_A15_outcome_counts", """
SELECT source, CASE WHEN quality < 0.2 THEN 'low_quality' WHEN intensity = 0 THEN 'dry' WHEN intensity >= CASE WHEN source = 'tile' THEN 2 ELSE 1 END THEN 'confirmed' ELSE 'weak' END AS outcome, count(*) AS n
FROM obs WHERE kind = 'radar' GROUP BY 1, 2
""")
def outcome_counts(spark, sf_dir):
    least = F.when(F.col("source") == "tile", 2).otherwise(1)
    outcome = F.when(F.col("quality") < 0.2, "low_quality").when(F.col("intensity") == 0, "dry").when(F.col("intensity") >= least, "confirmed").otherwise("weak")
    return observations(spark, sf_dir, "radar").groupBy("source", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("A20_C3_storm_statuses", f"""
, counts AS (SELECT blob, frame_s, count(*) FILTER (kind = 'radar') AS frames, count(*) FILTER (kind = 'lightning') AS strikes, max(sim_s) AS last_s FROM obs GROUP BY ALL)
SELECT CASE WHEN last_s < frame_s + 60 THEN 'sluimerend' WHEN frames >= 2 THEN 'bevestigd' WHEN frames = 1 THEN 'waargenomen' WHEN strikes > 0 THEN 'alleen_bliksem' ELSE 'onvoldoende_data' END AS status, count(*) AS n
FROM counts GROUP BY 1
""")
def storm_statuses(spark, sf_dir):
    counts = observations(spark, sf_dir).groupBy("blob", "frame_s").agg(F.count_if(F.col("kind") == "radar").alias("frames"), F.count_if(F.col("kind") == "lightning").alias("strikes"), F.max("sim_s").alias("last_s"))
    status = rules.tracking_status(F.col("last_s") < F.col("frame_s") + 60, F.col("frames"), F.col("strikes"))
    return counts.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("A21_X9_region_summary", """
SELECT blob, count(*) AS n, max(sim_s) AS newest, string_agg(DISTINCT upper(source), ',' ORDER BY upper(source)) AS sources FROM obs GROUP BY blob
""")
def region_summary(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.max("sim_s").alias("newest"), F.array_join(F.array_sort(F.collect_set(F.upper("source"))), ",").alias("sources"))


@query("A23_point_spans", f"""
, points AS (SELECT blob, frame_s, event_id, lat, lon FROM obs WHERE kind = 'radar'),
start AS (SELECT blob, frame_s, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon FROM points GROUP BY ALL),
one AS (SELECT blob, frame_s, arg_max(lat, (d, -event_id)) AS lat, arg_max(lon, (d, -event_id)) AS lon FROM (SELECT p.*, round({geo.haversine_sql('s.lat', 's.lon', 'p.lat', 'p.lon')}, 6) AS d FROM points p JOIN start s USING (blob, frame_s)) GROUP BY ALL)
SELECT blob, frame_s, round(max({geo.haversine_sql('o.lat', 'o.lon', 'p.lat', 'p.lon')}), 4) AS span_km FROM points p JOIN one o USING (blob, frame_s) GROUP BY ALL
""")
def point_spans(spark, sf_dir):
    """About the largest distance of a frame's points: from its first one to the farthest, and from that to the farthest."""
    points = observations(spark, sf_dir, "radar").select("blob", "frame_s", "event_id", "lat", "lon")
    group = ("blob", "frame_s")
    start = points.groupBy(*group).agg(F.min_by(F.struct("lat", "lon"), "event_id").alias("s"))
    from_start = F.round(haversine("s.lat", "s.lon", "lat", "lon"), 6)
    one = points.join(start, list(group)).groupBy(*group).agg(F.max_by(F.struct("lat", "lon"), F.struct(from_start, -F.col("event_id"))).alias("o"))
    return points.join(one, list(group)).groupBy(*group).agg(F.round(F.max(haversine("o.lat", "o.lon", "lat", "lon")), 4).alias("span_km"))


@query("W6_latest_minute", """
SELECT blob, count(*) AS cells, max(dbz) AS max_dbz FROM (SELECT *, max(sim_s) OVER (PARTITION BY blob) AS newest FROM obs WHERE kind = 'radar') WHERE sim_s >= newest - 60 GROUP BY blob
""")
def latest_minute(spark, sf_dir):
    radar = observations(spark, sf_dir, "radar")
    newest = radar.groupBy("blob").agg(F.max("sim_s").alias("newest"))
    return radar.join(newest, "blob").where("sim_s >= newest - 60").groupBy("blob").agg(F.count(F.lit(1)).alias("cells"), F.max("dbz").alias("max_dbz"))


@query("O1_O7_active_storms", f"""
SELECT blob, strikes FROM (SELECT blob, count(*) FILTER (kind = 'lightning' AND sim_s > {AS_OF - 3600}) AS strikes, max(sim_s) AS newest FROM obs WHERE sim_s <= {AS_OF} GROUP BY blob)
WHERE newest > {AS_OF - 300} ORDER BY strikes DESC, blob LIMIT 15
""")
def active_storms(spark, sf_dir):
    recent = (F.col("kind") == "lightning") & (F.col("sim_s") > AS_OF - 3600)
    rows = observations(spark, sf_dir).where(F.col("sim_s") <= AS_OF).groupBy("blob").agg(F.count_if(recent).alias("strikes"), F.max("sim_s").alias("newest"))
    return rows.where(F.col("newest") > AS_OF - 300).orderBy(F.desc("strikes"), "blob").limit(15).select("blob", "strikes")


@query("O4_first_cells", """
SELECT event_id, blob, sim_s, total > 150 AS truncated FROM (SELECT *, row_number() OVER (ORDER BY blob, sim_s DESC, event_id) AS place, count(*) OVER () AS total FROM obs WHERE kind = 'radar') WHERE place <= 150
""")
def first_cells(spark, sf_dir):
    """The map's 150 cells, and whether there are more of them."""
    radar = observations(spark, sf_dir, "radar").select("event_id", "blob", "sim_s")
    first = radar.orderBy("blob", F.desc("sim_s"), "event_id").limit(151)
    more = first.agg((F.count(F.lit(1)) > 150).alias("truncated"))  # one row
    return first.orderBy("blob", F.desc("sim_s"), "event_id").limit(150).crossJoin(F.broadcast(more))


@query("O8_O9_sampled_rings", """
, rings AS (SELECT blob, frame_s, list(event_id ORDER BY event_id) AS p FROM obs WHERE kind = 'radar' GROUP BY ALL),
kept AS (SELECT *, list_filter(p, lambda x, i: (i - 1) % CAST(greatest(1, ceil(len(p) / 6)) AS BIGINT) = 0) AS k FROM rings)
SELECT blob, frame_s, len(p) AS points, CASE WHEN len(k) >= 3 AND k[1] <> k[-1] THEN len(k) + 1 ELSE len(k) END AS sampled,
    least(6, len(list_filter(p, lambda x, i: (i - 1) % CAST(greatest(1, floor(len(p) / 6)) AS BIGINT) = 0))) AS compacted FROM kept
""")
def sampled_rings(spark, sf_dir):
    rings = observations(spark, sf_dir, "radar").groupBy("blob", "frame_s").agg(F.array_sort(F.collect_list("event_id")).alias("p"))
    size = lambda c: F.size(c).cast("long")
    return rings.select("blob", "frame_s", size("p").alias("points"), size(rules.sampled_ring(F.col("p"), 6)).alias("sampled"), size(rules.compact_footprint(F.col("p"), 6)).alias("compacted"))


@query("O10_X24_recent_strikes", f"""
SELECT count(*) FILTER (sim_s > {AS_OF - 300}) AS last_5_min, count(*) FILTER (sim_s > {AS_OF - 900}) AS last_15_min, count(*) AS last_60_min, arg_max(event_id, (sim_s, event_id)) AS newest
FROM obs WHERE kind = 'lightning' AND sim_s > {AS_OF - 3600} AND sim_s <= {AS_OF}
""")
def recent_strikes(spark, sf_dir):
    since = lambda s: F.count_if(F.col("sim_s") > AS_OF - s)
    rows = observations(spark, sf_dir).where((F.col("kind") == "lightning") & (F.col("sim_s") > AS_OF - 3600) & (F.col("sim_s") <= AS_OF))
    return rows.agg(since(300).alias("last_5_min"), since(900).alias("last_15_min"), F.count(F.lit(1)).alias("last_60_min"), F.max_by("event_id", F.struct("sim_s", "event_id")).alias("newest"))


@query("U2_X3_reference_moments", """
SELECT blob, count(DISTINCT t) AS moments, max(t) AS newest FROM (SELECT blob, sim_s AS t FROM obs WHERE kind = 'radar' UNION SELECT blob, frame_s FROM obs WHERE source <> 'comp') GROUP BY blob
""")
def reference_moments(spark, sf_dir):
    o = observations(spark, sf_dir)
    moments = o.where("kind = 'radar'").select("blob", F.col("sim_s").alias("t")).unionByName(o.where("source <> 'comp'").select("blob", F.col("frame_s").alias("t")))
    return moments.groupBy("blob").agg(F.count_distinct("t").alias("moments"), F.max("t").alias("newest"))


@query("S1_S3_S4_U3_topics", """
, cells AS (SELECT DISTINCT CAST(floor(lat / 0.7) AS BIGINT) AS y, CAST(floor(lon / 0.7) AS BIGINT) AS x, sim_s < 21600 AS early FROM obs WHERE kind = 'lightning')
SELECT y, x, CASE WHEN bool_and(early) THEN 'leave' ELSE 'join' END AS change FROM cells GROUP BY y, x HAVING count(*) = 1
""")
def topic_changes(spark, sf_dir):
    """Cells that strikes were in during the first half only (to leave) or the second half only (to join)."""
    strikes = observations(spark, sf_dir, "lightning")
    cells = strikes.select(geo.grid_key(F.col("lat"), 0.7).alias("y"), geo.grid_key(F.col("lon"), 0.7).alias("x"), (F.col("sim_s") < 21600).alias("early")).distinct()
    return cells.groupBy("y", "x").agg(F.when(F.bool_and("early"), "leave").otherwise("join").alias("change"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("U11_profile_index", """
SELECT blob, source, arg_max(intensity, (sim_s, event_id)) AS latest_intensity FROM obs WHERE kind = 'radar' GROUP BY 1, 2
""")
def profile_index(spark, sf_dir):
    return observations(spark, sf_dir, "radar").groupBy("blob", "source").agg(F.max_by("intensity", F.struct("sim_s", "event_id")).alias("latest_intensity"))


@query("X1_X2_pressure_classes", """
, kept AS (SELECT station_id, sim_s, event_id, pressure FROM obs WHERE kind = 'rain' AND pressure BETWEEN 850 AND 1100 AND sim_s > 36000 AND sim_s <= 43200),
deltas AS (SELECT station_id, CASE WHEN count(*) > 1 THEN arg_max(pressure, (sim_s, event_id)) - arg_min(pressure, (sim_s, event_id)) END AS d FROM kept GROUP BY 1)
SELECT CASE WHEN d IS NULL THEN 'onvoldoende_data' WHEN d <= -2 THEN 'snelle_daling' WHEN d <= -1 THEN 'dalend' WHEN d >= 2 THEN 'snelle_stijging' WHEN d >= 1 THEN 'stijgend' ELSE 'stabiel' END AS trend, count(*) AS n
FROM deltas GROUP BY 1
""")
def pressure_classes(spark, sf_dir):
    kept = observations(spark, sf_dir, "rain").where("pressure between 850 and 1100 and sim_s > 36000 and sim_s <= 43200")
    at = F.struct("sim_s", "event_id")
    deltas = kept.groupBy("station_id").agg(F.max_by("pressure", at).alias("last"), F.min_by("pressure", at).alias("first"), F.count(F.lit(1)).alias("n"))
    return deltas.groupBy(rules.pressure_class(F.when(F.col("n") > 1, F.col("last") - F.col("first"))).alias("trend")).agg(F.count(F.lit(1)).alias("n"))


@query("X8_satellite_strikes", f"""
SELECT seen_by, count(*) AS fetched, count(*) FILTER (near) AS accepted FROM (
    SELECT CASE WHEN lon * 40 % 360 >= -37.5 AND lon * 40 % 360 <= 80 THEN 'meteosat' ELSE 'other' END AS seen_by,
        {' OR '.join(geo.haversine_sql('lat', 'lon', f'{a}e0', f'{b}e0') + f' <= {k}' for _, a, b, k in REGIONS)} AS near FROM obs WHERE kind = 'lightning') GROUP BY 1
""")
def satellite_strikes(spark, sf_dir):
    lat, lon, near = F.col("lat"), F.col("lon"), F.lit(False)
    for _, a, b, km in REGIONS:
        near = near | (geo.haversine(lat, lon, F.lit(a), F.lit(b)) <= km)
    x = (lon * 40) % 360
    strikes = observations(spark, sf_dir, "lightning").select(F.when((x >= -37.5) & (x <= 80), "meteosat").otherwise("other").alias("seen_by"), near.alias("near"))
    return strikes.groupBy("seen_by").agg(F.count(F.lit(1)).alias("fetched"), F.count_if("near").alias("accepted"))


@query("X19_nowcast_series", f"""
SELECT minute, arg_max(rain_mm, (sim_s, event_id)) AS rain_mm FROM (SELECT *, CAST(round_even((sim_s - {AS_OF - 7200}) / 60.0e0, 0) AS BIGINT) AS minute FROM obs WHERE kind = 'rain') WHERE minute BETWEEN 0 AND 120 GROUP BY 1
""")
def nowcast_series(spark, sf_dir):
    minute = geo.frame_minute(F.col("sim_s") - (AS_OF - 7200))
    return observations(spark, sf_dir, "rain").withColumn("minute", minute).where("minute between 0 and 120").groupBy("minute").agg(F.max_by("rain_mm", F.struct("sim_s", "event_id")).alias("rain_mm"))


@query("X21_X22_source_status", f"""
, s AS (SELECT source, count(*) FILTER (intensity > 0 AND sim_s > {AS_OF - 60}) AS wet, round(({AS_OF} - max(sim_s)) / 60.0e0, 1) AS age FROM obs WHERE kind = 'radar' AND sim_s <= {AS_OF} GROUP BY 1)
SELECT source, CASE WHEN wet > 0 THEN 'neerslag' WHEN source = 'tile' THEN 'niet_actief' WHEN age <= 30 THEN 'droog' ELSE 'verouderd' END AS status, age FROM s
""")
def source_statuses(spark, sf_dir):
    rows = observations(spark, sf_dir).where((F.col("kind") == "radar") & (F.col("sim_s") <= AS_OF)).groupBy("source").agg(
        F.count_if((F.col("intensity") > 0) & (F.col("sim_s") > AS_OF - 60)).alias("wet"), F.round((AS_OF - F.max("sim_s")) / 60.0, 1).alias("age"),
    )
    return rows.select("source", rules.source_status(F.col("source") != "tile", F.col("wet"), F.col("age")).alias("status"), "age")


@query("X27_map_clusters", """
SELECT CAST(floor(lat * 20) AS BIGINT) AS y, CAST(floor(lon * 20) AS BIGINT) AS x, count(*) AS strikes, arg_max(event_id, (sim_s, event_id)) AS newest FROM obs WHERE kind = 'lightning' GROUP BY 1, 2
""")
def map_clusters(spark, sf_dir):
    strikes = observations(spark, sf_dir, "lightning")
    return strikes.groupBy(F.floor(F.col("lat") * 20).alias("y"), F.floor(F.col("lon") * 20).alias("x")).agg(F.count(F.lit(1)).alias("strikes"), F.max_by("event_id", F.struct("sim_s", "event_id")).alias("newest"))


@query("N4_N7_N8_T3_forecasts", f"""{STORMS_SQL}
, f AS (SELECT *, CAST(blob * 30 AS DOUBLE) AS minutes, CASE WHEN cells >= 6 THEN 'Hoog' WHEN cells >= 3 THEN 'Matig' ELSE 'Laag' END AS tier FROM storms)
SELECT blob, frame_s, CASE WHEN cells < 2 THEN 'systeem_nog_niet_bevestigd' WHEN tier = 'Laag' THEN 'bewegingsvector_onvoldoende_betrouwbaar' END AS block,
    round(greatest(0, least(75, max_dbz + greatest(-10, least(10, 8.0e0 * minutes / 60)))), 1) AS dbz,
    CAST(greatest(0, greatest(25, least(95, CASE WHEN tier = 'Hoog' THEN 82 ELSE 64 END + least(10, greatest(0, cells - 2) * 3) - round_even(minutes / 90 * 24, 0))) - 10) AS INT) AS confidence,
    CASE WHEN minutes <= 15 THEN 'imminent' WHEN minutes <= 45 THEN 'dichtbij' WHEN minutes <= 90 THEN 'vroeg' END AS stage FROM f
""")
def forecasts(spark, sf_dir):
    rows = storms(spark, sf_dir).withColumn("minutes", (F.col("blob") * 30).cast("double"))
    cells, minutes = F.col("cells"), F.col("minutes")
    tier = F.when(cells >= 6, "Hoog").when(cells >= 3, "Matig").otherwise("Laag")
    status = F.when(cells >= 2, "bevestigd").otherwise("waargenomen")
    confidence = F.greatest(F.lit(0), rules.forecast_confidence(tier, cells, minutes) - rules.PENALTY)
    return rows.select(
        "blob", "frame_s", rules.forecast_block(status, tier, minutes, F.lit("raak"), F.col("max_dbz")).alias("block"), F.round(rules.forecast_dbz(F.col("max_dbz"), F.lit(8.0), minutes), 1).alias("dbz"),
        confidence.cast("int").alias("confidence"), rules.warning_stage(F.lit("naderend"), F.lit(True), F.lit("raak"), minutes).alias("stage"),
    )


@query("D2_D3_echo_override", """
, c AS (SELECT frame_s, count(*) FILTER (source = 'comp' AND intensity > 0) AS comp, count(*) FILTER (source = 'tile' AND intensity > 1) AS tile, max(sim_s) FILTER (source = 'tile') AS tile_s FROM obs WHERE kind = 'radar' GROUP BY 1)
SELECT CASE WHEN comp = 0 AND tile > 0 AND frame_s + 300 - tile_s <= 1200 THEN 'rainviewer' ELSE 'opera' END AS source, count(*) AS frames FROM c GROUP BY 1
""")
def echo_overrides(spark, sf_dir):
    counts = observations(spark, sf_dir, "radar").groupBy("frame_s").agg(
        F.count_if((F.col("source") == "comp") & (F.col("intensity") > 0)).alias("comp"), F.count_if((F.col("source") == "tile") & (F.col("intensity") > 1)).alias("tile"),
        F.max(F.when(F.col("source") == "tile", F.col("sim_s"))).alias("tile_s"),
    )
    fresh = F.when(F.col("frame_s") + 300 - F.col("tile_s") <= 60 * rules.HEALTHY_MINUTES["national"], F.array(F.lit("rainviewer"))).otherwise(F.array().cast("array<string>"))
    rows = {"opera": F.col("comp"), "rainviewer": F.col("tile"), "hsaf_h40b": F.lit(0), "noaa_goes_rrqpe": F.lit(0)}
    return counts.groupBy(rules.echo_override(F.lit("opera"), fresh, rows, F.lit(True), F.lit(0)).alias("source")).agg(F.count(F.lit(1)).alias("frames"))


@query("D5_X23_transitions", """
, p AS (SELECT source, blob, count(*) AS samples, round(avg(quality), 6) AS f1 FROM obs WHERE kind = 'radar' GROUP BY 1, 2)
SELECT source, blob, CASE WHEN samples < 12 THEN 'insufficient' WHEN samples < 30 THEN 'low' WHEN samples < 100 THEN 'medium' ELSE 'high' END AS tier,
    CAST(CASE WHEN samples < 12 THEN 10 ELSE round_even(greatest(3, least(13, 3 + (1 - f1) * 10)), 0) END AS INT) AS penalty,
    CAST(CASE WHEN samples < 12 THEN 600 WHEN samples >= 100 AND f1 >= 0.75 THEN 300 WHEN samples >= 30 AND f1 >= 0.55 THEN 420 ELSE 600 END AS INT) AS window_s, CAST(round_even(100 * f1, 0) AS INT) AS percent FROM p
""")
def transitions(spark, sf_dir):
    p = observations(spark, sf_dir, "radar").groupBy("source", "blob").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("quality"), 6).alias("f1"))
    n, f1, none = F.col("samples"), F.col("f1"), F.lit(None).cast("double")
    return p.select(
        "source", "blob", rules.profile_tier(n).alias("tier"), rules.transition_penalty(n, f1, none).alias("penalty"), rules.transition_window(n, f1, none).alias("window_s"),
        F.bround(100 * f1).cast("int").alias("percent"),
    )


@query("M2_M3_identity_upsert", """
, old AS (SELECT blob, source, frame_s, min(event_id) AS first_event, max(intensity) AS intensity FROM obs WHERE kind = 'radar' AND sim_s < 30000 GROUP BY ALL),
new AS (SELECT blob, source, frame_s, min(event_id) AS first_event, max(intensity) AS intensity FROM obs WHERE kind = 'radar' AND sim_s >= 20000 GROUP BY ALL)
SELECT blob, source, frame_s, coalesce(o.first_event, n.first_event) AS first_event, coalesce(n.intensity, o.intensity) AS intensity FROM old o FULL JOIN new n USING (blob, source, frame_s)
""")
def identity_upsert(spark, sf_dir):
    """New samples replace the values of old ones of their key, but not what identifies them."""
    radar, key = observations(spark, sf_dir, "radar"), ("blob", "source", "frame_s")
    # both batches come from one pass: each row of a key is old, new or both
    old, new = F.col("sim_s") < 30000, F.col("sim_s") >= 20000
    rows = radar.groupBy(*key).agg(*(f(F.when(c, F.col(x))).alias(n) for c, p in ((old, "o"), (new, "n")) for f, x, n in ((F.min, "event_id", f"{p}_first"), (F.max, "intensity", f"{p}_intensity"))))
    return rows.select(*key, F.coalesce("o_first", "n_first").alias("first_event"), F.coalesce("n_intensity", "o_intensity").alias("intensity"))
