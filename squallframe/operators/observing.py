"""Routing, filters, keys and aggregates of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squallframe.functions import geo
from squallframe.functions.relational import islands, latest, upsert, within_km
from squallframe.sources.observations import OBS_SQL, REGIONS, TARGETS, observations, regions, targets

AS_OF = 43_200
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = f"{OBS_SQL}{oracle}" if oracle.lstrip().startswith(",") else f"{OBS_SQL} {oracle}"
        return f

    return register


HAV_REGION = geo.haversine_sql("o.lat", "o.lon", "r.c_lat", "r.c_lon")
HAV_TARGET = geo.haversine_sql("o.lat", "o.lon", "t.t_lat", "t.t_lon")


def routed(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Observations (of one kind) fanned out to all regions whose circle they are in, by the cell join with the largest radius."""
    return in_regions(observations(spark, sf_dir, kind), spark)


def in_regions(rows: DataFrame, spark: SparkSession) -> DataFrame:
    near = within_km(rows, regions(spark), "lat", "lon", "c_lat", "c_lon", max(r[3] for r in REGIONS))
    return near.where("km <= radius_km").drop("km")


@query("flagship_region_source", f"SELECT region_id, source, kind, count(*) AS n, max(intensity) AS strongest, round(max(quality), 4) AS best_quality FROM obs o JOIN regions r ON {HAV_REGION} <= r.radius_km GROUP BY ALL")
def flagship(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("region_id", "source", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("intensity").alias("strongest"), F.round(F.max("quality"), 4).alias("best_quality"))


@query("S10_lightning_source", "SELECT CASE WHEN x >= -37.5 AND x <= 80 THEN 'meteosat' WHEN x >= -106 AND x < -37.5 THEN 'goes19' WHEN x < -106 OR x >= 145 THEN 'goes18' ELSE 'none' END AS seen_by, count(*) AS n FROM (SELECT ((((lon * 40 + 180) % 360) + 360) % 360) - 180 AS x FROM obs WHERE kind = 'lightning') GROUP BY 1")
def lightning_sources(spark, sf_dir):
    return observations(spark, sf_dir, "lightning").groupBy(geo.lightning_source(F.col("lon") * 40).alias("seen_by")).agg(F.count(F.lit(1)).alias("n"))


def _steps_sql(x: str, levels: list[tuple[float, int]], otherwise: int) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {a}e0 THEN {v}" for a, v in levels) + f" ELSE {otherwise} END"




@query("levels_rain_and_dbz", f"SELECT CAST({_steps_sql('rain_mm', geo.RAIN_LEVELS, 8)} AS INT) AS rain_level, CAST(greatest(0, least(8, floor((dbz - 10) / 5))) AS INT) AS dbz_level, count(*) AS n FROM obs GROUP BY 1, 2")
def levels(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(geo.rain_level(F.col("rain_mm")).alias("rain_level"), geo.dbz_level(F.col("dbz")).alias("dbz_level")).agg(F.count(F.lit(1)).alias("n"))


BEARING_SQL = "(((degrees(atan2(sin(radians(t.t_lon - o.lon)) * cos(radians(t.t_lat)), cos(radians(o.lat)) * sin(radians(t.t_lat)) - sin(radians(o.lat)) * cos(radians(t.t_lat)) * cos(radians(t.t_lon - o.lon)))) + 360) % 360) + 360) % 360"


@query("F17_compass_to_targets", f"SELECT target_id, ({geo.COMPASS!r})[CAST(floor((b + 11.25) / 22.5) AS BIGINT) % 16 + 1] AS compass, count(*) AS n FROM (SELECT t.target_id, {BEARING_SQL} AS b FROM obs o CROSS JOIN targets t WHERE o.kind = 'radar') GROUP BY 1, 2")
def compass(spark, sf_dir):
    o = observations(spark, sf_dir, "radar")
    places = F.array(*[F.struct(F.lit(t).alias("target_id"), F.lit(a).alias("t_lat"), F.lit(b).alias("t_lon")) for t, a, b in TARGETS])
    rows = o.select("lat", "lon", F.inline(places))
    return rows.groupBy("target_id", geo.cardinal(geo.bearing(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))).alias("compass")).agg(F.count(F.lit(1)).alias("n"))


@query("U6_U7_U8_keys", "SELECT CAST(floor(lat / 0.1e0) AS BIGINT) AS grid_lat, CAST(floor(lon / 0.1e0) AS BIGINT) AS grid_lon, CAST(round_even(frame_s / 60.0e0, 0) AS BIGINT) AS frame_minute, CAST(floor(sim_s / 60.0e0) AS BIGINT) AS sample_minute, count(*) AS n FROM obs GROUP BY 1, 2, 3, 4")
def keys(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.groupBy(geo.grid_key(F.col("lat")).alias("grid_lat"), geo.grid_key(F.col("lon")).alias("grid_lon"), geo.frame_minute(F.col("frame_s")).alias("frame_minute"), geo.sample_minute(F.col("sim_s")).alias("sample_minute")).agg(F.count(F.lit(1)).alias("n"))


@query("F6_usable_corroboration", "SELECT source, count(*) AS n FROM obs WHERE kind = 'radar' AND source IN ('nat', 'tile') AND intensity >= CASE WHEN source = 'tile' THEN 2 ELSE 1 END GROUP BY 1")
def usable(spark, sf_dir):
    return observations(spark, sf_dir, "radar").where("source IN ('nat', 'tile')").where(F.col("intensity") >= F.when(F.col("source") == "tile", 2).otherwise(1)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("F9_wet_gauges", "SELECT station_id, count(*) AS n, round(max(rain_mm), 4) AS max_mm FROM obs WHERE kind = 'rain' AND rain_mm >= 0.1 GROUP BY 1")
def wet_gauges(spark, sf_dir):
    return observations(spark, sf_dir, "rain").where("rain_mm >= 0.1D").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("rain_mm"), 4).alias("max_mm"))


@query("A2_weighted_centroids", "SELECT blob, frame_s, round(sum(CAST(round(lat * 1000) AS BIGINT) * greatest(intensity, 1)) / sum(greatest(intensity, 1)), 1) AS c_lat_milli, round(sum(CAST(round(lon * 1000) AS BIGINT) * greatest(intensity, 1)) / sum(greatest(intensity, 1)), 1) AS c_lon_milli FROM obs WHERE kind = 'radar' GROUP BY 1, 2")
def centroids(spark, sf_dir):
    w, milli = F.greatest(F.col("intensity"), F.lit(1)), lambda c: F.round(F.col(c) * 1000).cast("long")
    return observations(spark, sf_dir, "radar").groupBy("blob", "frame_s").agg(F.round(F.sum(milli("lat") * w) / F.sum(w), 1).alias("c_lat_milli"), F.round(F.sum(milli("lon") * w) / F.sum(w), 1).alias("c_lon_milli"))


@query("A3_decayed_strike_centroids", f"SELECT blob, round(sum(lat * w) / sum(w), 4) AS c_lat, round(sum(lon * w) / sum(w), 4) AS c_lon, count(*) AS n FROM (SELECT *, greatest(0.1e0, 1 - ({AS_OF} - sim_s) / 300.0e0) AS w FROM obs WHERE kind = 'lightning' AND sim_s > {AS_OF - 3600} AND sim_s <= {AS_OF}) GROUP BY 1")
def decayed(spark, sf_dir, as_of: int = AS_OF):
    w = F.greatest(F.lit(0.1), 1 - (as_of - F.col("sim_s")) / 300.0)
    o = observations(spark, sf_dir, "lightning").where(f"sim_s > {as_of - 3600} AND sim_s <= {as_of}").withColumn("w", w)
    return o.groupBy("blob").agg(F.round(F.sum(F.col("lat") * F.col("w")) / F.sum("w"), 4).alias("c_lat"), F.round(F.sum(F.col("lon") * F.col("w")) / F.sum("w"), 4).alias("c_lon"), F.count(F.lit(1)).alias("n"))


@query("A4_strike_counts", f"SELECT blob, count(*) FILTER (sim_s > {AS_OF - 300}) AS last_5, count(*) FILTER (sim_s > {AS_OF - 3600}) AS last_60 FROM obs WHERE kind = 'lightning' AND sim_s <= {AS_OF} GROUP BY 1")
def strikes(spark, sf_dir, as_of: int = AS_OF):
    return observations(spark, sf_dir, "lightning").where(f"sim_s <= {as_of}").groupBy("blob").agg(F.count_if(F.col("sim_s") > as_of - 300).alias("last_5"), F.count_if(F.col("sim_s") > as_of - 3600).alias("last_60"))


CELLS_SQL = ", cells AS (SELECT source, frame_s, CAST(floor(lat / 0.1e0) AS BIGINT) AS y, CAST(floor(lon / 0.1e0) AS BIGINT) AS x, max(intensity) AS max_intensity, max(quality) AS max_quality, count(*) AS n FROM obs WHERE kind = 'radar' AND intensity > 0 GROUP BY 1, 2, 3, 4)"


def grid_cells(spark, sf_dir):
    o = observations(spark, sf_dir, "radar").where("intensity > 0")
    return o.groupBy("source", "frame_s", geo.grid_key(F.col("lat")).alias("y"), geo.grid_key(F.col("lon")).alias("x")).agg(F.max("intensity").alias("max_intensity"), F.max("quality").alias("max_quality"), F.count(F.lit(1)).alias("n"))


@query("A5_grid_cells", CELLS_SQL + " SELECT source, frame_s, y, x, max_intensity, round(max_quality, 4) AS max_quality, n FROM cells")
def cells(spark, sf_dir):
    return grid_cells(spark, sf_dir).withColumn("max_quality", F.round("max_quality", 4))


PAIRS_SQL = (
    CELLS_SQL + ", hit AS (SELECT a.source AS a, b.source AS b, a.frame_s, count(*) AS overlap, avg(b.max_intensity - a.max_intensity) AS bias FROM cells a JOIN cells b ON a.frame_s = b.frame_s AND a.y = b.y AND a.x = b.x AND a.source < b.source GROUP BY 1, 2, 3),"
    " sizes AS (SELECT source, frame_s, count(*) AS n FROM cells GROUP BY 1, 2),"
    " pairs AS (SELECT p.source AS a, q.source AS b, p.frame_s, p.n AS na, q.n AS nb, coalesce(h.overlap, 0) AS overlap, h.bias FROM sizes p JOIN sizes q ON p.frame_s = q.frame_s AND p.source < q.source LEFT JOIN hit h ON h.a = p.source AND h.b = q.source AND h.frame_s = p.frame_s)"
)


def source_pairs(spark, sf_dir):
    """Overlap of occupied cells for each pair of sources and frame: self-joins on equal keys, each pair once."""
    c = grid_cells(spark, sf_dir)
    a = c.select(F.col("source").alias("a"), "frame_s", "y", "x", F.col("max_intensity").alias("ia"))
    b = c.select(F.col("source").alias("b"), "frame_s", "y", "x", F.col("max_intensity").alias("ib"))
    hit = a.join(b, ["frame_s", "y", "x"]).where("a < b").groupBy("a", "b", "frame_s").agg(F.count(F.lit(1)).alias("overlap"), F.avg(F.col("ib") - F.col("ia")).alias("bias"))
    n = c.groupBy("source", "frame_s").agg(F.count(F.lit(1)).alias("n"))
    both = n.select(F.col("source").alias("a"), "frame_s", F.col("n").alias("na")).join(n.select(F.col("source").alias("b"), "frame_s", F.col("n").alias("nb")), "frame_s").where("a < b")
    return both.join(hit, ["a", "b", "frame_s"], "left").select("a", "b", "frame_s", "na", "nb", F.coalesce("overlap", F.lit(0)).alias("overlap"), "bias")


@query("J7_J8_A7_scores", PAIRS_SQL + " SELECT a, b, frame_s, na, nb, overlap, round(overlap / na, 3) AS \"precision\", round(overlap / nb, 3) AS recall, CASE WHEN overlap > 0 THEN round(2.0e0 * overlap / (na + nb), 3) END AS f1 FROM pairs")
def scores(spark, sf_dir):
    return source_pairs(spark, sf_dir).select("a", "b", "frame_s", "na", "nb", "overlap", F.round(F.col("overlap") / F.col("na"), 3).alias("precision"), F.round(F.col("overlap") / F.col("nb"), 3).alias("recall"), F.when(F.col("overlap") > 0, F.round(2.0 * F.col("overlap") / (F.col("na") + F.col("nb")), 3)).alias("f1"))


DIRECTED_SQL = PAIRS_SQL + ", directed AS (SELECT a AS src, b AS dst, frame_s, na AS n_from, nb AS n_to, overlap, bias FROM pairs UNION ALL SELECT b, a, frame_s, nb, na, overlap, 0 - bias FROM pairs), samples AS (SELECT *, 'frame' || CAST(frame_s // 21600 AS VARCHAR) AS scope, overlap / n_from AS detection, greatest(0, n_to - overlap) / n_to AS extra, n_to / n_from AS wet FROM directed)"


def bias_samples(spark, sf_dir):
    """Both directions of each comparison; the intensity difference changes its sign."""
    way = lambda src, dst, n_from, n_to, bias: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(n_from).alias("n_from"), F.col(n_to).alias("n_to"), bias.alias("bias"))
    both = F.array(way("a", "b", "na", "nb", F.col("bias")), way("b", "a", "nb", "na", 0 - F.col("bias")))
    d = source_pairs(spark, sf_dir).select("frame_s", "overlap", F.inline(both))
    return d.withColumns({"scope": F.concat(F.lit("frame"), F.expr("frame_s DIV 21600").cast("string")), "detection": F.col("overlap") / F.col("n_from"), "extra": F.greatest(F.lit(0), F.col("n_to") - F.col("overlap")) / F.col("n_to"), "wet": F.col("n_to") / F.col("n_from")})


@query("M4_M6_bias_samples", DIRECTED_SQL + " SELECT src, dst, frame_s, scope, round(detection, 4) AS detection, round(extra, 4) AS extra, round(wet, 4) AS wet, round(bias, 4) AS bias FROM samples")
def bias(spark, sf_dir):
    return bias_samples(spark, sf_dir).select("src", "dst", "frame_s", "scope", *[F.round(c, 4).alias(c) for c in ("detection", "extra", "wet", "bias")])


@query("A9_D5_bias_profiles", DIRECTED_SQL + " SELECT coalesce(scope, '*') AS scope, src, dst, count(*) AS n, round(avg(detection), 4) AS detection, round(avg(bias), 4) AS bias, CASE WHEN count(*) < 12 THEN 'insufficient' WHEN count(*) < 30 THEN 'low' WHEN count(*) < 100 THEN 'medium' ELSE 'high' END AS confidence FROM samples GROUP BY GROUPING SETS ((scope, src, dst), (src, dst))")
def profiles(spark, sf_dir):
    """Profiles for each scope and for all, in one pass by grouping sets."""
    s = bias_samples(spark, sf_dir)
    g = s.groupingSets([[F.col("scope"), F.col("src"), F.col("dst")], [F.col("src"), F.col("dst")]], F.col("scope"), F.col("src"), F.col("dst"))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("detection"), 4).alias("detection"), F.round(F.avg("bias"), 4).alias("bias"))
    tier = F.when(F.col("n") < 12, "insufficient").when(F.col("n") < 30, "low").when(F.col("n") < 100, "medium").otherwise("high")
    return out.select(F.coalesce("scope", F.lit("*")).alias("scope"), "src", "dst", "n", "detection", "bias", tier.alias("confidence"))


@query("A12_totals", "SELECT kind, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT station_id) AS stations, min(sim_s) AS first_s, max(sim_s) AS last_s FROM obs GROUP BY 1")
def totals(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("station_id").alias("stations"), F.min("sim_s").alias("first_s"), F.max("sim_s").alias("last_s"))


_WET, _GUST = "CASE WHEN rain_mm >= 0.1 THEN rain_mm END", "dbz / 2 + quality"


@query("A16_gauge_summary", f"""
SELECT blob, count(*) AS n, count({_WET}) AS wet, round(max(rain_mm), 4) AS max_mm, round(avg({_WET}), 4) AS mean_wet, round(max({_GUST}), 4) AS max_gust, round(avg(dbz / 2), 4) AS mean_wind,
    round(avg(pressure), 4) AS mean_p, round(min(pressure), 4) AS min_p, round(median(pressure), 4) AS median_p,
    round((((degrees(atan2(sum(sin(radians(intensity * 45))), sum(cos(radians(intensity * 45))))) + 360) % 360) + 360) % 360, 2) AS wind_dir
FROM obs WHERE kind = 'rain' GROUP BY 1
""")
def gauges(spark, sf_dir):
    """Gauges of each storm: readings, wet ones, rain, wind (half an echo's strength stands for its speed) and pressure; the direction's mean is that of a circle."""
    angle, wet = F.radians(F.col("intensity") * 45), F.when(F.col("rain_mm") >= 0.1, F.col("rain_mm"))
    return observations(spark, sf_dir, "rain").groupBy("blob").agg(
        F.count(F.lit(1)).alias("n"), F.count(wet).alias("wet"), F.round(F.max("rain_mm"), 4).alias("max_mm"), F.round(F.avg(wet), 4).alias("mean_wet"),
        F.round(F.max(F.col("dbz") / 2 + F.col("quality")), 4).alias("max_gust"), F.round(F.avg(F.col("dbz") / 2), 4).alias("mean_wind"),
        F.round(F.avg("pressure"), 4).alias("mean_p"), F.round(F.min("pressure"), 4).alias("min_p"), F.round(F.median("pressure"), 4).alias("median_p"),
        F.round(F.pmod(F.degrees(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))) + 360, F.lit(360.0)), 2).alias("wind_dir"),
    )


@query("W3_frame_runs", ", f AS (SELECT DISTINCT station_id, frame_s FROM obs WHERE kind = 'radar'), g AS (SELECT *, CASE WHEN frame_s - lag(frame_s) OVER w > 1200 THEN 1 ELSE 0 END AS broke FROM f WINDOW w AS (PARTITION BY station_id ORDER BY frame_s)), i AS (SELECT *, sum(broke) OVER (PARTITION BY station_id ORDER BY frame_s ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT station_id, CAST(island AS BIGINT) AS run, min(frame_s) AS first_s, max(frame_s) AS last_s, count(*) AS frames FROM i GROUP BY 1, 2")
def frame_runs(spark, sf_dir):
    f = observations(spark, sf_dir, "radar").select("station_id", "frame_s").distinct()
    return islands(f, ["station_id"], "frame_s", 1200).groupBy("station_id", F.col("__island").cast("long").alias("run")).agg(F.min("frame_s").alias("first_s"), F.max("frame_s").alias("last_s"), F.count(F.lit(1)).alias("frames"))


@query("W5_latest_cells", ", m AS (SELECT o.*, max(sim_s) OVER (PARTITION BY blob) AS newest FROM obs o WHERE kind = 'radar') SELECT blob, event_id, sim_s FROM m WHERE newest - sim_s <= 60")
def latest_cells(spark, sf_dir):
    r = observations(spark, sf_dir, "radar")
    newest = F.broadcast(r.groupBy("blob").agg(F.max("sim_s").alias("newest")))  # four rows
    return r.join(newest, "blob").where("newest - sim_s <= 60").select("blob", "event_id", "sim_s")


@query("W9_intensity_trend", ", f AS (SELECT blob, frame_s, max(dbz) AS m FROM obs WHERE kind = 'radar' GROUP BY 1, 2) SELECT blob, round((max_by(m, frame_s) - min_by(m, frame_s)) / ((max(frame_s) - min(frame_s)) / 3600.0e0), 4) AS dbz_per_hour FROM f GROUP BY 1")
def trend(spark, sf_dir):
    f = observations(spark, sf_dir, "radar").groupBy("blob", "frame_s").agg(F.max("dbz").alias("m"))
    return f.groupBy("blob").agg(F.round((F.max_by("m", "frame_s") - F.min_by("m", "frame_s")) / ((F.max("frame_s") - F.min("frame_s")) / 3600.0), 4).alias("dbz_per_hour"))


@query("T1_linear_motion", ", f AS (SELECT blob, frame_s, avg(lat) AS y, avg(lon) AS x FROM obs WHERE kind = 'radar' GROUP BY 1, 2) SELECT blob, round(regr_slope(y, frame_s) * 3600 * 110.574e0, 3) AS north_kmh, round(regr_slope(x, frame_s) * 3600, 4) AS east_deg_h, round((regr_r2(y, frame_s) + regr_r2(x, frame_s)) / 2, 3) AS fit FROM f GROUP BY 1")
def motion(spark, sf_dir):
    f = observations(spark, sf_dir, "radar").groupBy("blob", "frame_s").agg(F.avg("lat").alias("y"), F.avg("lon").alias("x"))
    t = F.col("frame_s")
    return f.groupBy("blob").agg(F.round(F.regr_slope("y", t) * 3600 * 110.574, 3).alias("north_kmh"), F.round(F.regr_slope("x", t) * 3600, 4).alias("east_deg_h"), F.round((F.regr_r2("y", t) + F.regr_r2("x", t)) / 2, 3).alias("fit"))


@query("O3_newest_strikes", "SELECT event_id, sim_s, round(lat, 4) AS lat, round(lon, 4) AS lon FROM obs WHERE kind = 'lightning' ORDER BY sim_s DESC, event_id LIMIT 300")
def newest_strikes(spark, sf_dir):
    return observations(spark, sf_dir, "lightning").orderBy(F.desc("sim_s"), "event_id").limit(300).select("event_id", "sim_s", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query("J1_region_fanout", f"SELECT region_id, event_id, round({HAV_REGION}, 3) AS km FROM obs o JOIN regions r ON {HAV_REGION} <= r.radius_km")
def fanout(spark, sf_dir):
    return routed(spark, sf_dir).select("region_id", "event_id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")), 3).alias("km"))


@query("J3_nearest_region", f", d AS (SELECT t.target_id, r.region_id, {geo.haversine_sql('t.t_lat', 't.t_lon', 'r.c_lat', 'r.c_lon')} AS km FROM targets t CROSS JOIN regions r), q AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY km, region_id) AS n FROM d WHERE km <= 150) SELECT target_id, region_id, round(km, 3) AS km FROM q WHERE n = 1")
def nearest_region(spark, sf_dir):
    km = geo.haversine(F.col("t_lat"), F.col("t_lon"), F.col("c_lat"), F.col("c_lon"))
    d = targets(spark).join(F.broadcast(regions(spark)), km <= 150.0).withColumn("km", km)
    return latest(d, ["target_id"], F.col("km"), F.col("region_id")).select("target_id", "region_id", F.round("km", 3).alias("km"))


GAUGE_KM = geo.haversine_sql("g.lat", "g.lon", "c.c_lat", "c.c_lon")


@query("J5_gauge_verification", f", c AS (SELECT blob AS storm, frame_s, avg(lat) AS c_lat, avg(lon) AS c_lon FROM obs WHERE kind = 'radar' GROUP BY 1, 2) SELECT storm, count(*) FILTER (rain_mm >= 0.1) AS confirmed, count(*) FILTER (rain_mm < 0.1) AS dry FROM obs g JOIN c ON g.frame_s = c.frame_s AND {GAUGE_KM} <= 60 WHERE g.kind = 'rain' GROUP BY 1")
def gauge_verification(spark, sf_dir):
    """Gauges within 60 km of each storm of their frame, by the cell join on frame and place."""
    o = observations(spark, sf_dir)
    c = o.where("kind = 'radar'").groupBy(F.col("blob").alias("storm"), "frame_s").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    near = within_km(o.where("kind = 'rain'").select("frame_s", "lat", "lon", "rain_mm"), c, "lat", "lon", "c_lat", "c_lon", 60.0, ["frame_s"])
    return near.groupBy("storm").agg(F.count_if(F.col("rain_mm") >= 0.1).alias("confirmed"), F.count_if(F.col("rain_mm") < 0.1).alias("dry"))


@query("J6_interval_spatial", f"SELECT a.event_id, count(*) AS confirmations, round(min({geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 3) AS nearest_km FROM obs a JOIN obs b ON a.kind = 'radar' AND b.kind = 'radar' AND a.source = 'comp' AND b.source <> 'comp' AND abs(a.sim_s - b.sim_s) <= 900 AND {geo.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 12 GROUP BY 1")
def corroborated(spark, sf_dir):
    """Composite cells with other sources' cells within 15 minutes and 12 km: buckets of time and place, then exact."""
    r = observations(spark, sf_dir, "radar").select("event_id", "source", "sim_s", "lat", "lon")
    a = r.where("source = 'comp'").select("event_id", F.col("sim_s").alias("s"), F.col("lat").alias("y"), F.col("lon").alias("x"), F.expr("sim_s DIV 900").alias("slot"))
    b = r.where("source <> 'comp'").select("sim_s", "lat", "lon", F.explode(F.expr("array(sim_s DIV 900 - 1, sim_s DIV 900, sim_s DIV 900 + 1)")).alias("slot"))
    near = within_km(a, b, "y", "x", "lat", "lon", 12.0, ["slot"]).where("abs(s - sim_s) <= 900")
    return near.groupBy("event_id").agg(F.count(F.lit(1)).alias("confirmations"), F.round(F.min("km"), 3).alias("nearest_km"))


@query("J12_pressure_delta", ", p AS (SELECT station_id, sim_s, event_id, pressure, max(sim_s) OVER (PARTITION BY station_id) AS newest FROM obs WHERE kind = 'rain'), now_ AS (SELECT station_id, sim_s AS newest, pressure AS p_now FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY sim_s DESC, event_id) AS n FROM p) WHERE n = 1), then_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY abs(sim_s - (newest - 3600)), sim_s, event_id) AS n FROM p WHERE sim_s < newest AND abs(sim_s - (newest - 3600)) <= 480) WHERE n = 1) SELECT n.station_id, round(p_now - pressure, 4) AS delta, CASE WHEN p_now - pressure <= -2 THEN 'rapid fall' WHEN p_now - pressure <= -1 THEN 'falling' WHEN p_now - pressure >= 2 THEN 'rapid rise' WHEN p_now - pressure >= 1 THEN 'rising' ELSE 'stable' END AS trend FROM now_ n JOIN then_ t USING (station_id)")
def pressure(spark, sf_dir):
    """As-of: each station's reading nearest an hour before its latest, within eight minutes."""
    p = observations(spark, sf_dir, "rain").select("station_id", "sim_s", "event_id", "pressure")
    now = latest(p, ["station_id"], F.desc("sim_s"), F.col("event_id")).select("station_id", F.col("sim_s").alias("newest"), F.col("pressure").alias("p_now"))
    off = F.abs(F.col("sim_s") - (F.col("newest") - 3600))
    then = latest(p.join(now, "station_id").where("sim_s < newest").where(off <= 480), ["station_id"], off, F.col("sim_s"), F.col("event_id"))
    d = F.col("p_now") - F.col("pressure")
    kind = F.when(d <= -2, "rapid fall").when(d <= -1, "falling").when(d >= 2, "rapid rise").when(d >= 1, "rising").otherwise("stable")
    return then.select("station_id", F.round(d, 4).alias("delta"), kind.alias("trend"))


@query("R5_intensity_runs", ", px AS (SELECT CAST(l_partkey % 64 AS BIGINT) AS r, CAST(l_suppkey % 64 AS BIGINT) AS c, max(CAST(l_quantity AS BIGINT)) // 8 AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT *, c - row_number() OVER (PARTITION BY r, v ORDER BY c) AS island FROM px WHERE v > 0), h AS (SELECT *, (row_number() OVER (PARTITION BY r, v, island ORDER BY c) - 1) // 16 AS chunk FROM g) SELECT r, CAST(v AS BIGINT) AS v, min(c) AS first_c, max(c) AS last_c FROM h GROUP BY r, v, island, chunk")
def runs(spark, sf_dir):
    """Runs of equal intensity in each row of a raster, of at most 16 pixels."""
    px = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_partkey") % 64).alias("r"), (F.col("l_suppkey") % 64).alias("c")).agg(F.expr("max(CAST(l_quantity AS BIGINT)) DIV 8").alias("v")).where("v > 0")
    g = px.withColumn("island", F.col("c") - F.row_number().over(Window.partitionBy("r", "v").orderBy("c")))
    h = g.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("r", "v", "island").orderBy("c")) - 1) / 16))
    return h.groupBy("r", "v", "island", "chunk").agg(F.min("c").alias("first_c"), F.max("c").alias("last_c")).select("r", "v", "first_c", "last_c")


@query("M1_frame_upsert", ", old AS (SELECT source, frame_s, count(*) AS n, max(dbz) AS top FROM obs WHERE kind = 'radar' AND event_id % 2 = 0 GROUP BY 1, 2), new AS (SELECT source, frame_s, count(*) AS n, CASE WHEN count(*) > 2 THEN max(dbz) END AS top FROM obs WHERE kind = 'radar' AND event_id % 2 = 1 GROUP BY 1, 2) SELECT source, frame_s, CASE WHEN w.n IS NULL THEN o.n ELSE w.n END AS n, round(coalesce(w.top, o.top), 4) AS top FROM old o FULL JOIN new w USING (source, frame_s)")
def frame_upsert(spark, sf_dir):
    r = observations(spark, sf_dir, "radar")
    old = r.where("event_id % 2 = 0").groupBy("source", "frame_s").agg(F.count(F.lit(1)).alias("n"), F.max("dbz").alias("top"))
    new = r.where("event_id % 2 = 1").groupBy("source", "frame_s").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 2, F.max("dbz")).alias("top"))
    return upsert(old, new, ["source", "frame_s"], ["top"]).withColumn("top", F.round("top", 4))


@query("N1_nearest_cell_to_target", f", d AS (SELECT t.target_id, o.event_id, {HAV_TARGET} AS km FROM targets t JOIN obs o ON o.kind = 'radar' AND o.intensity > 0), q AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY km, event_id) AS n FROM d) SELECT target_id, event_id, round(km, 3) AS km FROM q WHERE n = 1")
def nearest_cell(spark, sf_dir):
    """The minimum is taken in the map tasks; targets are a fixed small dimension."""
    o = observations(spark, sf_dir, "radar").where("intensity > 0")
    places = F.array(*[F.struct(F.lit(t).alias("target_id"), F.lit(a).alias("t_lat"), F.lit(b).alias("t_lon")) for t, a, b in TARGETS])
    rows = o.select("event_id", "lat", "lon", F.inline(places)).withColumn("km", geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")))
    best = rows.groupBy("target_id").agg(F.min(F.struct("km", "event_id")).alias("b"))
    return best.select("target_id", F.col("b.event_id").alias("event_id"), F.round("b.km", 3).alias("km"))


@query("K1_geojson_layers", "SELECT kind AS layer, event_id, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || CAST(CAST(round(lon * 1000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(lat * 1000) AS BIGINT) AS VARCHAR) || ']}}' AS feature FROM obs WHERE kind <> 'rain'")
def geojson(spark, sf_dir):
    """Point features; coordinates in thousandths of a degree, so that their text doesn't depend on the engine."""
    m = lambda c: F.round(F.col(c) * 1000).cast("long")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(m("lon"), m("lat")).alias("coordinates")).alias("geometry")))
    return observations(spark, sf_dir).where("kind <> 'rain'").select(F.col("kind").alias("layer"), "event_id", feature.alias("feature"))
