"""Set, join and window shaped queries on frames, cells and places."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from squallframe.functions import geo
from squallframe.functions.relational import any_within_km, latest
from squallframe.operators.observing import query
from squallframe.sources.observations import REGIONS, TARGETS, observations, regions

#: A closed ring of (lat, lon) around the southern half of the storms' tracks.
RING = [(50.0, 3.2), (50.2, 6.0), (50.9, 6.4), (50.5, 5.0), (50.8, 3.6)]
AS_OF = 40_000

def rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule; rings of fewer than three points hold nothing."""
    if len(ring) < 3:
        return F.lit(False)
    crossed = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        between = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        crossed = crossed + F.when(between & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossed % 2 == 1


_EDGES = " + ".join(f"CASE WHEN ({a}e0 > lat) <> ({c}e0 > lat) AND lon < {d - b}e0 * (lat - {a}e0) / {c - a}e0 + {b}e0 THEN 1 ELSE 0 END" for (a, b), (c, d) in zip(RING, RING[1:] + RING[:1], strict=True))


@query("F3_point_in_ring", f"SELECT blob, kind, count(*) AS n FROM obs WHERE ({_EDGES}) % 2 = 1 GROUP BY 1, 2")
def points_in_ring(spark, sf_dir):
    return observations(spark, sf_dir).where(in_ring(F.col("lat"), F.col("lon"), RING)).groupBy("blob", "kind").agg(rows())


#: The reading of a station nearest to an hour before each of its readings of one polling hour, within eight minutes; the earlier of two.
@query("A13_regional_pressure", """
, p AS (SELECT blob, station_id, sim_s, max_by(pressure, event_id) AS pressure FROM obs WHERE kind = 'rain' GROUP BY 1, 2, 3),
d AS (
    SELECT a.blob, a.station_id, a.sim_s, min_by(a.pressure - b.pressure, (abs(b.sim_s - (a.sim_s - 3600)), b.sim_s)) AS delta FROM p a JOIN p b
    ON b.blob = a.blob AND b.station_id = a.station_id AND b.sim_s < a.sim_s AND abs(b.sim_s - (a.sim_s - 3600)) <= 480 GROUP BY 1, 2, 3
),
changes AS (SELECT blob, sim_s // 3600 AS hour, round(median(delta), 2) AS median_change, count(*) AS changes FROM d GROUP BY 1, 2),
r AS (SELECT blob, sim_s // 3600 AS hour, round(median(pressure), 4) AS median_pressure, count(*) AS n FROM obs WHERE kind = 'rain' GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT blob, hour, median_pressure, n, coalesce(changes, 0) AS changes, CASE WHEN changes >= 3 THEN median_change END AS median_change FROM r LEFT JOIN changes USING (blob, hour)
""")
def regional_pressure(spark, sf_dir):
    """Median pressure of a storm's stations in each hour and, of three or more, the median of their changes within an hour.

    Readings are joined by station and slots of eight minutes, so only those near the asked time meet.
    """
    r = observations(spark, sf_dir, "rain")
    key = ["blob", "station_id"]
    p = r.groupBy(*key, "sim_s").agg(F.max_by("pressure", "event_id").alias("pressure"))
    slot = F.expr("sim_s DIV 480")
    before = p.select(*key, F.col("sim_s").alias("t"), F.col("pressure").alias("then"), slot.alias("slot"))
    asked = p.withColumn("slot", F.explode(F.expr("array((sim_s - 3600) DIV 480 - 1, (sim_s - 3600) DIV 480, (sim_s - 3600) DIV 480 + 1)")))
    off = F.abs(F.col("t") - (F.col("sim_s") - 3600))
    near = asked.join(before, [*key, "slot"]).where((off <= 480) & (F.col("t") < F.col("sim_s")))
    change = near.groupBy(*key, "sim_s").agg(F.min_by(F.col("pressure") - F.col("then"), F.struct(off, "t")).alias("change"))
    hour = F.expr("sim_s DIV 3600").alias("hour")
    changes = change.groupBy("blob", hour).agg(F.round(F.median("change"), 2).alias("median_change"), F.count(F.lit(1)).alias("changes"))
    medians = r.groupBy("blob", hour).agg(F.round(F.median("pressure"), 4).alias("median_pressure"), rows()).where("n >= 3")
    out = medians.join(changes, ["blob", "hour"], "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    return out.withColumn("median_change", F.when(F.col("changes") >= 3, F.col("median_change")))


@query("A17_image_sources", "SELECT source, count(*) AS n, round(avg(intensity) FILTER (intensity > 0), 3) AS mean_level, max(intensity) FILTER (intensity > 0) AS top_level FROM obs WHERE kind = 'radar' GROUP BY 1")
def image_sources(spark, sf_dir):
    level = F.when(F.col("intensity") > 0, F.col("intensity"))
    return observations(spark, sf_dir, "radar").groupBy("source").agg(rows(), F.round(F.avg(level), 3).alias("mean_level"), F.max(level).alias("top_level"))


@query("A19_station_union", "SELECT station_id, event_id, sim_s FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY sim_s DESC, event_id DESC) AS n FROM obs WHERE kind = 'rain') WHERE n = 1")
def station_union(spark, sf_dir):
    """The last reading of each station, whatever region polled it; the maximum is taken in the map tasks first."""
    last = observations(spark, sf_dir, "rain").groupBy("station_id").agg(F.max(F.struct("sim_s", "event_id")).alias("l"))
    return last.select("station_id", "l.event_id", "l.sim_s")


@query("A25_bounding_boxes", "SELECT blob, frame_s, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM obs WHERE kind = 'radar' GROUP BY 1, 2")
def bounding_boxes(spark, sf_dir):
    ends = [f(c).alias(f"{c}_{e}") for c in ("lat", "lon") for f, e in ((F.min, "min"), (F.max, "max"))]
    return observations(spark, sf_dir, "radar").groupBy("blob", "frame_s").agg(*ends)


@query("A24_U4_U5_coverage", ", e AS (SELECT region_id, c_lat - radius_km / 110.574e0 AS s, c_lat + radius_km / 110.574e0 AS n, c_lon - radius_km / (111.32e0 * greatest(0.1e0, cos(radians(c_lat)))) AS w, c_lon + radius_km / (111.32e0 * greatest(0.1e0, cos(radians(c_lat)))) AS e FROM regions), b AS (SELECT 'r' || blob AS region_id, source, min(lat) AS s2, max(lat) AS n2, min(lon) AS w2, max(lon) AS e2 FROM obs WHERE kind = 'radar' GROUP BY 1, 2) SELECT region_id, source, round(greatest(0e0, least(n, n2) - greatest(s, s2)) * greatest(0e0, least(e, e2) - greatest(w, w2)) / ((n - s) * (e - w)), 4) AS fraction FROM e JOIN b USING (region_id)")
def coverage(spark, sf_dir):
    """Share of each region's evaluation box that a source's box covers."""
    boxes = observations(spark, sf_dir, "radar").groupBy(F.concat(F.lit("r"), F.col("blob")).alias("region_id"), "source").agg(F.min("lat").alias("s2"), F.max("lat").alias("n2"), F.min("lon").alias("w2"), F.max("lon").alias("e2"))
    high, wide = F.col("radius_km") / 110.574, F.col("radius_km") / (111.32 * F.greatest(F.lit(0.1), F.cos(F.radians("c_lat"))))
    e = regions(spark).select("region_id", (F.col("c_lat") - high).alias("s"), (F.col("c_lat") + high).alias("n"), (F.col("c_lon") - wide).alias("w"), (F.col("c_lon") + wide).alias("e"))
    part = F.greatest(F.lit(0.0), F.least("n", "n2") - F.greatest("s", "s2")) * F.greatest(F.lit(0.0), F.least("e", "e2") - F.greatest("w", "w2"))
    return boxes.join(F.broadcast(e), "region_id").select("region_id", "source", F.round(part / ((F.col("n") - F.col("s")) * (F.col("e") - F.col("w"))), 4).alias("fraction"))


@query("W2_trailing_run", ", f AS (SELECT blob, frame_s, max(dbz) AS top FROM obs WHERE kind = 'radar' GROUP BY 1, 2), g AS (SELECT *, CASE WHEN top < 40 OR lead(frame_s) OVER (PARTITION BY blob ORDER BY frame_s) - frame_s > 1200 THEN 1 ELSE 0 END AS broke FROM f), h AS (SELECT *, sum(broke) OVER (PARTITION BY blob ORDER BY frame_s DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM g) SELECT blob, count(*) FILTER (breaks = 0) AS frames FROM h GROUP BY 1")
def trailing_run(spark, sf_dir):
    """Frames of 40 dBZ or more up to the latest, without a gap of more than 20 minutes."""
    f = observations(spark, sf_dir, "radar").groupBy("blob", "frame_s").agg(F.max("dbz").alias("top"))
    up, down = Window.partitionBy("blob").orderBy("frame_s"), Window.partitionBy("blob").orderBy(F.desc("frame_s"))
    broke = F.when((F.col("top") < 40) | (F.lead("frame_s").over(up) - F.col("frame_s") > 1200), 1).otherwise(0)
    h = f.withColumn("broke", broke).withColumn("breaks", F.sum("broke").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return h.groupBy("blob").agg(F.count_if(F.col("breaks") == 0).alias("frames"))


@query("W4_warm_up", f", p AS (SELECT blob, sim_s, sim_s - lag(sim_s) OVER (PARTITION BY blob ORDER BY sim_s) AS gap FROM (SELECT DISTINCT blob, sim_s FROM obs WHERE kind = 'rain' AND sim_s BETWEEN {AS_OF - 1800} AND {AS_OF})) SELECT blob, count(*) AS n, count(*) >= 3 AND min(sim_s) <= {AS_OF - 1800 + 480} AND max(sim_s) >= {AS_OF - 600} AND max(gap) <= 900 AS warm FROM p GROUP BY 1")
def warm_up(spark, sf_dir):
    """Whether samples of the last half hour start early, end late and leave no gap of more than 15 minutes."""
    p = observations(spark, sf_dir, "rain").where(f"sim_s BETWEEN {AS_OF - 1800} AND {AS_OF}").select("blob", "sim_s").distinct()
    p = p.withColumn("gap", F.col("sim_s") - F.lag("sim_s").over(Window.partitionBy("blob").orderBy("sim_s")))
    warm = (F.count(F.lit(1)) >= 3) & (F.min("sim_s") <= AS_OF - 1800 + 480) & (F.max("sim_s") >= AS_OF - 600) & (F.max("gap") <= 900)
    return p.groupBy("blob").agg(rows(), warm.alias("warm"))


@query("W7_recent_history", ", f AS (SELECT blob, frame_s, count(*) AS cells FROM obs WHERE kind = 'radar' GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY frame_s DESC) AS k, max(frame_s) OVER (PARTITION BY blob) AS newest FROM f) SELECT blob, frame_s, cells FROM g WHERE k <= 20 AND newest - frame_s <= 3600")
def recent_history(spark, sf_dir):
    """The last 20 points of each storm, none older than an hour."""
    f = observations(spark, sf_dir, "radar").groupBy("blob", "frame_s").agg(F.count(F.lit(1)).alias("cells"))
    w = Window.partitionBy("blob").orderBy(F.desc("frame_s"))
    return f.withColumn("k", F.row_number().over(w)).withColumn("newest", F.first("frame_s").over(w)).where("k <= 20 AND newest - frame_s <= 3600").select("blob", "frame_s", "cells")


@query("W10_W11_transitions", ", l AS (SELECT station_id, kind, lag(kind) OVER (PARTITION BY station_id ORDER BY sim_s, event_id) AS before FROM obs) SELECT before, kind, count(*) AS n FROM l WHERE before <> kind GROUP BY 1, 2")
def transitions(spark, sf_dir):
    """Changes of state along each station's rows; the first has none before it."""
    before = F.lag("kind").over(Window.partitionBy("station_id").orderBy("sim_s", "event_id"))
    return observations(spark, sf_dir).select("kind", before.alias("before")).where("before <> kind").groupBy("before", "kind").agg(rows())


_CELLS_SQL = ", cell AS (SELECT blob, source, CAST(floor(lat / 0.1e0) AS BIGINT) AS y, CAST(floor(lon / 0.1e0) AS BIGINT) AS x, max(intensity) AS top FROM obs WHERE kind = 'radar' GROUP BY 1, 2, 3, 4)"


def cells(spark, sf_dir):
    o = observations(spark, sf_dir, "radar")
    return o.groupBy("blob", "source", geo.grid_key(F.col("lat")).alias("y"), geo.grid_key(F.col("lon")).alias("x")).agg(F.max("intensity").alias("top"))


@query("J9_J10_grid_shift", f"{_CELLS_SQL}, s AS (SELECT a.blob, dy, dx, count(*) AS overlap, avg(b.top - a.top) AS bias FROM cell a CROSS JOIN range(-2, 3) p(dy) CROSS JOIN range(-2, 3) q(dx) JOIN cell b ON a.blob = b.blob AND a.source = 'comp' AND b.source = 'nat' AND a.y + dy = b.y AND a.x + dx = b.x GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY overlap DESC, abs(dy) + abs(dx), dy, dx) AS k FROM s) SELECT blob, dy, dx, overlap, round(bias, 4) AS bias FROM r WHERE k = 1")
def grid_shift(spark, sf_dir):
    """The best of 25 shifts from one source's cells to another's, and the mean difference there: an equi-join on shifted keys."""
    c = cells(spark, sf_dir)
    near = F.sequence(F.lit(-2), F.lit(2))
    a = c.where("source = 'comp'").select("blob", "y", "x", F.col("top").alias("ours"), F.explode(near).alias("dy")).withColumn("dx", F.explode(near))
    a = a.select("blob", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.col("dy").cast("long").alias("dy"), F.col("dx").cast("long").alias("dx"), "ours")
    s = a.join(c.where("source = 'nat'").select("blob", "y", "x", "top"), ["blob", "y", "x"]).groupBy("blob", "dy", "dx").agg(F.count(F.lit(1)).alias("overlap"), F.round(F.avg(F.col("top") - F.col("ours")), 4).alias("bias"))
    return latest(s, ["blob"], F.desc("overlap"), F.abs("dy") + F.abs("dx"), F.col("dy"), F.col("dx"))


@query("U1_cell_sets", f"{_CELLS_SQL}, a AS (SELECT * FROM cell WHERE source = 'comp'), b AS (SELECT * FROM cell WHERE source = 'nat') SELECT blob, count(*) FILTER (a.top IS NOT NULL AND b.top IS NOT NULL) AS both_cells, count(*) FILTER (b.top IS NULL) AS only_comp, count(*) FILTER (a.top IS NULL) AS only_nat FROM a FULL JOIN b USING (blob, y, x) GROUP BY 1")
def cell_sets(spark, sf_dir):
    """Intersection and differences of two sources' cells by one grouping instead of three set operations."""
    per = cells(spark, sf_dir).where("source IN ('comp', 'nat')").groupBy("blob", "y", "x").agg(F.bool_or(F.col("source") == "comp").alias("a"), F.bool_or(F.col("source") == "nat").alias("b"))
    return per.groupBy("blob").agg(F.count_if(F.expr("a AND b")).alias("both_cells"), F.count_if(F.expr("a AND NOT b")).alias("only_comp"), F.count_if(F.expr("b AND NOT a")).alias("only_nat"))


@query("O6_busiest_cells", f"{_CELLS_SQL} SELECT blob, source, y, x, top FROM cell ORDER BY top DESC, blob, source, y, x LIMIT 40")
def busiest_cells(spark, sf_dir):
    return cells(spark, sf_dir).orderBy(F.desc("top"), "blob", "source", "y", "x").limit(40)


_PLACE_KM = geo.haversine_sql("o.lat", "o.lon", "t.t_lat", "t.t_lon")


@query("J15_nearest_place", f", d AS (SELECT o.event_id, t.target_id, row_number() OVER (PARTITION BY o.event_id ORDER BY {_PLACE_KM}, t.target_id) AS k FROM obs o JOIN targets t ON {_PLACE_KM} <= 100 WHERE o.kind = 'radar') SELECT event_id, target_id FROM d WHERE k = 1")
def nearest_place(spark, sf_dir):
    """The place nearest to each cell, up to 100 km: the least of an array of distances, without a join or shuffle."""
    o = observations(spark, sf_dir, "radar")
    near = F.array_min(F.array(*[F.struct(geo.haversine(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)).alias("km"), F.lit(t).alias("target_id")) for t, a, b in TARGETS]))
    return o.select("event_id", near.alias("p")).where("p.km <= 100").select("event_id", "p.target_id")


@query("J16_two_level_profiles", """
, e AS (SELECT blob, source, sim_s // 3600 AS hour, count(*) AS samples, round(avg(intensity), 4) AS level FROM obs WHERE kind = 'radar' GROUP BY 1, 2, 3 HAVING count(*) >= 12),
s AS (SELECT source, count(*) AS samples, round(avg(intensity), 4) AS level FROM obs WHERE kind = 'radar' GROUP BY 1), w AS (SELECT DISTINCT blob, source, sim_s // 3600 AS hour FROM obs)
SELECT w.blob, w.source, CAST(w.hour AS BIGINT) AS hour, CASE WHEN e.samples IS NULL THEN '*' ELSE 'exact' END AS scope, CASE WHEN e.samples IS NULL THEN s.samples ELSE e.samples END AS samples,
    CASE WHEN e.samples IS NULL THEN s.level ELSE e.level END AS level
FROM w LEFT JOIN e ON w.blob = e.blob AND w.source = e.source AND w.hour = e.hour LEFT JOIN s ON w.source = s.source
""")
def two_level_profiles(spark, sf_dir):
    """A profile of the exact scope (a storm's hour) if it has twelve samples, else the whole row of scope '*'. Profiles are as many as scopes and sources."""
    o = observations(spark, sf_dir).withColumn("hour", F.expr("sim_s DIV 3600"))
    r, exact = o.where("kind = 'radar'"), ["blob", "source", "hour"]
    profile = F.struct(F.count(F.lit(1)).alias("samples"), F.round(F.avg("intensity"), 4).alias("level"))
    scoped, star = r.groupBy(*exact).agg(profile.alias("e")).where("e.samples >= 12"), r.groupBy("source").agg(profile.alias("s"))
    wanted = o.select(*exact).distinct().join(scoped, exact, "left").join(star, "source", "left")
    return wanted.withColumn("p", F.coalesce("e", "s")).select(*exact, F.when(F.col("e").isNull(), "*").otherwise("exact").alias("scope"), "p.samples", "p.level")


@query("J17_strikes_near_radar", f"SELECT o.blob, count(*) AS n FROM obs o WHERE o.kind = 'lightning' AND EXISTS (SELECT 1 FROM obs t WHERE t.kind = 'radar' AND t.frame_s = o.frame_s AND {geo.haversine_sql('o.lat', 'o.lon', 't.lat', 't.lon')} <= 25) GROUP BY 1")
def strikes_near_radar(spark, sf_dir):
    """Strikes with any cell of their frame within 25 km, without their pairs."""
    strikes = observations(spark, sf_dir, "lightning").select("blob", "frame_s", F.col("lat").alias("y"), F.col("lon").alias("x"))
    return any_within_km(strikes, observations(spark, sf_dir, "radar"), "y", "x", "lat", "lon", 25.0, ["frame_s"]).groupBy("blob").agg(rows())


@query("U10_region_keys", f"SELECT region_id, key FROM (VALUES {', '.join(f"('{r}', '{a:.2f},{b:.2f},{k:.0f}')" for r, a, b, k in REGIONS)}) v(region_id, key)")
def region_keys(spark, sf_dir):
    return regions(spark).select("region_id", F.format_string("%.2f,%.2f,%.0f", "c_lat", "c_lon", "radius_km").alias("key"))
