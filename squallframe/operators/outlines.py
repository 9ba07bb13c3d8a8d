"""Outlines of raster parts and of lightning zones, and pixel runs inside accepted outlines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions import geo
from squallframe.functions.relational import any_within_km, within_km
from squallframe.functions.shapes import hulls
from squallframe.operators.observing import HAV_REGION, ORACLES, QUERIES, routed
from squallframe.operators.rasters import _parts_sql, label, wet_pixels
from squallframe.operators.storms import lightning_zones

#: Ways along the sides of a pixel, each to the right of the one before (fixed order): steps in rows and columns.
WAYS = [(0, 1), (1, 0), (0, -1), (-1, 0)]
#: How far a ring's area may be from that of its pixels, and the buffer of a zone in kilometres (fixed values).
AREA_TOLERANCE, ZONE_KM = 0.02, 12.0
#: Square kilometres of a cell of a tenth of a degree at 52 degrees north.
PIXEL_KM2 = 76.0


def boundary(pixels: DataFrame, part: list[str], row: str, col: str) -> DataFrame:
    """Sides of pixels that no other pixel of their part shares: part, start (__r, __c) and way (__w); the part lies to the right.

    A side of two pixels comes twice, in opposite ways, and is gone once it is counted.
    """
    y, x = F.col(row), F.col(col)
    sides = F.array(*[F.struct((y + dy).alias("__r"), (x + dx).alias("__c"), F.lit(w).alias("__w")) for w, (dy, dx) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))])
    each = pixels.select(*part, F.inline(sides))
    # both ways along a side have its lower end and direction in common
    low_r, low_c = F.col("__r") - (F.col("__w") == 3).cast("int"), F.col("__c") - (F.col("__w") == 2).cast("int")
    once = each.groupBy(*part, low_r.alias("__lr"), low_c.alias("__lc"), (F.col("__w") % 2).alias("__d")).agg(F.count(F.lit(1)).alias("__n"), F.first("__w").alias("__w"), F.first("__r").alias("__r"), F.first("__c").alias("__c"))
    return once.where("__n = 1").select(*part, "__r", "__c", "__w")


def rings_of(sides: dict[tuple[int, int, int], None]) -> list[tuple[float, list[tuple[int, int]]]]:
    """Area (negative for holes) and corners of each ring of sides (row, column, way), which keep to their pixel where parts touch at a corner."""
    left, rings = dict(sides), []
    for start in sorted(left):
        if start not in left:
            continue
        at, corners, area = start, [], 0
        while at in left:
            del left[at]
            r, c, w = at
            dy, dx = WAYS[w]
            area += c * (r + dy) - (c + dx) * r
            after = next((r + dy, c + dx, (w + turn) % 4) for turn in (1, 0, 3, 2) if (r + dy, c + dx, (w + turn) % 4) in sides)
            if after[2] != w:
                corners.append((r + dy, c + dx))
            at = after
        first = min(range(len(corners)), key=corners.__getitem__)
        rings.append((area / 2, corners[first:] + corners[:first]))
    return rings


def outlines(pixels: DataFrame, part: list[str], row: str, col: str) -> DataFrame:
    """The outer ring of each part: part, sides, rings, area of the largest ring, whether it is valid, and ``ring``, its corners (row, col).

    A ring is valid if it is the only one and its area is that of the pixels, but for AREA_TOLERANCE; parts with holes
    aren't. Sides are cancelled by one shuffle; what is left of a part, its outline, is walked by one task. Each pixel is there once in its part.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    types = ", ".join(f"`{k}` {kinds[k]}" for k in part)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        sides = dict.fromkeys(zip(group["__r"].tolist(), group["__c"].tolist(), group["__w"].tolist(), strict=True))
        rings = rings_of(sides)
        area, corners = max(rings, key=lambda r: abs(r[0]))
        return pd.DataFrame([(*group[part].iloc[0], len(sides), len(rings), abs(area), [{"row": r, "col": c} for r, c in corners])], columns=[*part, "sides", "rings", "area", "ring"])

    walked = boundary(pixels, part, row, col).groupBy(*part).applyInPandas(walk, f"{types}, sides int, rings int, area double, ring array<struct<row:long,col:long>>")
    sized = pixels.groupBy(*part).agg(F.count(F.lit(1)).alias("pixels"))
    valid = (F.col("rings") == 1) & (F.abs(F.col("area") / F.col("pixels") - 1) <= AREA_TOLERANCE)
    return walked.join(sized, part).withColumn("valid", valid)


def part_outlines(spark, sf_dir) -> DataFrame:
    labelled = label(wet_pixels(spark, sf_dir), ["frame_s"], "y", "x").withColumnsRenamed({"__row": "first_row", "__col": "first_col"})
    return outlines(labelled, ["frame_s", "first_row", "first_col"], "y", "x")


def outline_figures(spark, sf_dir):
    """Outlines of the parts of each frame, with their corners as text."""
    corners = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["row"], p["col"])), ",")
    return part_outlines(spark, sf_dir).select("frame_s", "first_row", "first_col", "pixels", "sides", "rings", "area", "valid", corners.alias("corners"))


QUERIES["R6_R7_outlines"] = outline_figures
_PARTS = _parts_sql("abs(a.y - b.y) + abs(a.x - b.x) = 1", 1)
#: Sides are followed by a recursive query; a ring is named by its smallest side, corners are where the way changes.
ORACLES["R6_R7_outlines"] = _PARTS[: _PARTS.rindex("SELECT frame_s, p[1]")] + f"""
    , sides AS (
        SELECT frame_s, p, y + dy AS r, x + dx AS c, w FROM part, (VALUES (0, 0, 0), (0, 1, 1), (1, 1, 2), (1, 0, 3)) v(dy, dx, w)
    ),
    ends AS (SELECT *, r + CASE w WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS r2, c + CASE w WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS c2 FROM sides),
    outer_ AS (SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM ends f WHERE f.frame_s = e.frame_s AND f.p = e.p AND f.r = e.r2 AND f.c = e.c2 AND f.r2 = e.r AND f.c2 = e.c)),
    after AS (
        SELECT e.frame_s, e.p, e.r, e.c, e.w, e.r2, e.c2, f.w AS w2, row_number() OVER (PARTITION BY e.frame_s, e.p, e.r, e.c, e.w ORDER BY (f.w - e.w + 2) % 4 = 0, (e.w - f.w + 5) % 4) AS k
        FROM outer_ e JOIN outer_ f ON f.frame_s = e.frame_s AND f.p = e.p AND f.r = e.r2 AND f.c = e.c2
    ),
    nexts AS (SELECT * FROM after WHERE k = 1),
    walk AS (
        SELECT frame_s, p, (r, c, w) AS start, r, c, w, 0 AS n FROM nexts
        UNION ALL
        SELECT k.frame_s, k.p, k.start, x.r2, x.c2, x.w2, k.n + 1 FROM walk k JOIN nexts x ON x.frame_s = k.frame_s AND x.p = k.p AND x.r = k.r AND x.c = k.c AND x.w = k.w
        WHERE (x.r2, x.c2, x.w2) <> k.start
    ),
    ringed AS (SELECT frame_s, p, start, min((r, c, w)) AS ring FROM walk GROUP BY 1, 2, 3),
    loops AS (
        SELECT n.frame_s, n.p, g.ring, abs(sum(n.c * n.r2 - n.c2 * n.r)) / 2 AS area, count(*) AS sides FROM nexts n
        JOIN ringed g ON g.frame_s = n.frame_s AND g.p = n.p AND g.start = (n.r, n.c, n.w) GROUP BY 1, 2, 3
    ),
    largest AS (SELECT frame_s, p, sum(sides) AS sides, count(*) AS rings, max(area) AS area, max_by(ring, (area, -ring[1], -ring[2])) AS ring FROM loops GROUP BY 1, 2),
    turns AS (
        SELECT l.frame_s, l.p, k.n, n.r2, n.c2 FROM largest l JOIN walk k ON k.frame_s = l.frame_s AND k.p = l.p AND k.start = l.ring
        JOIN nexts n ON n.frame_s = k.frame_s AND n.p = k.p AND n.r = k.r AND n.c = k.c AND n.w = k.w WHERE n.w <> n.w2
    ),
    begun AS (SELECT frame_s, p, min((r2, c2, n)) AS b, max(n) + 1 AS many FROM turns GROUP BY 1, 2),
    written AS (
        SELECT frame_s, p, string_agg(r2 || ' ' || c2, ',' ORDER BY n < b[3], n) AS corners FROM turns JOIN begun USING (frame_s, p) GROUP BY 1, 2
    ),
    sized AS (SELECT frame_s, p, count(*) AS pixels FROM part GROUP BY 1, 2)
    SELECT frame_s, p[1] AS first_row, p[2] AS first_col, pixels, CAST(sides AS INT) AS sides, CAST(rings AS INT) AS rings, CAST(area AS DOUBLE) AS area,
        rings = 1 AND abs(area / pixels - 1) <= {AREA_TOLERANCE} AS valid, corners
    FROM largest JOIN written USING (frame_s, p) JOIN sized USING (frame_s, p)
"""


def buffered(lat: Column, lon: Column, km: float) -> Column:
    """Eight places around one, at every 45 degrees."""
    return F.array(*[geo.destination(lat, lon, F.lit(float(h)), F.lit(km), 6371.0088) for h in range(0, 360, 45)])


def zone_rings(strikes: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Zones with their rings: keys, zone, strikes, newest_s, ring (hull of buffered strikes) and whether a cell of the same keys is within 25 km of one.

    strikes: keys, event_id, lat, lon, sim_s; cells: keys, lat, lon.
    """
    named = lightning_zones(strikes, keys).join(strikes, [*keys, "event_id"])
    group = [*keys, "zone"]
    summed = named.groupBy(*group).agg(F.count(F.lit(1)).alias("strikes"), F.max("sim_s").alias("newest_s"))
    around = named.select(*group, F.inline(buffered(F.col("lat"), F.col("lon"), ZONE_KM)))
    places = cells.select(*keys, F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    near = any_within_km(named.select(*group, "lat", "lon"), places, "lat", "lon", "__lat", "__lon", 25.0, keys).select(*group).distinct().withColumn("radar", F.lit(True))
    return summed.join(hulls(around, group, "lat", "lon"), group).join(near, group, "left").withColumn("radar", F.coalesce("radar", F.lit(False)))


def zone_outlines(spark, sf_dir):
    """Zones of each region and frame with their buffered outline; ends of the outline are given in whole ten-thousandths of a degree."""
    keys = ["region_id", "frame_s"]
    rows = routed(spark, sf_dir)
    strikes = rows.where("kind = 'lightning'").select(*keys, "event_id", "lat", "lon", "sim_s")
    zones = zone_rings(strikes, rows.where("kind = 'radar'").select(*keys, "lat", "lon"), keys)
    end = lambda f, c: F.round(f(F.transform("ring", lambda p: p[c])), 4)
    return zones.select(*keys, "zone", "strikes", "newest_s", "radar", F.size("ring").alias("corners"), end(F.array_min, "lat").alias("south"), end(F.array_max, "lat").alias("north"), end(F.array_min, "lon").alias("west"), end(F.array_max, "lon").alias("east"))


QUERIES["L1_zone_outlines"] = zone_outlines
_R = 6371.0088
_THERE = f"asin(sin(radians(lat)) * cos({ZONE_KM / _R}e0) + cos(radians(lat)) * sin({ZONE_KM / _R}e0) * cos(radians(h)))"
ORACLES["L1_zone_outlines"] = ORACLES["L1_lightning_zones"].rsplit("SELECT region_id, frame_s, zone, count(*)", 1)[0] + f"""
, zst AS (SELECT region_id, frame_s, zone, event_id, sim_s, lat, lon FROM named JOIN st USING (region_id, frame_s, event_id)),
cells AS (SELECT region_id, frame_s, lat AS c_lat2, lon AS c_lon2 FROM obs o JOIN regions r ON {HAV_REGION} <= r.radius_km WHERE kind = 'radar'),
confirmed AS (SELECT DISTINCT z.region_id, z.frame_s, zone FROM zst z JOIN cells c ON c.region_id = z.region_id AND c.frame_s = z.frame_s AND {geo.haversine_sql("lat", "lon", "c_lat2", "c_lon2")} <= 25),
spots AS (
    SELECT DISTINCT region_id, frame_s, zone, degrees({_THERE}) AS y,
        degrees(radians(lon) + atan2(sin(radians(h)) * sin({ZONE_KM / _R}e0) * cos(radians(lat)), cos({ZONE_KM / _R}e0) - sin(radians(lat)) * sin({_THERE}))) AS x
    FROM zst, (SELECT unnest(range(0, 360, 45)) AS h)
),
crossed AS (
    SELECT a.region_id, a.frame_s, a.zone, a.y, a.x, min((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x)) AS low, max((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x)) AS high
    FROM spots a JOIN spots b USING (region_id, frame_s, zone) JOIN spots k USING (region_id, frame_s, zone) GROUP BY a.region_id, a.frame_s, a.zone, a.y, a.x, b.y, b.x
),
corners AS (SELECT DISTINCT region_id, frame_s, zone, y, x FROM crossed WHERE low >= 0 AND high > 0),
shaped AS (SELECT region_id, frame_s, zone, CAST(count(*) AS INT) AS corners, round(min(y), 4) AS south, round(max(y), 4) AS north, round(min(x), 4) AS west, round(max(x), 4) AS east FROM corners GROUP BY 1, 2, 3)
SELECT region_id, frame_s, zone, count(*) AS strikes, max(sim_s) AS newest_s, (region_id, frame_s, zone) IN (SELECT (region_id, frame_s, zone) FROM confirmed) AS radar, corners, south, north, west, east
FROM zst JOIN shaped USING (region_id, frame_s, zone) GROUP BY region_id, frame_s, zone, corners, south, north, west, east
"""


def inside_rings(points: DataFrame, rings: DataFrame, keys: list[str], y: str, x: str, cell: float) -> DataFrame:
    """Points inside a ring of the same keys, each once, by the even-odd rule.

    rings: keys and ``ring``, an array of (y, x); one of fewer than three corners holds nothing. A ring is put into the cells of a grid that its box
    covers and points into theirs, so the semi-join is on equal keys and cells; a point is tested against the rings of its own cell only. ``cell`` should
    be about the size of a usual ring.
    """
    ring, after = F.col("__ring"), F.concat(F.slice("__ring", 2, F.size("__ring")), F.slice("__ring", 1, 1))
    of = {c: F.transform(ring, _field(c)) for c in "yx"}
    cells = rings.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("ring").alias("__ring")).where(F.size("__ring") >= 3)
    for c in "yx":
        cells = cells.withColumn(f"__r{c}", F.explode(F.sequence(F.floor(F.array_min(of[c]) / cell), F.floor(F.array_max(of[c]) / cell))))
    placed = points.withColumns({"__py": F.floor(F.col(y) / cell), "__px": F.floor(F.col(x) / cell)})
    py, px = F.col(y), F.col(x)

    def crosses(a: Column, b: Column) -> Column:
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    inside = F.size(F.filter(F.zip_with(ring, after, crosses), lambda v: F.coalesce(v, F.lit(False)))) % 2 == 1
    same = inside & (F.col("__py") == F.col("__ry")) & (F.col("__px") == F.col("__rx"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return placed.join(cells, same, "left_semi").drop("__py", "__px")


def _field(name: str):
    return lambda p: p[name]


def accepted_runs(runs: DataFrame, seen: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pixel runs (keys, run, lat, lon of its middle) inside an accepted ring, or near an accepted place without one.

    seen: keys, lat, lon, area_km2 and ring (array of (y, x) in degrees; null or empty: none). Near is within the radius of a circle of the
    place's area, and two kilometres at least.
    """
    inside = inside_rings(runs, seen.where("ring IS NOT NULL"), keys, "lat", "lon", cell)
    bare = seen.where("ring IS NULL OR size(ring) = 0").select(*keys, F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.greatest(F.lit(2.0), F.sqrt(F.greatest(F.lit(0.0), F.col("area_km2")) / F.pi())).alias("__reach"))
    classes = F.ceil(F.log2(F.col("__reach")))  # places are joined by the size of their reach, so that small ones don't look far
    far = [r[0] for r in bare.select(classes.cast("int").alias("c")).distinct().orderBy("c").collect()]  # one for each doubling of the reach
    for c in far:
        near = within_km(runs, bare.where(classes == c), "lat", "lon", "__lat", "__lon", float(2**c), keys).where(F.col("km") <= F.col("__reach"))
        inside = inside.unionByName(near.select(*runs.columns))
    return inside.distinct()


def overlay_runs(spark, sf_dir):
    """Runs of equal levels, of at most 16 pixels, that lie in valid outlines of parts of two pixels or more, or near parts whose outline isn't valid."""
    px = wet_pixels(spark, sf_dir)
    g = px.withColumn("island", F.col("x") - F.row_number().over(Window.partitionBy("frame_s", "y", "level").orderBy("x")))
    g = g.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("frame_s", "y", "level", "island").orderBy("x")) - 1) / 16))
    runs = g.groupBy("frame_s", "y", "level", "island", "chunk").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"))
    runs = runs.select("frame_s", "y", "level", "first_x", "last_x", ((F.col("y") + 0.5) * 0.1).alias("lat"), ((F.col("first_x") + F.col("last_x") + 1) * 0.05).alias("lon"))
    labelled = label(px, ["frame_s"], "y", "x").withColumnsRenamed({"__row": "first_row", "__col": "first_col"})
    part = ["frame_s", "first_row", "first_col"]
    centres = labelled.groupBy(*part).agg((F.avg(F.col("y") + 0.5) * 0.1).alias("lat"), (F.avg(F.col("x") + 0.5) * 0.1).alias("lon"), (F.count(F.lit(1)) * PIXEL_KM2).alias("area_km2"))
    shaped = outlines(labelled, part, "y", "x").where("pixels >= 2").join(centres, part)
    degrees = F.transform("ring", lambda p: F.struct((p["row"] * 0.1).alias("y"), (p["col"] * 0.1).alias("x")))
    seen = shaped.select("frame_s", "lat", "lon", "area_km2", F.when(F.col("valid"), degrees).alias("ring"))
    return accepted_runs(runs, seen, ["frame_s"], 0.5).select("frame_s", "y", "level", "first_x", "last_x")


QUERIES["F11_overlay_runs"] = overlay_runs
_OUT = ORACLES["R6_R7_outlines"]
ORACLES["F11_overlay_runs"] = _OUT[: _OUT.rindex("SELECT frame_s, p[1]")] + f"""
    , judged AS (SELECT frame_s, p, pixels, rings = 1 AND abs(area / pixels - 1) <= {AREA_TOLERANCE} AS valid FROM largest JOIN sized USING (frame_s, p) WHERE pixels >= 2),
    centres AS (SELECT frame_s, p, avg(y + 0.5e0) * 0.1e0 AS c_lat, avg(x + 0.5e0) * 0.1e0 AS c_lon, valid, pixels FROM part JOIN judged USING (frame_s, p) GROUP BY ALL),
    islands AS (SELECT frame_s, y, x, level, p, x - row_number() OVER (PARTITION BY frame_s, y, level ORDER BY x) AS island FROM px JOIN part USING (frame_s, y, x)),
    chunks AS (SELECT *, (row_number() OVER (PARTITION BY frame_s, y, level, island ORDER BY x) - 1) // 16 AS chunk FROM islands),
    runs AS (SELECT frame_s, y, level, p, min(x) AS first_x, max(x) AS last_x, (y + 0.5e0) * 0.1e0 AS lat, (min(x) + max(x) + 1) * 0.05e0 AS lon FROM chunks GROUP BY frame_s, y, level, island, chunk, p)
    SELECT frame_s, y, level, first_x, last_x FROM runs r WHERE EXISTS (
        SELECT 1 FROM centres c WHERE c.frame_s = r.frame_s AND CASE WHEN c.valid THEN c.p = r.p ELSE {geo.haversine_sql('r.lat', 'r.lon', 'c_lat', 'c_lon')} <= greatest(2e0, sqrt(pixels * {PIXEL_KM2}e0 / pi())) END)
"""
