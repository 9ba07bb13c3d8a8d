"""Rasters as tables of pixels with a dimension of frames: windows of areas, decoded pixels, cells and overlay runs of composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions import maps
from squallframe.functions.geo import steps
from squallframe.operators.observing import ORACLES, query
from squallframe.operators.rasters import label
from squallframe.sources.observations import OBS_SQL, observations, regions

#: Places on each edge of a box, the weakest echo in dBZ, pixels of the smallest cell and of the longest overlay run (fixed values).
EDGE_POINTS, MIN_DBZ, MIN_PIXELS, RUN_PIXELS = 33, 8.0, 5, 16
#: Limits of overlay levels in dBZ (fixed values).
OVERLAY_LEVELS = [(15.0, 1), (20.0, 2), (25.0, 3), (30.0, 4), (35.0, 5), (40.0, 6), (50.0, 7)]
#: The value of a missing quality where a frame names none (fixed value).
QUALITY_NODATA = -9999000.0
#: Rows and columns of the tiles by which pixels and windows are joined.
TILE = 64


def crop_windows(rows: DataFrame) -> DataFrame:
    """``rows`` (of a grid and a box) with row0, row1, col0 and col1: pixels whose rows and columns are from the first to below the second.

    The grid: projdef, xsize, ysize, xscale, yscale in metres, with y falling from 0 at the upper edge; the box: west,
    south, east, north. Its edges are projected, as straight edges needn't stay straight, and clamped to the raster.
    Rows whose box is beside the raster, has a null or can't be projected go.
    """
    share = F.transform(F.sequence(F.lit(0), F.lit(EDGE_POINTS - 1)), lambda i: i / (EDGE_POINTS - 1))
    lat, lon = (lambda s: F.col("south") + (F.col("north") - F.col("south")) * s), (lambda s: F.col("west") + (F.col("east") - F.col("west")) * s)
    place = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    edges = F.concat(
        F.transform(share, lambda s: place(F.col("south"), lon(s))), F.transform(share, lambda s: place(F.col("north"), lon(s))),
        F.transform(share, lambda s: place(lat(s), F.col("west"))), F.transform(share, lambda s: place(lat(s), F.col("east"))),
    )
    out = _projected(rows.dropna(subset=["west", "south", "east", "north"])).withColumn("__e", edges)
    out = out.withColumn("__xy", F.transform("__e", lambda e: maps.forward(F.col("__p"), e["lat"], e["lon"])))
    out = out.withColumns({"__x": F.col("__xy.x"), "__y": F.col("__xy.y")})
    low, high = (lambda c, scale: F.floor(c / F.col(scale))), (lambda c, scale: F.ceil(c / F.col(scale)))
    out = out.withColumns({
        "col0": F.greatest(F.lit(0), low(F.array_min("__x"), "xscale")), "col1": F.least(F.col("xsize"), high(F.array_max("__x"), "xscale")),
        "row0": F.greatest(F.lit(0), low(-F.array_max("__y"), "yscale")), "row1": F.least(F.col("ysize"), high(-F.array_min("__y"), "yscale")),
    })
    return out.where("size(array_compact(__xy)) > 0 AND row0 < row1 AND col0 < col1").drop("__p", "__e", "__xy", "__x", "__y")


def within_windows(pixels: DataFrame, windows: DataFrame, frame: list[str]) -> DataFrame:
    """Pixels (frame, row, col, ...) of each window of their frame: an equi-join by frame and tile, then the exact bounds.

    The hull of all windows is looked up first (four numbers), so that the scan is pruned by literal bounds of rows and columns.
    """
    hull = windows.agg(F.min("row0"), F.max("row1"), F.min("col0"), F.max("col1")).first()
    if hull[0] is None:
        hull = (0, 0, 0, 0)
    inside = pixels.where((F.col("row") >= hull[0]) & (F.col("row") < hull[1]) & (F.col("col") >= hull[2]) & (F.col("col") < hull[3]))
    tiles = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE), F.floor((F.col(b) - 1) / TILE)))
    covered = windows.withColumn("__tr", tiles("row0", "row1")).withColumn("__tc", tiles("col0", "col1"))
    tiled = inside.withColumns({"__tr": F.floor(F.col("row") / TILE), "__tc": F.floor(F.col("col") / TILE)})
    joined = tiled.join(covered, [*frame, "__tr", "__tc"]).where("row >= row0 AND row < row1 AND col >= col0 AND col < col1")
    return joined.drop("__tr", "__tc")


def decoded(pixels: DataFrame) -> DataFrame:
    """Valid pixels with ``value`` (raw * gain + offset): finite, of a finite and known quality, neither nodata nor undetect.

    Columns: raw, quality and the frame's gain, offset, nodata, undetect and quality_nodata (null: QUALITY_NODATA). Null raw or quality isn't valid.
    """
    physical = lambda c: F.col(c) * F.col("gain") + F.col("offset")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    out = pixels.withColumn("value", physical("raw"))
    known = ~F.col("value").eqNullSafe(physical("nodata")) & ~F.col("value").eqNullSafe(physical("undetect"))
    rated = F.col("quality") != F.coalesce("quality_nodata", F.lit(QUALITY_NODATA))
    return out.where(finite(F.col("value")) & finite(F.col("quality")) & known & rated)


def wet(pixels: DataFrame) -> DataFrame:
    """Decoded pixels of MIN_DBZ or more, with their overlay ``level`` from 1 to 8."""
    return pixels.where(F.col("value") >= MIN_DBZ).withColumn("level", steps(F.col("value"), OVERLAY_LEVELS, 8))


def _place(row: Column, col: Column) -> Column:
    """The place of a corner; the projection is in the column __p."""
    return maps.inverse(F.col("__p"), col * F.col("xscale"), -row * F.col("yscale"))


def _projected(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__p", maps.projection(F.col("projdef")))


def composite_cells(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of at least MIN_PIXELS wet pixels that hang together by sides: first pixel, centre on the map, area, dBZ and quality.

    ``pixels`` come from wet(), with the grid's projdef, xscale and yscale; keys are those of a raster (frame and area).
    """
    grid = ["projdef", "xscale", "yscale"]
    labelled = label(pixels.select(*keys, *grid, "row", "col", "value", "quality"), keys, "row", "col")
    out = labelled.groupBy(*keys, *grid, F.col("__row").alias("first_row"), F.col("__col").alias("first_col")).agg(
        F.count(F.lit(1)).alias("pixels"), (F.avg("row") + 0.5).alias("__r"), (F.avg("col") + 0.5).alias("__c"), F.round(F.max("value"), 2).alias("max_dbz"),
        F.round(F.avg("value"), 2).alias("mean_dbz"), F.round(F.avg("quality"), 3).alias("mean_quality"),
    )
    at = _projected(out.where(F.col("pixels") >= MIN_PIXELS)).withColumn("__at", _place(F.col("__r"), F.col("__c")))
    return at.select(
        *keys, "first_row", "first_col", "pixels", F.round("__at.lat", 5).alias("lat"), F.round("__at.lon", 5).alias("lon"),
        F.round(F.col("pixels") * F.col("xscale") * F.col("yscale") / 1e6, 3).alias("area_km2"), "max_dbz", "mean_dbz", "mean_quality",
    )


def overlay_runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of one level in a row, of at most RUN_PIXELS pixels: row, first_col, last_col, level, and places of the upper left and lower right corner."""
    row = [*keys, "row", "level"]
    of_run = Window.partitionBy(*row).orderBy("col")
    islands = pixels.withColumn("__i", F.col("col") - F.row_number().over(of_run))
    cut = islands.withColumn("__k", F.floor((F.row_number().over(Window.partitionBy(*row, "__i").orderBy("col")) - 1) / RUN_PIXELS))
    runs = cut.groupBy(*row, "__i", "__k").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.first(F.struct("projdef", "xscale", "yscale")).alias("__g"))
    runs = runs.select(*row, "first_col", "last_col", "__g.*")
    upper, lower = _place(F.col("row"), F.col("first_col")), _place(F.col("row") + 1, F.col("last_col") + 1)
    placed = _projected(runs).withColumns({"__a": upper, "__b": lower})
    return placed.select(*row, "first_col", "last_col", *(F.round(F.col(f"{s}.{c}"), 5).alias(f"{n}_{c}") for s, n in (("__a", "upper"), ("__b", "lower")) for c in ("lat", "lon")))


def axis_slices(axes: DataFrame, areas: DataFrame, grid: list[str]) -> DataFrame:
    """``areas`` (grid, low, high, ...) with ``start`` and ``stop`` of the axis values (grid, i from 0, v) between low and high, which may come in either order.

    Axes rise or fall; a slice holds at least one index and is clamped to the axis. Values on one side are counted, so
    that no axis is sorted; a null low or high, or an area without an axis, goes.
    """
    ends = axes.groupBy(*grid).agg(F.count(F.lit(1)).alias("__n"), (F.min_by("v", "i") <= F.max_by("v", "i")).alias("__rises"))
    bounded = areas.withColumns({"__id": F.monotonically_increasing_id(), "__lo": F.least("low", "high"), "__hi": F.greatest("low", "high")}).where("low IS NOT NULL AND high IS NOT NULL")
    kept = [c for c in areas.columns if c not in grid]
    # an area's columns come along as they are, so no number has to be the same in two runs
    each = bounded.join(axes, grid).join(ends, grid)
    before = F.when(F.col("__rises"), F.col("v") < F.col("__lo")).otherwise(F.col("v") > F.col("__hi"))
    until = F.when(F.col("__rises"), F.col("v") <= F.col("__hi")).otherwise(F.col("v") >= F.col("__lo"))
    counted = each.groupBy(*grid, *kept, "__id", "__n").agg(F.count_if(before).alias("__s"), F.count_if(until).alias("__e"))
    start = F.greatest(F.lit(0), F.least(F.col("__n") - 1, F.col("__s")))
    return counted.withColumn("start", start).withColumn("stop", F.greatest(F.col("start") + 1, F.least(F.col("__n"), F.col("__e")))).drop("__id", "__n", "__s", "__e")


def area_bounds(areas: DataFrame) -> DataFrame:
    """Areas (lat, lon, horizon_km, projdef) with the bounds x_low, x_high, y_low and y_high of the corners of their box that the projection shows; areas without any go."""
    up = F.col("horizon_km") / 110.574
    side = F.col("horizon_km") / (111.320 * F.greatest(F.lit(0.15), F.abs(F.cos(F.radians("lat")))))
    corners = F.array(*[F.struct((F.col("lat") + dy * up).alias("lat"), (F.col("lon") + dx * side).alias("lon")) for dy in (-1, 1) for dx in (-1, 1)])
    out = _projected(areas).withColumn("__e", corners)
    out = out.withColumn("__xy", F.array_compact(F.transform("__e", lambda e: maps.forward(F.col("__p"), e["lat"], e["lon"])))).where(F.size("__xy") > 0)
    ends = {f"{c}_{n}": f(F.col(f"__xy.{c}")) for c in "xy" for n, f in (("low", F.array_min), ("high", F.array_max))}
    return out.withColumns(ends).drop("__p", "__e", "__xy")


#: The composite of the queries: an equal-area grid around the regions.
LAT_0, LON_0, SIDE, PIXEL_M = 51.5, 6.0, 200, 2500.0
PROJDEF = f"+proj=laea +lat_0={LAT_0} +lon_0={LON_0} +x_0=250000 +y_0=-250000 +units=m +ellps=WGS84"
GAIN, OFFSET, NODATA, UNDETECT = 0.5, -5.0, -9999000.0, -8888000.0


def composite_pixels(spark, sf_dir) -> DataFrame:
    """Strongest echo and best quality of each pixel of a quarter of an hour: frame_s, row, col, raw, quality; weak qualities are nodata or undetect."""
    radar = _projected(observations(spark, sf_dir, "radar").withColumn("projdef", F.lit(PROJDEF))).withColumn("__at", maps.forward(F.col("__p"), F.col("lat"), F.col("lon")))
    at = radar.select(
        F.expr("(sim_s DIV 900) * 900").alias("frame_s"), F.floor(-F.col("__at.y") / PIXEL_M).alias("row"), F.floor(F.col("__at.x") / PIXEL_M).alias("col"), "dbz", "quality",
    )
    best = at.groupBy("frame_s", "row", "col").agg(F.max("dbz").alias("dbz"), F.max("quality").alias("quality"))
    raw = F.when(F.col("quality") < 0.05, NODATA).when(F.col("quality") < 0.1, UNDETECT).otherwise(F.floor((F.col("dbz") - OFFSET) / GAIN))
    rated = F.when(F.col("quality") >= 0.95, QUALITY_NODATA).otherwise(F.floor(F.col("quality") * 128) / 128)
    return best.select("frame_s", "row", "col", raw.alias("raw"), rated.alias("quality"))


def region_windows(spark) -> DataFrame:
    """The window of each region's box in the composite."""
    up, side = F.col("radius_km") / 2 / 111.32, F.col("radius_km") / 2 / (111.32 * F.cos(F.radians("c_lat")))
    grid = {"projdef": F.lit(PROJDEF), "xsize": F.lit(SIDE), "ysize": F.lit(SIDE), "xscale": F.lit(PIXEL_M), "yscale": F.lit(PIXEL_M)}
    boxes = regions(spark).select("region_id", (F.col("c_lon") - side).alias("west"), (F.col("c_lat") - up).alias("south"), (F.col("c_lon") + side).alias("east"), (F.col("c_lat") + up).alias("north"))
    return crop_windows(boxes.withColumns(grid))


def region_pixels(spark, sf_dir) -> DataFrame:
    pixels = composite_pixels(spark, sf_dir)
    frames = {"gain": F.lit(GAIN), "offset": F.lit(OFFSET), "nodata": F.lit(NODATA), "undetect": F.lit(UNDETECT), "quality_nodata": F.lit(None).cast("double")}
    return wet(decoded(within_windows(pixels, region_windows(spark), []).withColumns(frames)))


def _composite_sql() -> str:
    """Projections of the oracle step by step, with the constants of its grid worked out in SQL; ``wet`` holds the pixels of each region."""
    e2 = "0.0066943799901413165e0"
    q = lambda s: f"((1 - {e2}) * ({s} / (1 - {e2} * {s} * {s}) - ln((1 - sqrt({e2}) * {s}) / (1 + sqrt({e2}) * {s})) / (2 * sqrt({e2}))))"
    xy = lambda source: f"""SELECT *, rq * sqrt(2 / (1 + s1 * sb + c1 * cb * cos(dl))) * d * cb * sin(dl) + 250000 AS x, rq * sqrt(2 / (1 + s1 * sb + c1 * cb * cos(dl))) / d * (c1 * sb - s1 * cb * cos(dl)) - 250000 AS y
        FROM (SELECT *, sin(asin({q('sp')} / qp)) AS sb, cos(asin({q('sp')} / qp)) AS cb FROM (SELECT *, sin(radians(lat)) AS sp, radians(lon - {LON_0}e0) AS dl FROM {source}, k))"""  # noqa: E731
    return OBS_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f"""
    , k0 AS (SELECT {q('1.0e0')} AS qp, sin(radians({LAT_0}e0)) AS s0, cos(radians({LAT_0}e0)) AS c0),
    k AS (
        SELECT qp, asin({q('s0')} / qp) AS b1, sin(asin({q('s0')} / qp)) AS s1, cos(asin({q('s0')} / qp)) AS c1, 6378137 * sqrt(qp / 2) AS rq,
            6378137 * c0 / sqrt(1 - {e2} * s0 * s0) / (6378137 * sqrt(qp / 2) * cos(asin({q('s0')} / qp))) AS d FROM k0
    ),
    echoes AS ({xy("(SELECT sim_s // 900 * 900 AS frame_s, lat, lon, dbz, quality FROM obs WHERE kind = 'radar')")}),
    px AS (SELECT frame_s, CAST(floor(-y / {PIXEL_M}) AS BIGINT) AS r, CAST(floor(x / {PIXEL_M}) AS BIGINT) AS c, max(dbz) AS dbz, max(quality) AS quality FROM echoes GROUP BY 1, 2, 3),
    boxes AS (SELECT region_id, c_lat - radius_km / 222.64e0 AS s, c_lat + radius_km / 222.64e0 AS n, c_lon - radius_km / (222.64e0 * cos(radians(c_lat))) AS w, c_lon + radius_km / (222.64e0 * cos(radians(c_lat))) AS e FROM regions),
    ring AS (
        SELECT region_id, CASE side WHEN 0 THEN s WHEN 1 THEN n ELSE s + (n - s) * i / 32 END AS lat, CASE side WHEN 2 THEN w WHEN 3 THEN e ELSE w + (e - w) * i / 32 END AS lon
        FROM boxes, range(33) a(i), range(4) b(side)
    ),
    placed AS ({xy('ring')}),
    windows AS (
        SELECT region_id, greatest(0, CAST(floor(min(x) / {PIXEL_M}) AS BIGINT)) AS col0, least({SIDE}, CAST(ceil(max(x) / {PIXEL_M}) AS BIGINT)) AS col1,
            greatest(0, CAST(floor(-max(y) / {PIXEL_M}) AS BIGINT)) AS row0, least({SIDE}, CAST(ceil(-min(y) / {PIXEL_M}) AS BIGINT)) AS row1
        FROM placed GROUP BY 1
    ),
    steps AS (SELECT frame_s, r, c, floor((dbz + 5) / 0.5e0) * 0.5e0 - 5 AS dbz, floor(quality * 128) / 128 AS quality FROM px WHERE quality >= 0.1 AND quality < 0.95),
    wet AS (
        SELECT region_id, frame_s, row0, row1, col0, col1, r, c, dbz, quality, CASE WHEN dbz < 15 THEN 1 WHEN dbz < 20 THEN 2 WHEN dbz < 25 THEN 3 WHEN dbz < 30 THEN 4 WHEN dbz < 35 THEN 5 WHEN dbz < 40 THEN 6 WHEN dbz < 50 THEN 7 ELSE 8 END AS level
        FROM steps JOIN windows ON r >= row0 AND r < row1 AND c >= col0 AND c < col1 WHERE dbz >= 8
    )
    """


COMPOSITE_SQL = _composite_sql()


def _place_sql(r: str, c: str, source: str) -> str:
    """Rows of a source with the place (lat, lon in degrees, to five places) of a corner of the raster."""
    e2 = "0.0066943799901413165e0"
    return f"""SELECT * EXCLUDE (qp, b1, s1, c1, rq, d, dx, dy, rho, ce, bb), round(degrees(bb + ({e2} / 3 + 31 * {e2} ** 2 / 180 + 517 * {e2} ** 3 / 5040) * sin(2 * bb) + (23 * {e2} ** 2 / 360 + 251 * {e2} ** 3 / 3780) * sin(4 * bb) + 761 * {e2} ** 3 / 45360 * sin(6 * bb)), 5) AS lat,
        round({LON_0}e0 + degrees(atan2(dx * sin(ce), d * rho * c1 * cos(ce) - d * d * dy * s1 * sin(ce))), 5) AS lon
        FROM (SELECT *, asin(cos(ce) * s1 + dy * d * sin(ce) * c1 / rho) AS bb FROM (SELECT *, 2 * asin(rho / (2 * rq)) AS ce FROM (SELECT *, sqrt((dx / d) ** 2 + (dy * d) ** 2) AS rho
        FROM (SELECT *, ({c}) * {PIXEL_M} - 250000 AS dx, -({r}) * {PIXEL_M} + 250000 AS dy FROM {source}, k))))"""


ORACLES["S13_S14_composite_windows"] = COMPOSITE_SQL + """
SELECT region_id, frame_s, row0, row1, col0, col1, count(*) AS pixels, max(dbz) AS max_dbz, CAST(sum(level) AS BIGINT) AS levels, min(r) AS first_row, max(c) AS last_col FROM wet GROUP BY ALL
"""


@query("S13_S14_composite_windows")
def composite_windows(spark, sf_dir):
    """Wet pixels of each region's window in each frame of the composite, with the window's bounds."""
    group = ["region_id", "frame_s", "row0", "row1", "col0", "col1"]
    return region_pixels(spark, sf_dir).groupBy(*group).agg(F.count(F.lit(1)).alias("pixels"), F.max("value").alias("max_dbz"), F.sum("level").alias("levels"), F.min("row").alias("first_row"), F.max("col").alias("last_col"))


ORACLES["S13_R8_composite_cells"] = COMPOSITE_SQL + f"""
, reach AS (
    SELECT region_id, frame_s, r, c, r AS r2, c AS c2 FROM wet
    UNION
    SELECT a.region_id, a.frame_s, a.r, a.c, b.r, b.c FROM reach a JOIN wet b ON a.region_id = b.region_id AND a.frame_s = b.frame_s AND abs(a.r2 - b.r) + abs(a.c2 - b.c) = 1
),
part AS (SELECT region_id, frame_s, r, c, min((r2, c2)) AS p FROM reach GROUP BY ALL),
summed AS (
    SELECT region_id, frame_s, p[1] AS first_row, p[2] AS first_col, count(*) AS pixels, avg(r) + 0.5e0 AS mr, avg(c) + 0.5e0 AS mc, round(max(dbz), 2) AS max_dbz, round(avg(dbz), 2) AS mean_dbz,
        round(avg(quality), 3) AS mean_quality
    FROM part JOIN wet USING (region_id, frame_s, r, c) GROUP BY ALL HAVING count(*) >= {MIN_PIXELS}
)
SELECT * EXCLUDE (mr, mc), round(pixels * {PIXEL_M} * {PIXEL_M} / 1e6, 3) AS area_km2 FROM ({_place_sql('mr', 'mc', 'summed')})
"""


@query("S13_R8_composite_cells")
def region_cells(spark, sf_dir):
    """Cells of each region's window in each frame, placed on the map."""
    return composite_cells(region_pixels(spark, sf_dir), ["region_id", "frame_s"])


ORACLES["S13_R5_overlay_runs"] = COMPOSITE_SQL + f"""
, g AS (SELECT *, c - row_number() OVER (PARTITION BY region_id, frame_s, r, level ORDER BY c) AS island FROM wet),
h AS (SELECT *, (row_number() OVER (PARTITION BY region_id, frame_s, r, level, island ORDER BY c) - 1) // {RUN_PIXELS} AS chunk FROM g),
runs AS (SELECT region_id, frame_s, r, level, min(c) AS first_col, max(c) AS last_col FROM h GROUP BY region_id, frame_s, r, level, island, chunk),
upper_ AS (SELECT * RENAME (lat AS upper_lat, lon AS upper_lon) FROM ({_place_sql('r', 'first_col', 'runs')}))
SELECT * RENAME (r AS "row", lat AS lower_lat, lon AS lower_lon) FROM ({_place_sql('r + 1', 'last_col + 1', 'upper_')})
"""


@query("S13_R5_overlay_runs")
def region_runs(spark, sf_dir):
    """Overlay runs of each region's window in each frame, with their corners on the map."""
    return overlay_runs(region_pixels(spark, sf_dir), ["region_id", "frame_s"])
