"""Connected parts of rasters, from tables of wet pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions import geo
from squallframe.operators.observing import ORACLES, QUERIES
from squallframe.sources.observations import OBS_SQL, observations

#: Steps to the neighbours of a pixel.
SIDES = [(-1, 0), (1, 0), (0, -1), (0, 1)]
CORNERS = [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def label(pixels: DataFrame, frame: list[str], row: str, col: str, corners: bool = False) -> DataFrame:
    """Wet pixels with the smallest pixel of their part (__row, __col); a frame's raster is labelled in one task.

    Parts hang together by sides, or also by corners. Each pixel is there once in its frame; pixels with nulls in frame,
    row or column go. A group is a raster's wet pixels, which its size bounds.
    """
    steps = SIDES + CORNERS if corners else SIDES

    def flood(group: pd.DataFrame) -> pd.DataFrame:
        places = sorted(zip(group[row].tolist(), group[col].tolist(), strict=True))
        part, wet = {}, set(places)
        for start in places:  # the first pixel of a part in this order is its smallest
            if start in part:
                continue
            part[start], edge = start, [start]
            while edge:
                y, x = edge.pop()
                for near in ((y + dy, x + dx) for dy, dx in steps):
                    if near in wet and near not in part:
                        part[near] = start
                        edge.append(near)
        first = [part[p] for p in zip(group[row].tolist(), group[col].tolist(), strict=True)]
        return group.assign(__row=[p[0] for p in first], __col=[p[1] for p in first])

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in pixels.columns) + f", __row {kinds[row]}, __col {kinds[col]}"
    return pixels.dropna(subset=[*frame, row, col]).groupBy(*frame).applyInPandas(flood, schema)


def parts(pixels: DataFrame, frame: list[str], row: str, col: str, value: str, corners: bool = False, min_pixels: int = 1) -> DataFrame:
    """Each part of at least so many pixels: its first pixel, size, centre (of pixel middles), largest and mean value."""
    labelled = label(pixels, frame, row, col, corners)
    out = labelled.groupBy(*frame, F.col("__row").alias("first_row"), F.col("__col").alias("first_col")).agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.avg(F.col(row) + 0.5), 4).alias("centre_row"), F.round(F.avg(F.col(col) + 0.5), 4).alias("centre_col"),
        F.max(value).alias("strongest"), F.round(F.avg(value), 4).alias("mean"),
    )
    return out.where(F.col("pixels") >= min_pixels)


def wet_pixels(spark, sf_dir) -> DataFrame:
    """Strongest level of each cell of 0.1 degrees in each frame, where it isn't 0."""
    radar = observations(spark, sf_dir, "radar").where("intensity > 0")
    return radar.groupBy("frame_s", geo.grid_key(F.col("lat")).alias("y"), geo.grid_key(F.col("lon")).alias("x")).agg(F.max("intensity").alias("level"))


def _parts_sql(touching: str, min_pixels: int) -> str:
    """Reachability by a recursive query: each pixel's part is the smallest pixel that it reaches."""
    return OBS_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f"""
    , px AS (
        SELECT frame_s, CAST(floor(lat / 0.1e0) AS BIGINT) AS y, CAST(floor(lon / 0.1e0) AS BIGINT) AS x, max(intensity) AS level
        FROM obs WHERE kind = 'radar' AND intensity > 0 GROUP BY 1, 2, 3
    ),
    near AS (SELECT a.frame_s, a.y, a.x, b.y AS y2, b.x AS x2 FROM px a JOIN px b ON a.frame_s = b.frame_s AND {touching}),
    reach AS (
        SELECT frame_s, y, x, y AS y2, x AS x2 FROM px
        UNION
        SELECT r.frame_s, r.y, r.x, n.y2, n.x2 FROM reach r JOIN near n ON r.frame_s = n.frame_s AND r.y2 = n.y AND r.x2 = n.x
    ),
    part AS (SELECT frame_s, y, x, min((y2, x2)) AS p FROM reach GROUP BY 1, 2, 3)
    SELECT frame_s, p[1] AS first_row, p[2] AS first_col, count(*) AS pixels, round(avg(y + 0.5e0), 4) AS centre_row, round(avg(x + 0.5e0), 4) AS centre_col,
        max(level) AS strongest, round(avg(level), 4) AS mean
    FROM part JOIN px USING (frame_s, y, x) GROUP BY 1, 2, 3 HAVING count(*) >= {min_pixels}
    """


def side_parts(spark, sf_dir):
    return parts(wet_pixels(spark, sf_dir), ["frame_s"], "y", "x", "level")


def corner_parts(spark, sf_dir):
    return parts(wet_pixels(spark, sf_dir), ["frame_s"], "y", "x", "level", corners=True, min_pixels=3)


QUERIES["R1_A22_side_parts"], ORACLES["R1_A22_side_parts"] = side_parts, _parts_sql("abs(a.y - b.y) + abs(a.x - b.x) = 1", 1)
QUERIES["R2_corner_parts"], ORACLES["R2_corner_parts"] = corner_parts, _parts_sql("greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1", 3)


#: Steps by which a core may grow back into the part it was cut from (fixed value).
GROWTH = 5


def cores(pixels: DataFrame, frame: list[str], row: str, col: str, value: str, max_pixels: int, thresholds: list[float], min_pixels: int = 1) -> DataFrame:
    """Pixels of parts (by corners, of at least so many pixels), large parts cut at the first threshold that makes them small.

    A part of more than ``max_pixels`` takes the lowest threshold whose sub-parts (of min_pixels or more) all have at most that
    many; these are its cores. A pixel of the part belongs to the core with the fewest steps to it within the part, ties
    to that of the smaller first pixel; pixels more than GROWTH steps away go. Parts that no threshold cuts stay whole.
    Returns frame, first_row, first_col (of the part), core_row, core_col (null: whole), row, col and value.
    """
    part = [*frame, "first_row", "first_col"]
    rows = label(pixels.select(*frame, row, col, value), frame, row, col, corners=True).withColumnsRenamed({"__row": "first_row", "__col": "first_col"})
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*part))).where(F.col("__n") >= min_pixels)
    mask = rows.where(F.col("__n") > max_pixels).drop("__n")
    tried = mask.withColumn("__t", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col(value) >= F.col("__t"))
    tried = label(tried, [*part, "__t"], row, col, corners=True).withColumnsRenamed({"__row": "core_row", "__col": "core_col"})
    core, cut = [*part, "__t", "core_row", "core_col"], [*part, "__t"]
    tried = tried.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*core))).where(F.col("__n") >= min_pixels)
    tried = tried.withColumn("__largest", F.max("__n").over(Window.partitionBy(*cut))).where(F.col("__largest") <= max_pixels)
    seeds = tried.withColumn("__first", F.min("__t").over(Window.partitionBy(*part))).where("__t = __first")
    grown = seeds.select(*part, row, col, value, F.lit(0).alias("__d"), "core_row", "core_col")
    moves = F.array(*[F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x")) for dy, dx in [(0, 0), *SIDES, *CORNERS]])
    for _ in range(GROWTH):
        reached = grown.drop(value).withColumn("__m", F.explode(moves)).withColumns({
            row: F.col(row) + F.col("__m.y"), col: F.col(col) + F.col("__m.x"), "__d": F.col("__d") + F.when((F.col("__m.y") == 0) & (F.col("__m.x") == 0), 0).otherwise(1),
        })
        reached = reached.join(mask, [*part, row, col]).groupBy(*part, row, col).agg(F.min(F.struct("__d", "core_row", "core_col")).alias("__o"), F.max(value).alias(value))
        grown = reached.select(*part, row, col, value, "__o.*")
    whole = rows.where(F.col("__n") <= max_pixels).drop("__n").unionByName(mask.join(seeds.select(*part).distinct(), part, "left_anti"))
    return grown.drop("__d").unionByName(whole, allowMissingColumns=True)


def cut_parts(spark, sf_dir):
    """Cells of each frame after large parts are cut: pixels, strongest level and centre."""
    rows = cores(wet_pixels(spark, sf_dir), ["frame_s"], "y", "x", "level", 3, list(range(2, 9)))
    return rows.groupBy("frame_s", "first_row", "first_col", "core_row", "core_col").agg(
        F.count(F.lit(1)).alias("pixels"), F.max("level").alias("strongest"), F.round(F.avg(F.col("y") + 0.5), 4).alias("centre_row"), F.round(F.avg(F.col("x") + 0.5), 4).alias("centre_col"),
    )


QUERIES["R3_R4_cut_parts"] = cut_parts
_PARTS = _parts_sql("greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1", 1)
ORACLES["R3_R4_cut_parts"] = _PARTS[: _PARTS.rindex("SELECT frame_s, p[1]")] + f"""
    , sized AS (SELECT frame_s, y, x, level, p, count(*) OVER (PARTITION BY frame_s, p) AS n FROM part JOIN px USING (frame_s, y, x)),
    big AS (SELECT * FROM sized WHERE n > 3),
    strong AS (SELECT frame_s, p, y, x, t FROM big JOIN (SELECT unnest(range(2, 9)) AS t) ON level >= t),
    links AS (
        SELECT a.frame_s, a.p, a.t, a.y, a.x, b.y AS y2, b.x AS x2 FROM strong a
        JOIN strong b ON a.frame_s = b.frame_s AND a.p = b.p AND a.t = b.t AND greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1
    ),
    spread AS (
        SELECT frame_s, p, t, y, x, y AS y2, x AS x2 FROM strong
        UNION
        SELECT s.frame_s, s.p, s.t, s.y, s.x, l.y2, l.x2 FROM spread s JOIN links l ON s.frame_s = l.frame_s AND s.p = l.p AND s.t = l.t AND s.y2 = l.y AND s.x2 = l.x
    ),
    subparts AS (SELECT frame_s, p, t, y, x, min((y2, x2)) AS c FROM spread GROUP BY 1, 2, 3, 4, 5),
    counted AS (SELECT *, count(*) OVER (PARTITION BY frame_s, p, t, c) AS m FROM subparts),
    chosen AS (SELECT frame_s, p, min(t) AS t FROM (SELECT frame_s, p, t FROM counted GROUP BY 1, 2, 3 HAVING max(m) <= 3) GROUP BY 1, 2),
    seeds AS (SELECT frame_s, p, y, x, c FROM counted JOIN chosen USING (frame_s, p, t)),
    growing AS (
        SELECT frame_s, p, y, x, 0 AS d, c FROM seeds
        UNION
        SELECT g.frame_s, g.p, b.y, b.x, g.d + 1, g.c FROM growing g JOIN big b ON g.frame_s = b.frame_s AND g.p = b.p
            AND greatest(abs(g.y - b.y), abs(g.x - b.x)) = 1 AND g.d < {GROWTH}
    ),
    owned AS (SELECT frame_s, p, y, x, min((d, c[1], c[2])) AS o FROM growing GROUP BY 1, 2, 3, 4),
    cells AS (
        SELECT frame_s, p, o[2] AS core_row, o[3] AS core_col, y, x FROM owned
        UNION ALL
        SELECT frame_s, p, NULL, NULL, y, x FROM sized WHERE n <= 3 OR (frame_s, p) NOT IN (SELECT (frame_s, p) FROM chosen)
    )
    SELECT frame_s, p[1] AS first_row, p[2] AS first_col, core_row, core_col, count(*) AS pixels, max(level) AS strongest,
        round(avg(y + 0.5e0), 4) AS centre_row, round(avg(x + 0.5e0), 4) AS centre_col
    FROM cells JOIN px USING (frame_s, y, x) GROUP BY 1, 2, 3, 4, 5
    """
