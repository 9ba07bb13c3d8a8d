"""Geohashes, and the topics of strikes that regions listen to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallframe.operators.observing import query
from squallframe.sources.observations import observations, regions

#: The digits of geohashes (fixed order), the length of topics and half the width of a cell of that length in degrees.
DIGITS, LENGTH, STEP = "0123456789bcdefghjkmnpqrstuvwxyz", 3, 1.40625 / 2


def geohash(lat: Column, lon: Column, length: int = LENGTH) -> Column:
    """The geohash of a place, of up to twelve digits: halves of longitude and latitude in turn, five bits a digit."""
    wide, high = -(-5 * length // 2), 5 * length // 2
    clamp = lambda x, n: F.greatest(F.lit(0), F.least(F.lit((1 << n) - 1), F.floor(x * (1 << n)))).cast("long")
    x, y = clamp((lon + 180) / 360, wide), clamp((lat + 90) / 180, high)
    bit = lambda i: F.shiftright(x, wide - 1 - i // 2).bitwiseAND(F.lit(1)) if i % 2 == 0 else F.shiftright(y, high - 1 - i // 2).bitwiseAND(F.lit(1))
    digits = []
    for k in range(length):
        value = sum((bit(5 * k + j) * (16 >> j) for j in range(1, 5)), bit(5 * k) * 16)
        digits.append(F.substr(F.lit(DIGITS), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*digits)


def covering(areas: DataFrame, lat: str, lon: str, radius_km: str) -> DataFrame:
    """The topics of each area: ``areas`` with each ``topic`` whose cell may touch the circle, by places half a cell apart over its box and a step around.

    Longitudes wrap around, latitudes end at the poles. An area gives as many places as its box is large, a continent's some thousands.
    """
    km = F.greatest(F.lit(1.0), F.col(radius_km).cast("double"))
    high = km / 110.574
    wide = F.least(F.lit(180.0), km / (111.320 * F.greatest(F.lit(0.05), F.abs(F.cos(F.radians(lat))))))
    places = lambda first, last: F.transform(F.sequence(F.lit(0), F.floor((last - first + 1e-9) / STEP).cast("int")), lambda k: first + k * STEP)
    south, north = F.greatest(F.lit(-90.0), F.col(lat) - high - STEP), F.least(F.lit(90.0), F.col(lat) + high + STEP)
    rows = areas.withColumn("__y", F.explode(places(south, north))).withColumn("__x", F.explode(places(F.col(lon) - wide - STEP, F.col(lon) + wide + STEP)))
    return rows.withColumn("topic", geohash(F.col("__y"), F.pmod(F.col("__x") + 180, F.lit(360.0)) - 180)).drop("__y", "__x").distinct()


def _digit(k: int) -> str:
    """A digit's SQL, from x (8 bits) and y (7 bits) of a topic's fifteen bits."""
    bits = [f"((x >> {7 - i // 2}) & 1)" if i % 2 == 0 else f"((y >> {6 - i // 2}) & 1)" for i in range(5 * k, 5 * k + 5)]
    return f"substr('{DIGITS}', CAST({' + '.join(f'{b} * {16 >> j}' for j, b in enumerate(bits))} + 1 AS BIGINT), 1)"


_TOPIC = " || ".join(_digit(k) for k in range(LENGTH))


@query("S2_S3_S4_topics", f"""
, ys AS (SELECT region_id, c_lat, c_lon, radius_km, c_lat - radius_km / 110.574e0 - {STEP}e0 + k * {STEP}e0 AS sy FROM regions, range(0, 400) r(k) WHERE k * {STEP}e0 <= 2 * radius_km / 110.574e0 + 2 * {STEP}e0 + 1e-9),
xs AS (
    SELECT ys.*, c_lon - w - {STEP}e0 + k * {STEP}e0 AS sx FROM (SELECT *, radius_km / (111.32e0 * cos(radians(c_lat))) AS w FROM ys) ys, range(0, 600) r(k) WHERE k * {STEP}e0 <= 2 * w + 2 * {STEP}e0 + 1e-9
),
covered AS (SELECT DISTINCT region_id, {_TOPIC} AS topic FROM (SELECT region_id, CAST(floor((sx + 180) / 360 * 256) AS BIGINT) AS x, CAST(floor((sy + 90) / 180 * 128) AS BIGINT) AS y FROM xs)),
strikes AS (SELECT {_TOPIC} AS topic FROM (SELECT CAST(floor((lon + 180) / 360 * 256) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 128) AS BIGINT) AS y FROM obs WHERE kind = 'lightning')),
heard AS (SELECT topic, count(*) AS strikes FROM strikes GROUP BY 1)
SELECT topic, list_aggregate(list_sort(list(region_id)), 'string_agg', ',') AS regions, coalesce(any_value(strikes), 0) AS strikes FROM covered LEFT JOIN heard USING (topic) GROUP BY 1
""")
def topics(spark, sf_dir):
    """Each topic that some region listens to: the regions, and the strikes that come by it, counted before they are joined."""
    covered = covering(regions(spark), "c_lat", "c_lon", "radius_km").groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("region_id")), ",").alias("regions"))
    heard = observations(spark, sf_dir, "lightning").groupBy(geohash(F.col("lat"), F.col("lon")).alias("topic")).agg(F.count(F.lit(1)).alias("strikes"))
    return covered.join(heard, "topic", "left").withColumn("strikes", F.coalesce("strikes", F.lit(0)))
