import math
import random

from pyspark.sql import functions as F

from squallframe.operators.topics import DIGITS, covering, geohash
from squallframe.streaming.writes import by_batch, compact, current


def halved(lat, lon, length):
    """By halving the ranges in turn."""
    ranges, places, out, even = [[-180.0, 180.0], [-90.0, 90.0]], (lon, lat), "", 0
    for _ in range(length):
        value = 0
        for _ in range(5):
            low, high = ranges[even]
            upper = places[even] >= (low + high) / 2
            ranges[even][0 if upper else 1] = (low + high) / 2
            value, even = 2 * value + upper, 1 - even
        out += DIGITS[value]
    return out


def test_geohashes(spark):
    rng = random.Random(3)
    places = [(57.64911, 10.40744), (0.0, 0.0), (-90.0, -180.0), (90.0, 180.0), (50.0, 4.21875), *((rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300))]
    rows = spark.createDataFrame(places, "lat double, lon double")
    for length in (1, 3, 8, 11):
        got = [r[0] for r in rows.select(geohash(F.col("lat"), F.col("lon"), length)).collect()]
        assert got == [halved(y, x, length) for y, x in places]
    assert halved(57.64911, 10.40744, 11) == "u4pruydqqvj"


def test_topics_cover_the_whole_circle(spark):
    areas = spark.createDataFrame([("home", 51.0, 4.0, 150.0), ("date line", -20.0, 179.9, 300.0), ("north", 89.0, 10.0, 200.0), ("small", 0.0, 0.0, 0.1)], "name string, lat double, lon double, radius double")
    topics = {}
    for r in covering(areas, "lat", "lon", "radius").collect():
        topics.setdefault(r["name"], set()).add(r.topic)
    for a in areas.collect():
        for k in range(360):
            for part in (0.1, 0.5, 0.99):
                km, way = a.radius * part, math.radians(k)
                lat = a.lat + km * math.cos(way) / 110.574
                if abs(lat) >= 90:
                    continue
                lon = a.lon + km * math.sin(way) / (111.32 * max(0.05, math.cos(math.radians(a.lat))))
                assert halved(lat, (lon + 180) % 360 - 180, 3) in topics[a["name"]]
    assert len(topics["home"]) <= 40 and {t[0] for t in topics["date line"]} >= {"r", "2"}


def test_a_batch_played_twice_changes_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/frames", "source string, frame long, point long, level int"
    write, keys = by_batch(path), ["source", "frame"]
    first = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 2, 6), ("b", 1, 3, 7), (None, 2, 4, 1)], schema)
    second = spark.createDataFrame([("a", 1, 9, 3), (None, 2, 5, 2), ("c", 3, 6, 2)], schema)
    rows = lambda: sorted(map(repr, (tuple(r) for r in current(spark, path, keys).select("source", "frame", "point", "level").collect())))
    write(first, 0)
    before = rows()
    write(first, 0)
    assert rows() == before and len(before) == 4
    write(second, 1)
    after = rows()
    assert after == sorted(map(repr, [("a", 1, 9, 3), ("b", 1, 3, 7), (None, 2, 5, 2), ("c", 3, 6, 2)]))  # all points of a frame are replaced
    write(first, 0)  # an old batch played again stays behind the newer one
    write(second, 1)
    assert rows() == after
    write(second.limit(0), 2)
    assert rows() == after
    compact(spark, path, keys, f"{tmp_path}/compact")
    assert spark.read.parquet(f"{tmp_path}/compact").count() == 4
    path = f"{tmp_path}/compact"
    assert rows() == after
    plan = current(spark, path, keys)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Window" not in plan
