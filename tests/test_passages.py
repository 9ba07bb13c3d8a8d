import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.functions import shapes
from squallframe.operators import passages
from squallframe.sources.observations import EPOCH_US

STORM = "id string, s_lat double, s_lon double, heading double, speed double, confidence string, status string, model string, t_lat double, t_lon double, distance double, error_km double, east2 double, rings array<array<struct<lat:double,lon:double>>>"


def storm(name, target, **changed):
    row = {"id": name, "s_lat": 51.0, "s_lon": 4.0, "heading": 90.0, "speed": 60.0, "confidence": "Matig", "status": "alleen_bliksem", "model": "linear", "t_lat": target[0], "t_lon": target[1], "distance": 60.0, "error_km": None, "east2": None, "rings": None}
    return {**row, **changed}


def passing(spark, rows):
    df = spark.createDataFrame(rows, STORM).withColumns({"east": F.lit(None).cast("double"), "north": F.lit(None).cast("double"), "north2": F.lit(None).cast("double")})
    return {r["id"]: r for r in passages.motion_to_target(df).collect()}


def square(lat, lon, km):
    y, x = km / 110.574, km / (111.32 * math.cos(math.radians(lat)))
    return [{"lat": lat + a * y, "lon": lon + b * x} for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))]


def test_times_are_given_for_storms_that_come_nearer(spark):
    seen = dict(status="bevestigd", rings=[square(51.0, 4.0, 5.0)])
    got = passing(spark, [
        storm("east", (51.0, 5.0)), storm("west", (51.0, 3.0)), storm("unsure", (51.0, 5.0), confidence="Onvoldoende data"), storm("still", (51.0, 5.0), heading=None, speed=None),
        storm("once", (51.0, 5.0), status="waargenomen", rings=[square(51.0, 4.0, 5.0)]),
        storm("hit", (51.0, 5.0), distance=None, **seen), storm("edge", (51.1, 4.8), distance=None, **seen), storm("miss", (51.5, 4.8), distance=None, **seen), storm("inside", (51.0, 4.0), distance=0.0, **seen),
        storm("curve", (51.0, 5.0), distance=None, model="constant_acceleration", east2=40.0, error_km=2.0, **seen),
    ])
    east = got["east"]
    assert east.moving_towards and east.approach_speed == pytest.approx(60, abs=0.1) and east.eta_minutes == pytest.approx(60, abs=10)
    assert east.closest_pass_km == pytest.approx(0.5, abs=0.1) and east.closest_pass_minutes == pytest.approx(70, abs=2)
    west = got["west"]
    assert west.moving_towards is False and west.approach_speed == pytest.approx(-60, abs=0.1)
    assert (west.eta_minutes, west.closest_pass_km, west.closest_pass_minutes, west.passage) == (None,) * 4
    assert got["unsure"].moving_towards and (got["unsure"].eta_minutes, got["unsure"].closest_pass_km) == (None, None)
    for name in ("still", "once"):
        assert got[name].bearing_to_target is not None
        assert all(got[name][c] is None for c in passages.PASSAGE)
    # 70 km to go less five of the footprint, at one kilometre a minute
    assert (got["hit"].passage, got["hit"].eta_basis, got["hit"].eta_minutes) == ("raak", "radarcontour", 65.0)
    assert (got["edge"].passage, got["edge"].eta_basis) == ("rand", "onzekerheidscorridor") and got["edge"].footprint_pass_km == pytest.approx(6.1, abs=0.1)
    assert got["miss"].passage == "mist" and got["miss"].eta_minutes is None and got["miss"].footprint_pass_km == pytest.approx(50.3, abs=0.1)
    assert (got["inside"].eta_minutes, got["inside"].footprint_pass_km, got["inside"].passage) == (0.0, 0.0, "raak")
    assert got["curve"].eta_minutes < 60 and got["curve"].unsure_km > 8


def test_unsure_distance_grows_up_to_its_bound(spark):
    rows = [storm(f"{e}", (51.0, 3.9), distance=1.0, error_km=e, confidence=t) for e, t in ((0.1, "Hoog"), (100.0, "Matig"))]
    got = passing(spark, rows)
    assert got["0.1"].unsure_km == pytest.approx(4 + 0.5 * math.sqrt(0.2), abs=0.06) and got["100.0"].unsure_km <= 60


@pytest.mark.parametrize(
    ("ring", "km"),
    [([(-2, -2), (2, -2), (2, 2), (-2, 2)], 0.0), ([(3, -1), (5, -1), (5, 1), (3, 1)], 3.0), ([(3, 4)], 5.0), ([(3, 4), (3, 4)], 5.0), ([(1, -1), (1, 1)], 1.0), ([(1, 1), (2, 3)], math.sqrt(2)), ([(0, 0), (1, 0), (0, 1)], 0.0)],
)
def test_distance_to_a_ring(spark, ring, km):
    rows = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in ring],)], "ring array<struct<x:double,y:double>>")
    assert rows.select(shapes.ring_distance(F.col("ring")).alias("d")).first().d == pytest.approx(km)


def all_sides(points):
    """Corners by brute force: ends of pairs that have all other points to their left."""
    points = sorted(set(points))
    if len(points) <= 2:
        return set(points)
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    corners = set()
    for a in points:
        for b in points:
            turns = [cross(a, b, c) for c in points]
            if a != b and min(turns) >= 0 and max(turns) > 0:
                corners |= {a, b}
    # a corner is no point between two others on a line
    inner = {p for p in corners for a in corners for b in corners if a < p < b and cross(a, b, p) == 0 and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])}
    return corners - inner if corners else {points[0], points[-1]}


def test_hull_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    groups = {0: [(1.0, 1.0)], 1: [(1.0, 1.0), (1.0, 1.0), (2.0, 5.0)], 2: [(float(k), 2.0 * k) for k in range(6)], 3: [(float(x), float(y)) for x in range(5) for y in range(4)]}
    groups |= {k: [(float(a), float(b)) for a, b in rng.integers(0, 12, (int(rng.integers(3, 40)), 2))] for k in range(4, 30)}
    rows = [(k, y, x) for k, points in groups.items() for x, y in points] + [(None, 1.0, 1.0), (5, None, 2.0)]
    df = spark.createDataFrame(rows, "k long, lat double, lon double").repartition(5)
    got = {r.k: {(p.lon, p.lat) for p in r.ring} for r in shapes.hulls(df, ["k"], "lat", "lon").collect()}
    assert got == {k: all_sides(p) for k, p in groups.items()}


def test_hull_of_a_hot_group_in_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(2000).select((F.col("id") % 3).alias("k"), F.sin(F.col("id")).alias("lat"), F.cos(F.col("id") * 2).alias("lon"))
        got = {r.k: {(p.lon, p.lat) for p in r.ring} for r in shapes.hulls(df, ["k"], "lat", "lon").collect()}
        rows = df.collect()
        for k in range(3):
            x, y = (np.array([r[c] for r in rows if r.k == k]) for c in ("lon", "lat"))
            at = shapes.convex_hull(x, y)
            assert got[k] == set(zip(x[at].tolist(), y[at].tolist(), strict=True))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_status_of_a_target(spark):
    base = dict(target_id="t", distance=20.0, status="bevestigd", confidence="Matig", points=4, max_dbz=45.0, approach_speed=30.0, eta_minutes=40.0, closest_pass_minutes=50.0, passage="raak")
    none = dict(approach_speed=None, eta_minutes=None, closest_pass_minutes=None, passage=None)
    cases = {
        "naderend": [dict(base, blob=1), dict(base, blob=2, distance=3.5, status="waargenomen", **none)],
        "wegtrekkend": [dict(base, blob=1, approach_speed=-30.0, eta_minutes=None, closest_pass_minutes=None, passage=None)],
        "langs_trekkend": [dict(base, blob=1, approach_speed=0.5, eta_minutes=None, closest_pass_minutes=None, passage=None)],
        "bevestigd": [dict(base, blob=1, confidence="Laag", **none)], "waargenomen": [dict(base, blob=1, status="waargenomen", **none)],
    }
    names = ["target_id", "moment", "blob", "distance", "status", "confidence", "points", "max_dbz", "approach_speed", "eta_minutes", "closest_pass_minutes", "passage"]
    rows = [tuple({**r, "moment": name}[c] for c in names) for name, of in cases.items() for r in of]
    df = spark.createDataFrame(rows, "target_id string, moment string, blob long, distance double, status string, confidence string, points int, max_dbz double, approach_speed double, eta_minutes double, closest_pass_minutes double, passage string")
    got = {r.moment: r for r in passages.target_statuses(df, ["target_id", "moment"]).collect()}
    assert {k: r.status for k, r in got.items()} == {k: k for k in cases}
    near = got["naderend"]
    assert (near.tracked, near.nearest, near.relation, near.nearest_km, near.tracked_km) == (1, 2, "verschillende_systemen", 3.5, 20.0)
    assert (near.reason, near.stage, near.eta_reliable, near.block, near.confidence) == ("forecast_hit", "dichtbij", True, None, 64 + 6 - 13)
    assert got["waargenomen"].block == "systeem_nog_niet_bevestigd" and got["bevestigd"].block == "bewegingsvector_onvoldoende_betrouwbaar" and got["wegtrekkend"].block == "passage_nog_niet_berekenbaar"


def test_starts_of_sides_as_sql_finds_them(spark):
    """Points on a side start one too, as products of doubles tell, as in the oracle's pairs of points with all others to their left."""
    rng = np.random.default_rng(3)
    groups = {k: np.unique(np.stack([51_000 + rng.integers(0, 9, n) + 7 * k, 4_000 + rng.integers(0, 7, n) * (k % 3) + k], axis=1), axis=0) / 1000.0 for k, n in enumerate((3, 5, 9, 20, 40, 60, 90, 8, 1, 2))}
    rows = [(k, y, x) for k, points in groups.items() for y, x in points.tolist()]
    df = spark.createDataFrame(rows, "k int, lat double, lon double").repartition(3)
    got = {r.k: (r.ring, r.starts) for r in shapes.hulls(df, ["k"], "lat", "lon", starts=True).collect()}
    plain = {r.k: r.ring for r in shapes.hulls(df, ["k"], "lat", "lon").collect()}
    more = 0
    for k, points in groups.items():
        y, x = points[:, 0], points[:, 1]
        turns = (x[None, :, None] - x[:, None, None]) * (y[None, None, :] - y[:, None, None]) - (y[None, :, None] - y[:, None, None]) * (x[None, None, :] - x[:, None, None])
        flat = turns.max() <= 0
        sides = np.ones(turns.shape[:2], bool) if flat else (turns.min(axis=2) >= 0) & (turns.max(axis=2) > 0)
        starts = {(p.lat, p.lon) for p in got[k][1]}
        assert starts == set(map(tuple, points[sides.any(axis=1)].tolist()))
        assert {(p.lat, p.lon) for p in got[k][0]} == {(p.lat, p.lon) for p in plain[k]}
        more += len(starts) > len(plain[k])
    assert more > 3


def test_statuses_take_the_nearest_place_on_a_side(spark, tmp_path):
    """A footprint's eastern side runs from south to north of a target; the place in its middle is nearest, as it is in SQL."""
    at = lambda lat, lon: next(i for i in range(0, 3 * 101 * 151, 3) if (i * 7919) % 101 - 50 == lat and (i * 104729) % 151 - 75 == lon)
    ids = [at(5, 20), at(25, 20), at(45, 20), at(25, 60)]
    db = duckdb.connect()
    us = EPOCH_US + 18_000 * 60_000_000
    db.execute(f"CREATE TABLE events AS SELECT unnest({ids})::BIGINT AS event_id, make_timestamp({us}) AS ts, 0::BIGINT AS user_id, 'purchase' AS event_type, 30.0::DOUBLE AS value, '{{\"k\": 50}}' AS props")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    rows = passages.QUERIES["N5_target_statuses"](spark, str(tmp_path)).collect()
    assert {r.target_id: r.nearest_km for r in rows}["home"] == 1.4  # 2.6 to the corners
    for name in ("N5_target_statuses", "SC6_N2_passages"):
        got = [tuple(r) for r in passages.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, db.execute(passages.ORACLES[name]).fetchall()))
