import math

import numpy as np
import pytest

from squallframe.operators import motion, rasters
from squallframe.sources.observations import observations

DATA = "/root/testdata/sf0.001"


def track(seconds, east, north):
    """Points of a storm that ends at 51 N, 5 E, from kilometres as functions of hours."""
    last = seconds[-1]
    wide = 111.32 * math.cos(math.radians(51.0))
    hours = [(s - last) / 3600 for s in seconds]
    return [(s, 51.0 + north(h) / 110.574, 5.0 + east(h) / wide) for s, h in zip(seconds, hours, strict=True)]


def fitted(points):
    return motion.track_of(*(np.array(c, float) for c in zip(*points, strict=True)))


def test_straight_track_stays_linear():
    model, east, north, *_, fit, error, _, gain, n, minutes = fitted(track(range(0, 2401, 300), lambda h: 40 * h, lambda h: 30 * h))
    assert model == "linear" and n == 9 and minutes == 40 and gain == 0
    assert (round(east, 6), round(north, 6), fit, error) == (40, 30, 1, 0)


def test_accelerated_track_wins_by_its_predictions():
    model, east, north, east2, north2, fit, error, linear_error, gain, *_ = fitted(track(range(0, 3601, 300), lambda h: 40 * h + 40 * h * h, lambda h: 10 * h))
    assert model == "constant_acceleration" and fit == 1 and error == 0 and linear_error > 0.3 and gain > 0.9
    assert np.allclose([east, north, east2, north2], [40, 10, 80, 0], atol=1e-6)


def test_implausible_acceleration_or_short_history_stays_linear():
    assert fitted(track(range(0, 3601, 300), lambda h: 40 * h + 100 * h * h, lambda h: 0 * h))[0] == "linear"
    assert fitted(track(range(0, 1201, 300), lambda h: 40 * h + 40 * h * h, lambda h: 0 * h))[0] == "linear"
    assert fitted(track(range(0, 541, 60), lambda h: 40 * h + 40 * h * h, lambda h: 0 * h))[0] == "linear"


def test_points_within_a_second_replace_the_last_kept_one():
    assert list(motion.spaced(np.array([0, 0.5, 1.2, 2.3, 2.3]))) == [2, 4]  # 0.5 and 1.2 each replace the one before
    assert fitted([(0, 51.0, 5.0), (0.4, 51.1, 5.0)]) is None


def test_hindcast_refits_each_prefix():
    hours, km = np.array([0, 1, 2, 3, 4]) / 12, np.array([[0, 0], [1, 0], [2, 1], [2, 2], [5, 2]], float)
    expected = []
    for last in (3, 4):
        predicted = [np.polyval(np.polyfit(hours[:last], km[:last, k], 1), hours[last]) for k in (0, 1)]
        expected.append(math.dist(predicted, km[last]) ** 2)
    assert motion.hindcast_error(hours, km, 1) == round(math.sqrt(sum(expected) / 2), 3)


def test_movement_rejects_fast_tracks(spark):
    rows = []
    for storm, speed in ((1, 60), (2, 170)):
        rows += [(storm, *p) for p in track(range(0, 2401, 300), lambda h: speed * h, lambda h: 0 * h)]  # noqa: B023
    rows += [(3, None, 51.0, 5.0), (3, 0, 51.0, 5.0)]
    points = spark.createDataFrame(rows, "storm int, t int, lat double, lon double")
    out = {r["storm"]: r for r in motion.movement(motion.tracks(points, ["storm"], "t", "lat", "lon")).collect()}
    assert set(out) == {1, 2}
    assert (out[1]["heading"], out[1]["speed"], out[1]["confidence"]) == (90.0, 60.0, "Hoog")
    assert (out[2]["heading"], out[2]["speed"], out[2]["confidence"]) == (None, None, "Onvoldoende data")


def test_query_equals_plain_version(spark):
    places = {}
    for r in observations(spark, DATA, "radar").collect():
        places.setdefault((r["blob"], r["frame_s"] // 3600), {}).setdefault(r["frame_s"], []).append((r["lat"], r["lon"]))
    expected = {}
    for key, frames in places.items():
        points = [(s, *np.mean(frames[s], 0)) for s in sorted(frames)]
        if len(points) >= motion.LEAST_POINTS:
            expected[key] = fitted(points)
    found = {(r["blob"], r["hour"]): r for r in motion.adaptive_motion(spark, DATA).collect()}
    assert found.keys() == expected.keys()
    for key, r in found.items():
        assert (r["model"], r["points"]) == (expected[key][0], expected[key][9])
        assert r["error_km"] == pytest.approx(expected[key][6], abs=2e-3)


def test_parts_by_sides_and_corners(spark):
    wet = [(0, 0, 1), (0, 1, 3), (1, 2, 5), (2, 2, 1), (5, 5, 2)]
    rows = spark.createDataFrame([(7, *p) for p in wet] + [(8, 0, 0, 4), (8, None, 0, 4)], "f int, y int, x int, v int")
    by = lambda **o: sorted((r["f"], r["first_row"], r["first_col"], r["pixels"], r["strongest"], r["mean"]) for r in rasters.parts(rows, ["f"], "y", "x", "v", **o).collect())
    assert by() == [(7, 0, 0, 2, 3, 2.0), (7, 1, 2, 2, 5, 3.0), (7, 5, 5, 1, 2, 2.0), (8, 0, 0, 1, 4, 4.0)]
    assert by(corners=True, min_pixels=2) == [(7, 0, 0, 4, 5, 2.5)]
    assert rasters.parts(rows.limit(0), ["f"], "y", "x", "v").count() == 0
