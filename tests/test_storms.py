import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.functions import relational
from squallframe.operators import rasters, storms
from squallframe.operators.observing import routed
from squallframe.operators.storms import CYCLE_S, Region

DATA = "/root/testdata/sf0.001"


def lightning(at, lat, lon):
    return ("lightning", at, lat, lon, 0, None, 1.0, None)


def radar(at, lat, lon, intensity=3, weight=1.0, system=None):
    return ("radar", at, lat, lon, intensity, None, weight, system)


def rain(at, lat, lon, mm):
    return ("rain", at, lat, lon, 0, mm, 1.0, None)


def numbers(region):
    return [(s.number, s.resting) for s in region.storms]


def test_near_rows_join_a_storm_and_far_ones_open_one():
    region = Region()
    region.cycle(0, [lightning(1, 51.0, 5.0), lightning(2, 51.2, 5.0), lightning(3, 53.0, 5.0)])  # 22 km and 200 km
    assert numbers(region) == [(1, False), (2, False)]
    assert [s.n_strikes for s in region.storms] == [2, 1]


def test_cells_reach_further_than_the_centre():
    region = Region()
    region.cycle(0, [radar(1, 51.0, 5.0), radar(2, 51.25, 5.0), radar(3, 51.5, 5.0)])  # each 28 km from the one before
    assert [s.n_cells for s in region.storms] == [3]


def test_cells_of_a_known_system_join_at_any_distance():
    region = Region()
    region.cycle(0, [radar(1, 51.0, 5.0, system="a"), radar(2, 53.0, 5.0, system="a"), radar(3, 53.0, 5.0)])
    assert [s.n_cells for s in region.storms] == [3]


def test_centre_is_the_newest_frames_weighed_mean_else_the_decayed_strikes():
    region = Region()
    region.cycle(0, [radar(10, 51.0, 5.0), radar(20, 51.0, 5.0, weight=3.0), radar(20, 51.2, 5.0)])
    assert (region.storms[0].basis, region.storms[0].lat) == ("radar", pytest.approx(51.05))
    region = Region()
    region.cycle(0, [lightning(50, 51.0, 5.0), lightning(200, 51.1, 5.0)])
    assert (region.storms[0].basis, region.storms[0].lat) == ("lightning", pytest.approx((51.0 * 0.5 + 51.1) / 1.5))


def test_gauges_count_near_the_centre_and_never_open_a_storm():
    region = Region()
    region.cycle(0, [rain(1, 51.0, 5.0, 1.0)])
    assert region.storms == []
    region.cycle(300, [radar(301, 51.0, 5.0), rain(302, 51.4, 5.0, 0.1), rain(303, 51.4, 5.0, 0.0), rain(304, 52.0, 5.0, 9.0), rain(305, 51.0, 5.0, math.nan)])
    assert (region.storms[0].wet, region.storms[0].dry) == (1, 2)


def test_storms_rest_after_five_minutes_and_go_after_fifteen():
    region = Region()
    region.cycle(0, [radar(1, 51.0, 5.0)])
    region.cycle(300, [radar(301, 54.0, 5.0)])
    assert numbers(region) == [(1, False), (2, False)]
    region.cycle(600, [radar(601, 54.0, 5.0)])
    assert numbers(region) == [(1, True), (2, False)]
    region.cycle(900, [radar(901, 51.0, 5.0)])  # a resting storm gets no rows
    assert numbers(region) == [(1, True), (2, False), (3, False)]
    region.cycle(1200, [radar(1201, 54.0, 5.0)])
    assert numbers(region) == [(2, False), (3, False)]


def test_older_storm_takes_in_a_younger_one_and_moves_by_strikes():
    region = Region()
    region.cycle(0, [lightning(1, 51.0, 5.0), lightning(1, 51.5, 5.0)])  # 56 km
    assert [(s.number, s.n_strikes) for s in region.storms] == [(1, 2)]
    assert region.storms[0].lat == pytest.approx((51.0 * 2 + 51.5) / 3)  # the taken strike counts on both sides


def test_no_more_than_fifteen_active_storms():
    region = Region()
    region.cycle(0, [lightning(1, -80.0 + 8 * k, 5.0) for k in range(17)])
    assert (len(region.storms), region.dropped) == (15, 2)


def test_runs_of_a_region_are_independent_and_bad_rows_go(spark):
    schema = "region_id string, event_id long, kind string, sim_s long, lat double, lon double, intensity long, rain_mm double, weight double, system string"
    rows = [
        ("a", 1, "radar", 10, 51.0, 5.0, 2, None, None, None), ("a", 2, "radar", 1500, 51.0, 5.0, None, None, 1.0, None), ("a", 3, "radar", 1800, 51.0, 5.0, 4, None, 1.0, None),
        ("b", 1, "radar", 10, 51.0, 5.0, 2, None, 1.0, "s"), ("b", 4, "radar", 10, None, 5.0, 2, None, 1.0, "s"), (None, 5, "radar", 10, 51.0, 5.0, 2, None, 1.0, "s"),
    ]
    given = spark.createDataFrame(rows, schema)
    found = sorted((r["region_id"], r["run"], r["cycle_s"], r["storm"], r["cells"], r["strongest"]) for r in storms.follow(given, "region_id").collect())
    assert found == [("a", 0, 0, 1, 1, 2), ("a", 1, 1500, 1, 1, 0), ("a", 1, 1800, 1, 2, 4), ("b", 0, 0, 1, 1, 2)]
    assert storms.follow(given.limit(0), "region_id").collect() == []


def test_splitting_into_runs_and_batches_changes_nothing(spark):
    """All rows of a region in one go, without runs, against the query with tiny Arrow batches."""
    expected = {}
    rows = routed(spark, DATA).select("region_id", "event_id", "kind", "sim_s", "lat", "lon", "intensity", "rain_mm", "quality", "source", "blob", "frame_s").collect()
    order = {"lightning": 0, "radar": 1, "rain": 2}
    for name in {r["region_id"] for r in rows}:
        region, by_cycle = Region(), {}
        for r in sorted((r for r in rows if r["region_id"] == name), key=lambda r: (order[r["kind"]], r["sim_s"], r["event_id"])):
            system = f"{r['blob']}:{r['frame_s']}" if r["kind"] == "radar" and r["source"] == "comp" else None
            by_cycle.setdefault(r["sim_s"] // CYCLE_S * CYCLE_S, []).append((r["kind"], r["sim_s"], r["lat"], r["lon"], r["intensity"], r["rain_mm"], r["quality"] * 10, system))
        for start in sorted(by_cycle):
            region.cycle(start, by_cycle[start])
            for k, row in enumerate(region.report(start + CYCLE_S)):
                expected[name, start, k] = row[1:]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        got = storms.follow_storms(spark, DATA).orderBy("region_id", "cycle_s", "storm").collect()
    finally:
        spark.conf.set(key, before)
    place, found = {}, {}
    for r in got:
        k = place[r["region_id"], r["cycle_s"]] = place.get((r["region_id"], r["cycle_s"]), -1) + 1
        found[r["region_id"], r["cycle_s"], k] = tuple(r)[4:]
    assert found == expected


def test_repeats_go_but_not_by_way_of_dropped_rows(spark):
    schema = "event_id long, station_id long, kind string, lat double, lon double, sim_s long, r string"
    rows = [
        (1, 1, "radar", 51.0, 5.0, 10, "a"), (2, 2, "radar", 51.0005, 5.0, 11, "a"), (3, 3, "radar", 51.0005, 5.0, 12, "a"),  # 3 repeats only 2, which is gone
        (4, 1, "lightning", 51.0, 5.0, 10, "a"), (5, 9, "lightning", 51.0, 5.002, 10, "a"), (6, 9, "radar", 51.0, 5.0, 10, "b"),
        (7, 5, "rain", 51.0, 5.0, 10, "a"), (8, 5, "rain", 52.0, 6.0, 11, "a"), (9, 6, "rain", 51.0, 5.0, 10, "a"),
        (10, None, "rain", 51.0, 5.0, 10, "a"), (11, None, "rain", 51.0, 5.0, 10, "a"), (12, 1, "radar", 51.0, 5.0, None, "a"),
    ]
    given = spark.createDataFrame(rows, schema)
    assert sorted(r["event_id"] for r in storms.drop_repeats(given, ["r"]).collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 11]
    assert storms.drop_repeats(given.limit(0), ["r"]).count() == 0


def test_large_parts_are_cut_at_the_first_threshold_and_grow_back(spark):
    strip = [5, 5, 1, 1, 1, 6]  # cut at 2 into two cores; the middle pixel is two steps from both
    long = [7, 1, 1, 1, 1, 1, 1]  # its last pixel is six steps from the core
    flat = [1, 1, 1, 1]  # no threshold cuts it
    rows = [(0, y, x, v) for y, line in ((0, strip), (10, long), (20, flat), (30, [3])) for x, v in enumerate(line)]
    pixels = spark.createDataFrame([*rows, (None, 0, 0, 1)], "f int, y int, x int, v int")
    cut = rasters.cores(pixels, ["f"], "y", "x", "v", 3, [2, 4])
    found = {(r["y"], r["x"]): r["core_col"] for r in cut.collect()}
    assert [found.get((0, x)) for x in range(6)] == [0, 0, 0, 0, 5, 5]
    assert [found.get((10, x), "gone") for x in range(7)] == [0, 0, 0, 0, 0, 0, "gone"]
    assert [found[20, x] for x in range(4)] == [None] * 4 and found[30, 0] is None
    assert len(found) == 17 and rasters.cores(pixels.limit(0), ["f"], "y", "x", "v", 3, [2]).count() == 0


def crowd(rng, n, spread):
    """Rows of three cycles around places that are apart, near each other or far; some cells belong to systems."""
    cycles = []
    for start in (0, 300, 600):
        rows = []
        for rank, kind in enumerate(("lightning", "radar", "rain")):
            for at in sorted(int(start + rng.integers(0, 300)) for _ in range(n)):
                lat, lon = 50 + spread * int(rng.integers(0, 4)) + rng.normal(0, 0.05), 5 + spread * int(rng.integers(0, 3)) + rng.normal(0, 0.08)
                system = f"{int(rng.integers(0, 6))}:{start}" if kind == "radar" and rng.random() < 0.3 else None
                rows.append((kind, at, lat, lon, int(rng.integers(0, 9)), float(rng.random()) if kind == "rain" else None, float(rng.random() * 3), system))
        cycles.append((start, rows))
    return cycles


@pytest.mark.parametrize("spread", [0.0, 0.25, 0.45, 1.0, 3.0])
def test_rows_in_blocks_go_where_they_go_one_by_one(monkeypatch, spread):
    cycles = crowd(np.random.default_rng(int(spread * 100)), 150, spread)
    blocks, single = Region(), Region()
    for start, rows in cycles:
        blocks.cycle(start, rows)
        with monkeypatch.context() as m:
            m.setattr(Region, "place_block", lambda *_: 0)
            single.cycle(start, rows)
        assert repr(blocks.report(start + CYCLE_S)) == repr(single.report(start + CYCLE_S))
        assert blocks.dropped == single.dropped and [repr(s.systems) for s in blocks.storms] == [repr(s.systems) for s in single.storms]


def test_a_full_cycle_needs_few_distances(monkeypatch):
    """Each row against each cell would be 20 million distances."""
    counted, plain = [], storms.distances
    monkeypatch.setattr(storms, "distances", lambda lat, lon, lats, lons: (counted.append(np.size(lats)), plain(lat, lon, lats, lons))[1])
    rng = np.random.default_rng(1)
    region = Region()
    rows = [("radar", k // 20, 51.0 + rng.normal(0, 0.03), 5.0 + rng.normal(0, 0.03), 1, None, 1.0, None) for k in range(6000)]
    region.cycle(0, [("lightning", 1, 51.0, 5.0, 0, None, 1.0, None), *rows])
    assert [s.n_cells for s in region.storms] == [6000] and sum(counted) < 100_000


def test_strikes_are_linked_as_one_by_one(monkeypatch):
    counted, plain = [], storms.distances
    rng = np.random.default_rng(4)
    for spread, centre in ((0.3, 50.0), (1.5, 50.0), (3.0, 0.0), (0.6, 89.6), (2.0, -60.0)):
        for n in (1, 2, 60):
            lats = np.clip(centre + rng.normal(0, spread, n).round(2), -90, 90)
            lons = (179.9 + rng.normal(0, spread * (1 if abs(centre) < 80 else 40), n).round(2) + 180) % 360 - 180
            near = np.stack([plain(lats[k], lons[k], lats, lons) <= 25.0 for k in range(n)])
            for _ in range(7):
                near = near @ near
            parts = storms.linked(lats, lons, 25.0)
            assert ((parts[:, None] == parts[None, :]) == near).all()
    # a strike for each strike would be 400 million distances
    monkeypatch.setattr(storms, "distances", lambda lat, lon, lats, lons: (counted.append(np.size(lats)), plain(lat, lon, lats, lons))[1])
    assert len(set(storms.linked(50 + rng.random(20_000) * 0.2, 5 + rng.random(20_000) * 0.2, 25.0).tolist())) == 1 and sum(counted) < 200_000


def test_rows_near_any_other_without_all_pairs(spark):
    rng = np.random.default_rng(6)
    places = lambda n: [(int(rng.integers(0, 2)), float(50 + rng.integers(0, 90) / 60), float(5 + rng.integers(0, 90) / 40)) for _ in range(n)]
    left, right = places(300), places(12)
    l, r = spark.createDataFrame([(k, *p) for k, p in enumerate(left)] * 2, "id int, f int, y double, x double"), spark.createDataFrame(right, "f int, lat double, lon double")
    expected = {k for k, (f, y, x) in enumerate(left) if any(f == g and storms.distances(y, x, np.array([lat]), np.array([lon]))[0] <= 25 for g, lat, lon in right)}
    got = [row.id for row in relational.any_within_km(l, r, "y", "x", "lat", "lon", 25.0, ["f"]).collect()]
    assert len(got) == 2 * len(set(got)) and set(got) == expected and 20 < len(expected) < 280
    dense = spark.range(3000).select(F.lit(0).alias("f"), (50 + F.col("id") % 50 / 1000).alias("lat"), (5 + F.col("id") / 60_000).alias("lon"))
    joined = relational.any_within_km(dense.select("f", F.col("lat").alias("y"), F.col("lon").alias("x")), dense, "y", "x", "lat", "lon", 25.0, ["f"])
    assert joined.count() == 3000
