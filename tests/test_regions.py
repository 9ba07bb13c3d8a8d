from pyspark.sql import functions as F

from squallframe.sources.observations import observations
from squallframe.streaming.frames import matched_frames
from squallframe.streaming.regions import SHARING_KM, Fleet, assigned, assigned_stream, distance, target_updates
from tests.test_state import LATE, in_two_goes, run, with_times

DATA = "/root/testdata/sf0.001"
ANTWERP, BRUSSELS, BREST, AMSTERDAM = (51.2194, 4.4025), (50.8503, 4.3517), (48.3904, -4.4861), (52.3676, 4.9041)


def walk(*updates):
    """(target, main, gone, place) in order. Gives (action, region, removed, regions, covered) of each."""
    fleet = Fleet()
    return [fleet.update(k, k, t, main, gone, *(place or (None, None)))[3:] for k, (t, main, gone, place) in enumerate(updates)]


def test_near_targets_share_a_region():
    assert walk((0, True, False, ANTWERP), (1, False, False, BRUSSELS)) == [("makes", 1, None, 1, True), ("joins", 1, None, 1, True)]


def test_a_far_target_makes_a_region_and_takes_it_along():
    got = walk((0, True, False, ANTWERP), (1, False, False, BREST), (1, False, True, None), (1, False, False, BREST))
    assert got == [("makes", 1, None, 1, True), ("makes", 2, None, 2, False), ("released", None, 2, 1, None), ("makes", 3, None, 2, False)]


def test_a_target_stays_while_it_is_near_enough():
    # from Antwerp's region (128 km) towards a nearer one: it stays; beyond 150 km it joins that one, and the empty region goes
    got = walk((0, True, False, ANTWERP), (1, False, False, (52.9, 4.9)), (0, True, False, AMSTERDAM), (0, True, False, (52.8, 4.9)))
    assert got == [("makes", 1, None, 1, True), ("makes", 2, None, 2, True), ("stays", 1, None, 2, True), ("joins", 2, 1, 1, True)]


def test_small_moves_and_missing_places_change_nothing():
    near, far = (51.2194 + 0.5 / 111.32, 4.4025), (51.2194 + 1.1 / 111.19, 4.4025)
    got = walk((0, True, False, ANTWERP), (0, True, False, near), (1, False, False, ANTWERP), (1, False, False, near), (1, False, False, None), (1, False, False, far))
    assert [g[0] for g in got] == ["makes", "still", "joins", "still", "unavailable", "stays"]
    assert walk((3, False, False, ANTWERP)) == [("makes", 1, None, 1, None)]  # nothing is covered before the main target is known
    assert walk((3, False, True, None), (3, False, False, (float("nan"), 1.0))) == [("released", None, None, 0, None), ("unavailable", None, None, 0, None)]


def test_regions_hold_their_targets(spark):
    rows = target_updates(observations(spark, DATA))
    got = {r.event_id: r for r in assigned(rows, "fleet").collect()}
    fleets = {}
    for u in sorted(rows.collect(), key=lambda u: (u.sim_s, u.event_id)):
        r = got.pop(u.event_id)
        middles, at = fleets.setdefault(u.fleet, ({}, {}))
        if r.action == "makes":
            assert r.region not in middles
            middles[r.region] = (u.lat, u.lon)
        if r.action in ("makes", "joins", "stays"):
            assert distance(*middles[r.region], u.lat, u.lon) <= SHARING_KM
            if r.action == "joins":
                assert distance(*middles[r.region], u.lat, u.lon) == min(distance(*m, u.lat, u.lon) for m in middles.values())
            at[u.target_id] = r.region
        elif r.action == "released":
            at.pop(u.target_id, None)
        if r.removed is not None:
            del middles[r.removed]
        assert set(at.values()) == set(middles) and len(middles) == r.regions and at.get(u.target_id) == r.region
    assert not got
    assert {"makes", "joins", "stays", "released", "unavailable"} <= {r.action for r in assigned(rows, "fleet").collect()}


def test_stream_equals_batch_across_a_restart(spark, tmp_path):
    rows = with_times(target_updates(observations(spark, DATA)))
    until = rows.agg(F.max("sim_s")).first()[0] - LATE
    got, _ = in_two_goes(spark, rows, lambda s: assigned_stream(s, "fleet", LATE), tmp_path)
    batch = assigned(rows.drop("at").where(F.col("sim_s") < until), "fleet").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, batch)) and len(got) > 100


def test_rows_without_a_fleet_go_and_null_flags_are_false(spark):
    rows = spark.createDataFrame([("f", 1, 1, 7, None, None, 51.0, 4.0), (None, 2, 2, 7, None, None, 51.0, 4.0), ("f", 3, None, 7, None, None, 51.0, 4.0), ("f", 4, 3, None, None, None, 51.0, 4.0)], "fleet string, event_id long, sim_s long, target_id long, main boolean, gone boolean, lat double, lon double")
    assert [tuple(r) for r in assigned(rows, "fleet").collect()] == [("f", 1, 1, 7, "makes", 1, None, 1, None)]
    assert assigned(rows.limit(0), "fleet").count() == 0


SCHEMA = "region string, source string, at timestamp, cells array<struct<y:long,x:long>>"


def test_each_pair_of_frames_once_across_a_restart(spark, tmp_path):
    folder = f"{tmp_path}/in"

    def frames(*rows):
        made = spark.createDataFrame([(r, s, m * 60, c) for r, s, m, c in rows], "region string, source string, m long, cells array<struct<y:long,x:long>>")
        made.select("region", "source", F.timestamp_seconds("m").alias("at"), "cells").coalesce(1).write.mode("append").parquet(folder)

    def go():
        return run(spark, folder, SCHEMA, matched_frames, f"{tmp_path}/out", f"{tmp_path}/state")

    frames(("r", "comp", 1000, [(1, 1), (1, 2)]), ("r", "tile", 1000, [(1, 2), (2, 2), (3, 3)]), ("q", "tile", 1000, [(1, 1)]), (None, "nat", 1000, [(1, 1)]))
    frames(("r", "comp", 1000, [(9, 9)]), ("r", "nat", 1001, []))  # the first one of a frame counts; another minute isn't matched
    go()
    frames(("r", "nat", 1000, [(1, 1)]), ("r", "comp", 1100, [(1, 1)]), ("r", "comp", 1001, None))  # comes behind the restart, and is matched with both
    frames(("r", "nat", 1400, [(1, 1)]))
    frames(("r", "tile", 1400, [(1, 1)]))
    frames(("r", "tile", 1100, [(1, 1)]))  # more than 180 minutes late, by the watermark of the batch before
    query = go()
    out = spark.read.parquet(f"{tmp_path}/out").select("region", (F.unix_seconds("at") / 60).cast("int").alias("m"), "a", "b", "na", "nb", "overlap")
    assert sorted(map(tuple, out.collect())) == [
        ("r", 1000, "comp", "nat", 2, 1, 1), ("r", 1000, "comp", "tile", 2, 3, 1), ("r", 1000, "nat", "tile", 1, 3, 0), ("r", 1001, "comp", "nat", 0, 0, 0), ("r", 1400, "nat", "tile", 1, 1, 1),
    ]
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) < 18  # nine frames on both sides of two operators would be 36
