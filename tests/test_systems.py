import pytest
from pyspark.sql import functions as F

from squallframe.operators.systems import classify, in_history, parent_frames, ring_span, with_checks

CELLS = "storm string, parent string, cell_id string, ts long, lat double, lon double, max_dbz double, area_km2 double, parent_area_km2 double, parent_footprint array<struct<lat:double,lon:double>>, n int"
WIDE = 1.6  # degrees of longitude at 51 north: about 112 km


def system(ts, storm="s", parent=None, dbz=(45.0, 55.0), width=WIDE, area=900.0, ring=None):
    name = parent or f"p{ts}"
    return [(storm, name, f"c{i}", ts, 51.0, 4.0 + width * i, d, 20.0, area, ring, 0) for i, d in enumerate(dbz)]


def rows_of(spark, *systems):
    rows = [r for s in systems for r in s]
    return spark.createDataFrame([(*r[:-1], i) for i, r in enumerate(rows)], CELLS)


def classes(spark, *systems, storms=None):
    found = classify(parent_frames(rows_of(spark, *systems), ["storm"], "n"), ["storm"], storms)
    return {r.storm: r for r in found.collect()}


def test_a_run_of_three_hours_is_confirmed(spark):
    r = classes(spark, *(system(t) for t in range(0, 10801, 900)))["s"]
    assert (r.status, r.system_type, r.reason, r.minutes, r.frames, r.since, r.latest) == ("confirmed", "mcs", "duration_confirmed", 180.0, 13, 0, 10800)
    assert (r.convective_cells, r.intense_cells, r.parent_area_km2) == (2, 1, 900.0) and r.convective_span_km == pytest.approx(111.9, abs=0.2)
    r = classes(spark, *(system(t) for t in range(300, 10801, 900)))["s"]
    assert (r.status, r.system_type, r.reason, r.frames) == ("candidate", "mcs_candidate", "duration_pending", 12)


def test_runs_end_at_gaps_and_at_frames_without_the_shape(spark):
    gap = [system(t, "gap") for t in (0, 900, 1800, 1800 + 1201, 3900)]
    even = [system(t, "even") for t in (0, 1200, 2400)]
    weak = [system(t, "weak", dbz=(45.0, 49.0) if t == 900 else (45.0, 55.0)) for t in (0, 900, 1800, 2700)]
    got = classes(spark, *gap, *even, *weak)
    assert {k: (r.frames, r.since, r.minutes) for k, r in got.items()} == {"gap": (2, 3001, 15.0), "even": (3, 0, 40.0), "weak": (2, 1800, 15.0)}


def test_reasons_of_those_that_are_none(spark):
    storms = spark.createDataFrame([(s,) for s in ("one", "dry", "small", "nothing", "lapsed")], "storm string")
    lapsed = [system(t, "lapsed") for t in range(0, 10801, 900)] + [system(11700, "lapsed", width=0.1)]
    got = classes(spark, system(0, "one", dbz=(52.0,)), system(0, "dry", dbz=(20.0, None)), system(0, "small", dbz=(45.0, 45.0), width=0.1), *lapsed, storms=storms)
    assert {k: (r.status, r.system_type, r.reason, r.frames, r.since) for k, r in got.items()} == {
        "one": ("not_mcs", "convective_cluster", "insufficient_convective_cells,insufficient_convective_span", 0, None),
        "dry": ("not_mcs", "rain_area", "insufficient_convective_cells,insufficient_convective_span,no_intense_cell", 0, None),
        "small": ("not_mcs", "convective_cluster", "insufficient_convective_span,no_intense_cell", 0, None),
        "lapsed": ("not_mcs", "convective_cluster", "insufficient_convective_span", 0, None),
        "nothing": ("not_evaluated", "unknown", "no_radar_history", 0, None),
    }
    assert classes(spark, [("x", None, "c", 0, 1.0, 1.0, 50.0, 1.0, None, None, 0), ("x", "", "c", 0, 1.0, 1.0, 50.0, 1.0, None, None, 0)]) == {}


def test_the_strongest_parent_of_a_time_counts(spark):
    r = classes(spark, system(0, parent="a", dbz=(60.0, 60.0, 60.0), width=0.1, area=9000.0), system(0, parent="b"), system(0, parent="c", width=2.0, area=500.0))["s"]
    assert (r.status, r.parent_area_km2) == ("candidate", 500.0)
    tied = classes(spark, system(0, parent="z", area=100.0), system(0, parent="a", area=100.0), system(0, parent="b", area=200.0))["s"]
    assert tied.parent_area_km2 == 200.0


def test_first_cells_decide_and_repeats_change_nothing(spark):
    ring = [(51.0, 4.0), (51.0, 5.0), (51.5, 4.5)]
    first = system(0, parent="p", area=0.0, ring=ring)
    later = [(*r[:3], 60, 10.0, 90.0, 70.0, 99.0, 700.0, None, 0) for r in first]
    [r] = parent_frames(rows_of(spark, first, later), ["storm"], "n").collect()
    assert (r.ts, r.area_km2, r.children, r.max_dbz, r.convective, r.intense, r["first"], r.shape) == (0, 20.0, 2, 55.0, 2, 1, 0, True)
    assert r.precipitation_span_km == pytest.approx(69.98, abs=0.3)


def test_spans_of_rings(spark):
    rows = [(0, None), (1, []), (2, [(51.0, 4.0)]), (3, [(0.0, 0.0), (0.0, 1.0), (0.0, 3.0), (0.0, 2.0)]), (4, [(1.0, 1.0)] * 5)]
    got = [r.km for r in spark.createDataFrame(rows, "i int, ring array<struct<lat:double,lon:double>>").select("i", ring_span(F.col("ring")).alias("km")).orderBy("i").collect()]
    assert got[:3] == [0.0, 0.0, 0.0] and got[3] == pytest.approx(333.58, abs=0.1) and got[4] == 0.0


def test_history_and_checks(spark):
    frames = spark.createDataFrame([(0,), (3600,), (3601,)], "ts long")
    hours = {(r.ts, r.hour_s // 3600) for r in in_history(frames).collect()}
    assert hours == {(0, h) for h in range(7)} | {(3600, h) for h in range(1, 8)} | {(3601, h) for h in range(2, 8)}
    found = classify(parent_frames(rows_of(spark, system(0)), ["storm"], "n"), ["storm"])
    [r] = with_checks(found).collect()
    assert r.checks.asDict() == {"convective_cells": True, "convective_span": True, "intense_cells": True, "duration": False}
    assert r.thresholds.min_convective_span_km == 100.0 and r.thresholds.max_frame_gap_minutes == 20.0 and r.thresholds.min_duration_minutes == 180.0
