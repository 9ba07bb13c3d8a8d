"""Values of single rules, taken from their definitions rather than from the engine's own constants."""

import math

import pytest
from pyspark.sql import functions as F

from squallframe.functions import geo, rules


def values(spark, rows, schema, *columns):
    out = spark.createDataFrame(rows, schema).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in out]


def test_texts(spark):
    assert values(spark, [("Mijn Huis!",), ("__",), ("a--B_1",)], "x string", rules.slug(F.col("x"))) == ["mijn_huis", "target", "a_b_1"]
    assert values(spark, [("unknown",), ("12.5",), ("",), ("x",), (None,)], "x string", rules.numeric_state(F.col("x"))) == [None, 12.5, None, None, None]
    assert values(spark, [(" Yes ",), ("false",), ("on",)], "x string", rules.truth(F.col("x"))) == [True, False, True]
    assert values(spark, [("belgie",), ("nl",), ("Xx",)], "x string", rules.country(F.col("x"))) == ["BE", "NL", "XX"]
    keys = [("2026/01/02/OPERA/COMP/OPERA@20260102T0305@0@DBZH.h5",), ("2026/01/02/OPERA/COMP/OPERA@20261302T0305@0@DBZH.h5",), ("x.h5",)]
    assert values(spark, keys, "x string", rules.product_time(F.col("x")).cast("string")) == ["2026-01-02 03:05:00", None, None]
    assert values(spark, [(1.5,), (math.nan,), (math.inf,), (None,)], "x double", rules.finite(F.col("x"))) == [1.5, None, None, None]


def test_levels_and_classes(spark):
    x = F.col("x")
    assert values(spark, [(14.9,), (15.0,), (20.0,), (39.9,), (40.0,), (50.0,)], "x double", geo.overlay_level(x), geo.dbz_name(x)) == [
        (1, "zeer licht"), (2, "zeer licht"), (3, "licht"), (6, "matig"), (7, "zwaar"), (8, "zeer zwaar"),
    ]
    assert values(spark, [(None,), (-2.0,), (-1.0,), (-0.9,), (1.0,), (2.0,)], "x double", rules.pressure_class(x)) == ["onvoldoende_data", "snelle_daling", "dalend", "stabiel", "stijgend", "snelle_stijging"]


def test_geodesy(spark):
    c = [F.col(x) for x in "abcd"]
    found = values(spark, [(51.0, 5.0, 90.0, 100.0)], "a double, b double, c double, d double", geo.destination(*c))[0]
    assert found.lat == pytest.approx(50.9911, abs=1e-3) and found.lon == pytest.approx(6.4290, abs=1e-3)
    assert values(spark, [(51.0, 5.0, 52.0, 5.0), (51.0, 5.0, 51.0, 4.0)], "a double, b double, c double, d double", geo.planar_bearing(*c)) == [0.0, 270.0]
    assert values(spark, [(52.0, 6.0, 51.0, 5.0)], "a double, b double, c double, d double", *geo.local_km(*c)) == [(pytest.approx(111.32 * math.cos(math.radians(51))), pytest.approx(110.574))]
    assert values(spark, [(51.0, 4.4)], "a double, b double", *geo.tile(c[0], c[1], 7)) == [(65, 42)]
    corner = values(spark, [(65, 42)], "a int, b int", *geo.tile_corner(c[0], c[1], 7))[0]
    assert corner[0] == pytest.approx(52.4827, abs=1e-3) and corner[1] == pytest.approx(2.8125)
    boxes = [([1.0, 2.0], [1.0, 2.009]), ([1.0, 2.0], [1.02, 2.0]), (None, [1.0]), (None, None)]
    assert values(spark, boxes, "a array<double>, b array<double>", geo.box_changed(c[0], c[1])) == [False, True, True, False]


def test_status_and_confidence(spark):
    a, b, c, d, e, f = (F.col(x) for x in "abcdef")
    assert values(spark, [(True, 5, 0), (False, 2, 0), (False, 1, 9), (False, 0, 1), (False, 0, 0)], "a boolean, b int, c int", rules.tracking_status(a, b, c)) == ["sluimerend", "bevestigd", "waargenomen", "alleen_bliksem", "onvoldoende_data"]
    rows = [(3, 20.0, 1.0, 9.0, 0.9, 1.0), (6, 15.0, 1.0, 9.0, 0.8, 3.0), (6, 15.0, 1.0, 0.5, 0.8, 3.0), (5, 10.0, 1.0, 9.0, 0.55, 8.0), (5, 10.0, 1.0, 9.0, 0.9, None), (5, 10.0, None, 9.0, 0.9, 1.0)]
    assert values(spark, rows, "a int, b double, c double, d double, e double, f double", rules.motion_confidence(a, b, c, d, e, f)) == ["Onvoldoende data", "Hoog", "Matig", "Matig", "Laag", "Onvoldoende data"]
    rows = [("bevestigd", 4.0, None, None, None), ("waargenomen", 1.0, "raak", 5.0, 3.0), ("bevestigd", 9.0, "raak", 30.0, 9.0), ("bevestigd", 9.0, "mist", 30.0, 9.0), ("bevestigd", 9.0, None, 30.0, 9.0), ("bevestigd", 9.0, "raak", 91.0, -2.0), ("bevestigd", 9.0, None, None, 0.5), ("bevestigd", 9.0, None, None, None)]
    ranks = values(spark, rows, "a string, b double, c string, d double, e double", rules.candidate_rank(a, b, c, d, e))
    assert [tuple(r)[:4] for r in ranks] == [(0, 0, 0.0, 4.0), (1, 8, 0.0, 1.0), (0, 1, 30.0, 9.0), (0, 4, 0.0, 9.0), (0, 3, 30.0, 9.0), (0, 6, 0.0, 9.0), (0, 5, 0.0, 9.0), (0, 7, 0.0, 9.0)]
    rows = [("x", "Hoog", 1.0, "raak", 1.0), ("bevestigd", "Laag", 1.0, "raak", 1.0), ("bevestigd", "Hoog", None, "raak", 1.0), ("bevestigd", "Hoog", 1.0, "mist", 1.0), ("bevestigd", "Hoog", 91.0, "raak", 1.0), ("bevestigd", "Hoog", 1.0, "rand", None), ("bevestigd", "Matig", 1.0, "rand", 1.0)]
    assert values(spark, rows, "a string, b string, c double, d string, e double", rules.forecast_block(a, b, c, d, e)) == [
        "systeem_nog_niet_bevestigd", "bewegingsvector_onvoldoende_betrouwbaar", "passage_nog_niet_berekenbaar", "geen_passage_binnen_corridor", "buiten_prognosehorizon", "intensiteit_onbekend", None,
    ]
    assert values(spark, [("Hoog", 2, 0.0), ("Hoog", 9, 0.0), ("Matig", 0, 90.0), ("Matig", 3, 45.0)], "a string, b int, c double", rules.forecast_confidence(a, b, c)) == [82, 92, 40, 55]
    assert values(spark, [(40.0, 60.0, 30.0), (74.0, 60.0, 30.0), (5.0, -60.0, 30.0), (40.0, 6.0, 30.0)], "a double, b double, c double", rules.forecast_dbz(a, b, c)) == [50.0, 75.0, 0.0, 43.0]
    assert values(spark, [(11, 0.9, None), (12, 1.0, None), (50, None, 0.6), (100, 0.75, None), (12, None, None)], "a int, b double, c double", rules.transition_penalty(a, b, c), rules.transition_window(a, b, c)) == [(10, 600), (3, 600), (7, 420), (6, 300), (10, 600)]
    assert values(spark, [("naderend", True, "raak", 15.0), ("naderend", True, "rand", 46.0), ("naderend", True, "mist", 5.0), ("naderend", True, "raak", 91.0)], "a string, b boolean, c string, d double", rules.warning_stage(a, b, c, d)) == ["imminent", "vroeg", None, None]


def test_source_choice(spark):
    a, b = F.col("a"), F.col("b")
    rows = [(["kmi"], ["kmi", "opera"]), (["kmi"], ["opera"]), (["kmi", "knmi"], ["kmi", "rainviewer"]), ([], ["noaa_goes_rrqpe", "hsaf_h40b"]), ([], [])]
    assert values(spark, rows, "a array<string>, b array<string>", rules.chosen_source(a, b)) == ["kmi", "opera", "rainviewer", "hsaf_h40b", None]
    rows = [("opera", 0, 3, 0, True, 0), ("opera", 2, 3, 0, False, 0), ("opera", 2, 3, 0, False, 1), ("rainviewer", 0, 0, 5, True, 0), ("kmi", 0, 3, 0, True, 0)]
    counts = {"opera": F.col("o"), "rainviewer": F.col("r"), "hsaf_h40b": F.col("h"), "noaa_goes_rrqpe": F.lit(0)}
    found = values(spark, rows, "s string, o int, r int, h int, c boolean, k int", rules.echo_override(F.col("s"), F.array(F.lit("rainviewer"), F.lit("hsaf_h40b")), counts, F.col("c"), F.col("k")))
    assert found == ["rainviewer", "rainviewer", "opera", "hsaf_h40b", "kmi"]


def test_rings(spark):
    ring = [[float(k), 0.0] for k in range(50)]
    a = F.col("a")
    sampled, compact = values(spark, [(ring,)], "a array<array<double>>", rules.sampled_ring(a, 24), rules.compact_footprint(a))[0]
    assert [p[0] for p in sampled] == [*range(0, 50, 3), 0] and [p[0] for p in compact] == list(range(0, 48, 2))
