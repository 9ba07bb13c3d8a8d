import math

import pytest
from pyspark.sql import functions as F

from squallframe.functions.maps import forward, inverse, projection
from squallframe.operators.composites import area_bounds, axis_slices, composite_cells, crop_windows, decoded, overlay_runs, wet, within_windows

GOES = "+proj=geos +lat_0=0 +lon_0=-75 +h=35786023 +a=6378137 +b=6356752.31414 +sweep=x"
METEOSAT = "+proj=geos +lon_0=0 +h=35785831 +sweep=y"
EUROPE = "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80"
#: The composite of the fixture: 100 x 100 pixels of a kilometre.
HOME = "+proj=laea +lat_0=51.026 +lon_0=4.478 +x_0=50000 +y_0=-50000 +units=m +ellps=WGS84"
NODATA, UNDETECT = -9999000.0, -8888000.0


def project(spark, rows):
    table = spark.createDataFrame(rows, "i int, projdef string, lat double, lon double").withColumn("p", projection(F.col("projdef")))
    there = table.withColumn("at", forward(F.col("p"), F.col("lat"), F.col("lon")))
    return there.withColumn("back", inverse(F.col("p"), F.col("at.x"), F.col("at.y"))).orderBy("i").collect()


def test_projections_equal_published_examples(spark):
    mexico = (24 + 22 / 60 + 54.433 / 3600, -(100 + 20 / 60))
    europe, mercator, goes = project(spark, [(0, EUROPE, 50.0, 5.0), (1, "EPSG:3857", *mexico), (2, GOES, 33.846162, -84.690932)])
    assert (europe["at"].x, europe["at"].y) == pytest.approx((3962799.45, 2999718.85), abs=0.01)
    assert (mercator["at"].x, mercator["at"].y) == pytest.approx((-11169055.58, 2800000.00), abs=0.01)
    assert (goes["at"].x / 35786023, goes["at"].y / 35786023) == pytest.approx((-0.024052, 0.095340), abs=1e-6)
    assert (europe.back.lat, europe.back.lon) == pytest.approx((50.0, 5.0), abs=1e-7) and (mercator.back.lat, mercator.back.lon) == pytest.approx(mexico, abs=1e-7)
    assert goes.back is None


def test_projections_go_round_and_know_their_limits(spark):
    places = [(51.026, 4.478), (60.0, -10.0), (40.0, 25.0), (-33.0, 151.0)]
    rows = project(spark, [(i, text, *p) for i, (text, p) in enumerate((t, p) for t in (HOME, "epsg:3857", HOME.replace("+ellps=WGS84", "+a=6371000 +b=6371000")) for p in places)])
    for r in rows:
        assert (r.back.lat, r.back.lon) == pytest.approx((r.lat, r.lon), abs=1e-7)
    assert (rows[0]["at"].x, rows[0]["at"].y) == pytest.approx((50000, -50000), abs=1e-6)
    far, none, unknown, under, off = project(spark, [(0, METEOSAT, 0.0, 120.0), (1, None, 1.0, 1.0), (2, "+proj=moll", 1.0, 1.0), (3, METEOSAT, 0.0, 0.0), (4, HOME, None, 1.0)])
    assert far["at"] is None and none["at"] is None and unknown["at"] is None and (under["at"].x, under["at"].y) == (0.0, 0.0)
    assert off["at"] is None or off["at"].x is None


def boxes(spark, *rows):
    grid = "xsize int, ysize int, xscale double, yscale double"
    given = [(n, HOME, 100, 100, 1000.0, 1000.0, *box) for n, *box in rows]
    return spark.createDataFrame(given, f"area string, projdef string, {grid}, west double, south double, east double, north double")


WHOLE = ("whole", 3.70, 50.50, 5.30, 51.55)
SMALL = ("small", 4.278, 50.826, 4.678, 51.226)


def test_windows_are_clamped_and_boxes_beside_the_raster_go(spark):
    got = {r.area: (r.row0, r.row1, r.col0, r.col1) for r in crop_windows(boxes(spark, WHOLE, SMALL, ("africa", 0.0, 20.0, 1.0, 21.0), ("none", None, 50.0, 5.0, 51.0))).collect()}
    assert set(got) == {"whole", "small"} and got["whole"] == (0, 100, 0, 100)
    row0, row1, col0, col1 = got["small"]
    assert 0 < row0 <= 50 < row1 < 100 and 0 < col0 <= 50 < col1 < 100
    # 0.4 degrees are about 44.5 km high and 28 km wide
    assert row1 - row0 in (45, 46, 47) and col1 - col0 in (28, 29, 30)


def composite(spark):
    blocks = {(40, 45, 60, 65): (35, 0.9), (10, 15, 10, 15): (35, 0.2), (70, 75, 70, 75): (6, 0.9), (20, 22, 80, 82): (35, 0.9), (0, 5, 0, 5): (40, 0.9)}
    raw, quality = {}, {}
    for (r0, r1, c0, c1), (dbz, q) in blocks.items():
        for r in range(r0, r1):
            for c in range(c0, c1):
                raw[r, c], quality[r, c] = (dbz + 5) / 0.5, q
    for r in range(90, 93):
        for c in range(90, 93):
            raw[r, c] = UNDETECT
    pixels = [(1, r, c, raw.get((r, c), NODATA), quality.get((r, c), 0.9)) for r in range(100) for c in range(100)]
    frame = {"gain": 0.5, "offset": -5.0, "nodata": NODATA, "undetect": UNDETECT}
    table = spark.createDataFrame(pixels, "frame int, row int, col int, raw double, quality double").withColumns({k: F.lit(v) for k, v in frame.items()})
    return table.withColumn("quality_nodata", F.lit(None).cast("double"))


def test_cells_of_the_composite(spark):
    windows = crop_windows(boxes(spark, WHOLE, SMALL))
    pixels = wet(decoded(within_windows(composite(spark), windows.withColumn("frame", F.lit(1)), ["frame"])))
    cells = {(r.area, r.first_row, r.first_col): r for r in composite_cells(pixels, ["frame", "area"]).collect()}
    assert {k[1:] for k in cells if k[0] == "whole"} == {(40, 60), (10, 10), (0, 0)} and {k[1:] for k in cells if k[0] == "small"} == {(40, 60)}
    storm = cells["whole", 40, 60]
    assert (storm.pixels, storm.area_km2, storm.max_dbz, storm.mean_dbz, storm.mean_quality) == (25, 25.0, 35.0, 35.0, 0.9)
    # its middle is 12.5 km east and 7.5 km north of the middle of the raster
    assert storm.lat == pytest.approx(51.026 + 7.5 / 111.25, abs=1e-3) and storm.lon == pytest.approx(4.478 + 12.5 / (111.4 * math.cos(math.radians(51.09))), abs=1e-3)
    runs = overlay_runs(pixels.where("area = 'whole'"), ["frame", "area"]).collect()
    assert sorted({(r.row, r.first_col, r.last_col, r.level) for r in runs if r.row in (0, 20, 40)}) == [(0, 0, 4, 7), (20, 80, 81, 6), (40, 60, 64, 6)]
    assert all(r.upper_lat > r.lower_lat and r.upper_lon < r.lower_lon for r in runs)


def test_only_known_pixels_are_decoded(spark):
    values = [(1.0, 0.5), (None, 0.5), (float("nan"), 0.5), (float("inf"), 0.5), (1.0, None), (1.0, float("nan")), (1.0, -9999000.0), (1.0, -1.0), (NODATA, 0.5), (UNDETECT, 0.5)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, raw double, quality double")
    base = rows.withColumns({"gain": F.lit(2.0), "offset": F.lit(1.0), "nodata": F.lit(NODATA), "undetect": F.lit(None).cast("double")})
    named = lambda q: sorted((r.i, r.value) for r in decoded(base.withColumn("quality_nodata", F.lit(q).cast("double"))).collect())
    undetect = (9, UNDETECT * 2 + 1)
    assert named(None) == [(0, 3.0), (7, 3.0), undetect] and named(-1.0) == [(0, 3.0), (6, 3.0), undetect]


def test_long_runs_are_cut_and_windows_prune_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "pixels")
    row = spark.range(200).select(F.lit(7).alias("row"), F.col("id").cast("int").alias("col"), F.lit(20.0).alias("value"), F.lit(1.0).alias("quality"))
    row.write.parquet(path)
    window = spark.createDataFrame([("w", 0, 10, 50, 90, HOME, 1000.0, 1000.0)], "area string, row0 int, row1 int, col0 int, col1 int, projdef string, xscale double, yscale double")
    inside = within_windows(spark.read.parquet(path), window, [])
    inside.explain("formatted")
    [pushed] = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters")]
    assert "GreaterThanOrEqual(col,50)" in pushed and "LessThan(col,90)" in pushed
    runs = overlay_runs(wet(inside), ["area"]).orderBy("first_col").collect()
    assert [(r.first_col, r.last_col, r.level) for r in runs] == [(50, 65, 3), (66, 81, 3), (82, 89, 3)]
    assert within_windows(spark.read.parquet(path), window.where("false"), []).count() == 0


def test_slices_of_rising_and_falling_axes(spark):
    axes = spark.createDataFrame([("up", i, float(i)) for i in range(10)] + [("down", i, 9.0 - i) for i in range(10)] + [("one", 0, 5.0)], "grid string, i int, v double")
    cases = [("in", 2.5, 5.0), ("turned", 5.0, 2.5), ("below", -9.0, -5.0), ("above", 20.0, 30.0), ("between", 3.2, 3.4), ("all", -1.0, 99.0), ("none", None, 1.0)]
    areas = spark.createDataFrame([(g, *c) for g in ("up", "down", "one", "missing") for c in cases], "grid string, area string, low double, high double")
    got = {(r.grid, r.area): (r.start, r.stop) for r in axis_slices(axes, areas, ["grid"]).collect()}
    up = {"in": (3, 6), "turned": (3, 6), "below": (0, 1), "above": (9, 10), "between": (4, 5), "all": (0, 10)}
    down = {"in": (4, 7), "turned": (4, 7), "below": (9, 10), "above": (0, 1), "between": (6, 7), "all": (0, 10)}
    assert got == {**{("up", k): v for k, v in up.items()}, **{("down", k): v for k, v in down.items()}, **{("one", k): (0, 1) for k in up}}


def test_bounds_of_areas_on_a_satellites_map(spark):
    areas = spark.createDataFrame([("near", 50.0, 5.0, 100.0, METEOSAT), ("behind", 0.0, 179.0, 100.0, METEOSAT)], "area string, lat double, lon double, horizon_km double, projdef string")
    [r] = area_bounds(areas).collect()
    assert r.area == "near" and 0 < r.x_low < r.x_high < 1.0e6 and 4.0e6 < r.y_low < r.y_high < 5.0e6
