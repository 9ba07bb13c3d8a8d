import random

from pyspark.sql import functions as F

from squallframe.operators import outlines

PART = "part long, y long, x long"


def drawn(spark, picture, part=1):
    return [(part, y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]


def ring_area(corners):
    return abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(corners, corners[1:] + corners[:1], strict=True))) / 2


def test_outlines_of_written_out_parts(spark):
    pictures = {
        1: ["......", "..###.", "..###.", "..###."], 2: ["#.", ".#"], 3: ["###", "#.#", "###"], 4: ["#"], 5: ["##.", ".##", "..#"], 6: ["####", "#..#", "##.#", "####"],
    }
    rows = [r for k, p in pictures.items() for r in drawn(spark, p, k)]
    got = {r.part: r for r in outlines.outlines(spark.createDataFrame(rows, PART), ["part"], "y", "x").collect()}
    corners = {k: [(p.row, p.col) for p in r.ring] for k, r in got.items()}
    assert corners[1] == [(1, 2), (1, 5), (4, 5), (4, 2)] and (got[1].pixels, got[1].area, got[1].sides, got[1].valid) == (9, 9.0, 12, True)
    assert got[2].rings == 2 and not got[2].valid  # pixels that touch at a corner are two rings
    assert (got[3].rings, got[3].area, got[3].sides, got[3].valid) == (2, 9.0, 16, False)  # a hole
    assert corners[4] == [(0, 0), (0, 1), (1, 1), (1, 0)] and got[4].valid
    assert corners[5] == [(0, 0), (0, 2), (1, 2), (1, 3), (3, 3), (3, 2), (2, 2), (2, 1), (1, 1), (1, 0)] and got[5].valid
    assert got[6].rings == 2 and got[6].area == 16.0


def test_areas_of_rings_are_pixels(spark):
    """Of random parts grown from one pixel: the outer ring's area is that of the pixels and holes."""
    rng, rows, sizes = random.Random(2), [], {}
    for part in range(40):
        pixels = {(20, 20)}
        while len(pixels) < 5 + part:
            y, x = rng.choice(sorted(pixels))
            dy, dx = rng.choice([(0, 1), (1, 0), (0, -1), (-1, 0)])
            pixels.add((y + dy, x + dx))
        dry = {(y, x) for y in range(-60, 100) for x in range(-60, 100)} - pixels
        outside, edge = set(), [(-60, -60)]
        while edge:
            p = edge.pop()
            if p in dry and p not in outside:
                outside.add(p)
                edge += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]  # a ring leads into what is open at a corner
        sizes[part] = (len(pixels), len(dry) - len(outside))
        rows += [(part, y, x) for y, x in pixels]
    for r in outlines.outlines(spark.createDataFrame(rows, PART), ["part"], "y", "x").collect():
        pixels, holes = sizes[r.part]
        assert r.area == ring_area([(p.row, p.col) for p in r.ring]) and r.area >= pixels
        assert r.rings > 1 or r.area == pixels
        assert r.valid == (r.rings == 1) and (holes == 0 or r.rings > 1)


def test_points_in_rings_equal_all_pairs(spark):
    rng = random.Random(7)
    rings = [(k, k % 2, [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randrange(0, 7))]) for k in range(60)]
    points = [(k, k % 3, rng.uniform(-1, 11), rng.uniform(-1, 11), "x") for k in range(400)] + [(900, None, 1.0, 1.0, "x"), (901, 1, None, 1.0, "x"), (7, 1, 5.0, 5.0, "x"), (7, 1, 5.0, 5.0, "x")]
    r = spark.createDataFrame([(g, [{"y": y, "x": x} for y, x in c]) for _, g, c in rings], "g long, ring array<struct<y:double,x:double>>")
    p = spark.createDataFrame(points, "id long, g long, lat double, lon double, ring string")
    found = outlines.inside_rings(p, r, ["g"], "lat", "lon", 1.5)
    assert found.columns == p.columns

    def holds(corners, y, x):
        inside = False
        for (y1, x1), (y2, x2) in zip(corners, corners[1:] + corners[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
        return len(corners) >= 3 and inside

    expected = sorted(i for i, g, y, x, _ in points if y is not None and any(h == g and holds(c, y, x) for _, h, c in rings))
    assert sorted(row.id for row in found.collect()) == expected and len(expected) > 20
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_runs_near_places_without_a_ring(spark):
    runs = spark.createDataFrame([(1, 50.0, 5.0, "a"), (1, 50.01, 5.0, "b"), (1, 50.5, 5.0, "c"), (2, 50.0, 5.0, "d"), (1, 51.0, 6.0, "e")], "k long, lat double, lon double, run string")
    box = [{"y": y, "x": x} for y, x in ((50.9, 5.9), (50.9, 6.1), (51.1, 6.1), (51.1, 5.9))]
    seen = spark.createDataFrame([(1, 50.0, 5.0, 0.0, None), (1, 50.52, 5.0, 40.0, []), (1, 40.0, 0.0, 1.0, box)], "k long, lat double, lon double, area_km2 double, ring array<struct<y:double,x:double>>")
    got = outlines.accepted_runs(runs, seen, ["k"], 0.5)
    assert sorted(r.run for r in got.collect()) == ["a", "b", "c", "e"]
    assert sorted(r.run for r in outlines.accepted_runs(runs, seen.where(F.lit(False)), ["k"], 0.5).collect()) == []


def test_zone_rings(spark):
    strikes = spark.createDataFrame([("r", 1, 50.0, 5.0, 10), ("r", 2, 50.1, 5.0, 20), ("r", 3, 52.0, 5.0, 30)], "k string, event_id long, lat double, lon double, sim_s long")
    cells = spark.createDataFrame([("r", 50.3, 5.0)], "k string, lat double, lon double")
    got = {r.zone: r for r in outlines.zone_rings(strikes, cells, ["k"]).collect()}
    assert {k: (r.strikes, r.newest_s, r.radar) for k, r in got.items()} == {1: (2, 20, True), 3: (1, 30, False)}
    assert len(got[3].ring) == 8 and max(p.lat for p in got[1].ring) > 50.2 and min(p.lat for p in got[1].ring) < 49.9
