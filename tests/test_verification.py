import random

import pytest

from squallframe.operators.verification import verified

CELL = "cell long, at long, lat double, lon double, quality double, mean_dbz double, max_dbz double, area_km2 double, footprint array<struct<lat:double,lon:double>>"
REFERENCE = "reference long, at long, lat double, lon double, footprint array<struct<lat:double,lon:double>>"


def cell(lat=51.0, lon=4.5, at=1000, quality=None, mean=None, high=None, area=None, ring=None):
    return (at, lat, lon, quality, mean, high, area, ring)


def reference(lat=51.0, lon=4.5, at=1000, ring=None):
    return (at, lat, lon, ring)


def verdicts(spark, cells, references):
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(cells)], CELL)
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(references)], REFERENCE)
    return sorted(verified(c, r).collect(), key=lambda row: row.cell)


@pytest.mark.parametrize("one, references, verdict", [
    (cell(quality=0.75), [], "quality"), (cell(quality=0.5), [], "quality"), (cell(quality=0.0), [], "rejected"), (cell(), [], "rejected"),
    (cell(52.60, 3.39, 1000, 0.0), [reference(52.62, 3.42, 1120)], "corroborated"), (cell(48.37, -3.65, 1000, 0.1), [reference(48.40, -3.62, 1120)], "corroborated"),
    (cell(51.0, 4.0, 1000, 0.1), [reference(51.16, 4.0, 1120)], "rejected"), (cell(50.68, 5.80, 10_000, 0.0), [reference(52.60, 3.39, 10_000), reference(50.68, 5.80, 1000)], "rejected"),
    (cell(at=1000), [reference(at=1900)], "corroborated"), (cell(at=1000), [reference(at=1901)], "rejected"), (cell(at=1000), [reference(at=100)], "corroborated"),
    (cell(quality=0.01, mean=31.0, high=52.0, area=250.0), [], "structure"), (cell(quality=0.01, mean=31.0, high=52.0, area=250.0), [reference(51.02, 4.52, 1060)], "structure"),
    (cell(quality=0.01, mean=14.0, high=47.5, area=1174.0), [], "rejected"), (cell(0.0, 179.99), [reference(0.0, -179.99)], "corroborated"), (cell(None, None), [reference()], "rejected"),
])
def test_verdicts(spark, one, references, verdict):
    [got] = verdicts(spark, [one], references)
    assert got.verdict == verdict and (got.lat, got.lon, got.footprint) == (one[1], one[2], None)


def test_a_footprint_is_held_against_and_not_its_middle(spark):
    ring = [(49.42, -3.12), (49.45, -3.08)]
    [got] = verdicts(spark, [cell(48.40, -3.60, quality=0.1, ring=ring)], [reference(49.43, -3.10, 1060)])
    assert got.verdict == "corroborated" and [tuple(p) for p in got.footprint] == ring and got.area_km2 is None


def test_only_the_confirmed_part_stays(spark):
    ring = [(49.0, 2.0), (49.1, 2.1), (50.0, 3.0), (50.1, 3.1)]
    [got] = verdicts(spark, [cell(49.55, 2.55, quality=0.01, area=400.0, ring=ring)], [reference(49.05, 2.05, 1060)])
    assert [tuple(p) for p in got.footprint] == ring[:2] and got.area_km2 == 200.0 and (got.lat, got.lon) == pytest.approx((49.05, 2.05))


def test_points_of_a_reference_inside_the_footprint_count(spark):
    ring = [(50.0, 4.0), (50.0, 6.0), (52.0, 6.0), (52.0, 4.0)]
    inner = [(51.0, 5.0), (51.1, 5.0), (51.1, 5.1), (53.0, 5.0)]
    [got] = verdicts(spark, [cell(51.0, 5.0, area=100.0, ring=ring)], [reference(60.0, 5.0, 1000, inner)])
    assert [tuple(p) for p in got.footprint] == [*inner[:3], inner[0]] and got.area_km2 == 100.0


def plain(c, references):
    """The confirmed ring, point by point."""
    from squallframe.streaming.regions import distance

    at, ring, out = c[0], c[7], []

    def inside(lat, lon):
        odd = False
        for (a, b), (p, q) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            if (a > lat) != (p > lat) and lon < (q - b) * (lat - a) / (p - a) + b:
                odd = not odd
        return odd and len(ring) >= 3

    for r in references:
        if abs(r[0] - at) <= 900:
            out += [p for p in ring if p not in out and any(distance(*p, *q) <= 12.0 for q in (r[3] or [(r[1], r[2])]))]
            for q in r[3] or []:
                if inside(*q) and q not in out:
                    out.append(q)
    return out + out[:1] if len(out) >= 3 else out


def test_equal_to_point_by_point(spark):
    rng = random.Random(5)
    spot = lambda: (50 + rng.randrange(60) / 50, 4 + rng.randrange(60) / 50)

    def ring(most):
        lat, lon = spot()
        return [(lat + rng.randrange(-15, 16) / 100, lon + rng.randrange(-15, 16) / 100) for _ in range(rng.randrange(1, most))]

    cells = [cell(*spot(), rng.randrange(4000), area=60.0, ring=ring(8)) for _ in range(60)]
    references = [reference(*spot(), rng.randrange(4000), rng.choice([None, ring(6)])) for _ in range(80)]
    references += references[:20]  # repeats confirm nothing more
    cut = 0
    for c, got in zip(cells, verdicts(spark, cells, references), strict=True):
        want = plain(c, references)
        assert got.verdict == ("corroborated" if want else "rejected")
        assert [tuple(p) for p in got.footprint] == (want or c[7])
        if want:
            cut += 1
            assert got.area_km2 == pytest.approx(60.0 * len(want) / len(c[7])) and got.lat == pytest.approx(sum(p[0] for p in want) / len(want))
    assert 10 < cut < 60


def test_no_rows_and_no_nested_loops(spark):
    assert verdicts(spark, [], [reference()]) == []
    ring = [(50.0, 4.0), (50.0, 6.0), (52.0, 6.0)]
    plan = verified(spark.createDataFrame([(1, *cell(ring=ring))], CELL), spark.createDataFrame([(1, *reference(ring=ring))], REFERENCE))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
