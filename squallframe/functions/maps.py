"""Map projections of rasters as column expressions, named by the texts that rasters carry (``+proj=laea +lat_0=...``, ``EPSG:3857``)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-axes of WGS 84, height of a geostationary satellite in metres and the code of the spherical Mercator map (fixed values).
MAJOR, MINOR, HEIGHT, MERCATOR = 6378137.0, 6356752.314245179, 35786023.0, "EPSG:3857"


def let(value: Column, body) -> Column:
    """``body`` of a value that it names, so that what is used often is worked out once and generated code stays small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _authalic(sine: Column, e2: Column) -> Column:
    """q of the authalic latitude from the sine of a latitude; its limit on a sphere, where e is 0."""
    e = F.sqrt(e2)
    return F.when(e2 == 0, 2 * sine).otherwise((1 - e2) * (sine / (1 - e2 * sine * sine) - F.ln((1 - e * sine) / (1 + e * sine)) / (2 * e)))


def projection(text: Column) -> Column:
    """The parameters of a projection's text: proj (merc, laea, geos; else null), lat_0, lon_0, x_0, y_0, a, b, h, sweep, and what follows from them.

    The ellipsoid is WGS 84 without +a and +b; a null or unknown text has a null proj and projects to nulls. Meant for
    the dimension of frames, as a column of its own: higher-order functions are interpreted.
    """
    given = lambda key: F.nullif(F.regexp_extract(text, rf"\+{key}=([^ ]+)", 1), F.lit(""))
    value = lambda key, default: F.coalesce(given(key).try_cast("double"), F.lit(default)).alias(key)
    proj = F.when(F.upper(F.trim(text)) == MERCATOR, "merc").when(given("proj").isin("laea", "geos"), given("proj"))
    read = F.struct(
        proj.alias("proj"), value("lat_0", 0.0), value("lon_0", 0.0), value("x_0", 0.0), value("y_0", 0.0), value("a", MAJOR), value("b", MINOR), value("h", HEIGHT),
        F.coalesce(given("sweep"), F.lit("y")).alias("sweep"),
    )
    names = ["proj", "lat_0", "lon_0", "x_0", "y_0", "a", "b", "h", "sweep"]
    same = lambda p, more=(): [p[n].alias(n) for n in [*names, *more]]
    shaped = let(read, lambda p: F.struct(*same(p), (1 - (p["b"] / p["a"]) * (p["b"] / p["a"])).alias("e2"), F.sin(F.radians(p["lat_0"])).alias("sin0")))
    polar = let(shaped, lambda p: F.struct(*same(p, ["e2", "sin0"]), _authalic(F.lit(1.0), p["e2"]).alias("pole")))
    tilted = let(polar, lambda p: F.struct(*same(p, ["e2", "sin0", "pole"]), (_authalic(p["sin0"], p["e2"]) / p["pole"]).alias("sin1"), (p["a"] * F.sqrt(p["pole"] / 2)).alias("radius")))
    more = ["e2", "pole", "sin1", "radius"]

    def last(p: Column) -> Column:
        cos1 = F.sqrt(1 - p["sin1"] * p["sin1"])
        d = p["a"] * F.sqrt(1 - p["sin0"] * p["sin0"]) / F.sqrt(1 - p["e2"] * p["sin0"] * p["sin0"]) / (p["radius"] * cos1)
        return F.struct(*same(p, more), cos1.alias("cos1"), d.alias("d"))

    return let(tilted, last)


def forward(p: Column, lat: Column, lon: Column) -> Column:
    """x and y in metres (of geos: angles times h) of a place; null where the projection doesn't show it. ``p`` comes from projection()."""
    shifted = lambda v, x, y: F.struct((x + v["p"]["x_0"]).alias("x"), (y + v["p"]["y_0"]).alias("y"))

    def merc(v: Column) -> Column:
        return shifted(v, v["p"]["a"] * v["step"], v["p"]["a"] * F.ln(F.tan(math.pi / 4 + v["phi"] / 2)))

    def laea(v: Column) -> Column:
        def at(w: Column) -> Column:
            q, cosine = v["p"], F.sqrt(1 - w * w)
            scale = q["radius"] * F.sqrt(2 / (1 + q["sin1"] * w + q["cos1"] * cosine * F.cos(v["step"])))
            return shifted(v, scale * q["d"] * cosine * F.sin(v["step"]), scale / q["d"] * (q["cos1"] * w - q["sin1"] * cosine * F.cos(v["step"])))

        return let(_authalic(F.sin(v["phi"]), v["p"]["e2"]) / v["p"]["pole"], at)

    def geos(v: Column) -> Column:
        q, ratio = v["p"], (v["p"]["b"] / v["p"]["a"]) * (v["p"]["b"] / v["p"]["a"])

        def seen(s: Column) -> Column:
            wide = F.when(q["sweep"] == "x", F.atan2(s["y"], F.hypot(s["x"], s["z"]))).otherwise(F.atan2(s["y"], s["x"]))
            high = F.when(q["sweep"] == "x", F.atan2(s["z"], s["x"])).otherwise(F.atan2(s["z"], F.hypot(s["x"], s["y"])))
            visible = (q["a"] + q["h"]) * (q["a"] + q["h"] - s["x"]) >= s["y"] * s["y"] + s["z"] * s["z"] / ratio
            return F.when(visible, shifted(v, q["h"] * wide, q["h"] * high))

        def sight(low: Column) -> Column:
            far = q["b"] / F.sqrt(1 - q["e2"] * F.cos(low) * F.cos(low))
            x, y = q["a"] + q["h"] - far * F.cos(low) * F.cos(v["step"]), far * F.cos(low) * F.sin(v["step"])
            return let(F.struct(x.alias("x"), y.alias("y"), (far * F.sin(low)).alias("z")), seen)

        return let(F.atan(ratio * F.tan(v["phi"])), sight)

    start = F.struct(p.alias("p"), F.radians(lat).alias("phi"), F.radians(lon - p["lon_0"]).alias("step"))
    return let(start, lambda v: F.when(v["p"]["proj"] == "merc", merc(v)).when(v["p"]["proj"] == "laea", laea(v)).when(v["p"]["proj"] == "geos", geos(v)))


def inverse(p: Column, x: Column, y: Column) -> Column:
    """lat and lon of a place on a Mercator or equal-area map; null for other projections."""

    def merc(v: Column) -> Column:
        lat = F.degrees(2 * F.atan(F.exp(v["y"] / v["p"]["a"])) - math.pi / 2)
        return F.struct(lat.alias("lat"), (v["p"]["lon_0"] + F.degrees(v["x"] / v["p"]["a"])).alias("lon"))

    def laea(v: Column) -> Column:
        q = v["p"]
        wide, high = v["x"] / q["d"], v["y"] * q["d"]

        def turned(w: Column) -> Column:
            # at the origin rho and the sine of its angle are 0
            sine = F.cos(w["angle"]) * q["sin1"] + F.when(w["rho"] > 0, high * F.sin(w["angle"]) * q["cos1"] / w["rho"]).otherwise(0.0)
            across = F.atan2(wide * F.sin(w["angle"]), w["rho"] * q["cos1"] * F.cos(w["angle"]) - high * q["sin1"] * F.sin(w["angle"]))
            return F.struct(let(F.asin(sine), geodetic).alias("lat"), (q["lon_0"] + F.when(w["rho"] > 0, F.degrees(across)).otherwise(0.0)).alias("lon"))

        def geodetic(beta: Column) -> Column:
            e2, e4, e6 = q["e2"], q["e2"] * q["e2"], q["e2"] * q["e2"] * q["e2"]
            two, four = e2 / 3 + e4 * 31 / 180 + e6 * 517 / 5040, e4 * 23 / 360 + e6 * 251 / 3780
            return F.degrees(beta + two * F.sin(2 * beta) + four * F.sin(4 * beta) + e6 * 761 / 45360 * F.sin(6 * beta))

        return let(F.hypot(wide, high), lambda rho: let(F.struct(rho.alias("rho"), (2 * F.asin(rho / (2 * q["radius"]))).alias("angle")), turned))

    start = F.struct(p.alias("p"), (x - p["x_0"]).alias("x"), (y - p["y_0"]).alias("y"))
    return let(start, lambda v: F.when(v["p"]["proj"] == "merc", merc(v)).when(v["p"]["proj"] == "laea", laea(v)))
