"""Geodesy and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    half = lambda x: F.pow(F.sin(x / 2), 2)
    a = half(F.radians(lat2 - lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(F.radians(lon2 - lon1))
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = EARTH_KM) -> str:
    half = lambda x: f"pow(sin(radians({x}) / 2), 2)"
    return f"(2 * {radius}e0 * asin(sqrt(least({half(f'{lat2} - {lat1}')} + cos(radians({lat1})) * cos(radians({lat2})) * {half(f'{lon2} - {lon1}')}, 1.0e0))))"


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle bearing in degrees from north, 0 to below 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def cardinal(heading: Column) -> Column:
    """One of 16 compass points."""
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor((heading + 11.25) / 22.5) % 16 + 1).cast("int"))


def grid_key(x: Column, size: float = 0.1) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def frame_minute(epoch_s: Column) -> Column:
    """Nearest minute, ties to the even one."""
    return F.bround(epoch_s / F.lit(60.0)).cast("long")


def sample_minute(epoch_s: Column) -> Column:
    return F.floor(epoch_s / F.lit(60.0)).cast("long")


def steps(x: Column, below: list[tuple[float, int]], otherwise: int) -> Column:
    """The value of the first limit that x is below."""
    out = F
    for limit, value in below:
        out = out.when(x < limit, value)
    return out.otherwise(otherwise)


#: Limits of levels in mm/h (fixed values).
RAIN_LEVELS = [(0.1, 0), (0.5, 1), (1.0, 2), (2.0, 3), (5.0, 4), (10.0, 5), (25.0, 6)]


def rain_level(mm_h: Column) -> Column:
    """Level 7 is never reached: 25 mm/h and more is 8."""
    return steps(mm_h, RAIN_LEVELS, 8)


def dbz_level(dbz: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(8), F.floor((dbz - 10) / 5).cast("int")))


def lightning_source(lon: Column) -> Column:
    """The satellite that sees lightning at a longitude (wrapped to -180..180), else none."""
    x = F.pmod(lon + 180, F.lit(360.0)) - 180
    return F.when((x >= -37.5) & (x <= 80), "meteosat").when((x >= -106) & (x < -37.5), "goes19").when((x < -106) | (x >= 145), "goes18").otherwise("none")


def planar_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1)) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, heading: Column, km: Column, radius: float = EARTH_KM) -> Column:
    """Where a great circle of a heading leads to: a struct of lat and lon."""
    d, b, p = km / radius, F.radians(heading), F.radians(lat)
    there = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(there))
    return F.struct(F.degrees(there).alias("lat"), F.degrees(east).alias("lon"))


#: Kilometres of a degree of longitude at the equator and of a degree of latitude (fixed values).
KM_EAST, KM_NORTH = 111.32, 110.574


def local_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Kilometres to the east and north of an origin, for small distances."""
    return (lon - lon0) * KM_EAST * F.cos(F.radians(lat0)), (lat - lat0) * KM_NORTH


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the Web Mercator tile that holds a point."""
    n, p = 2**zoom, F.radians(lat)
    return F.floor((lon + 180) / 360 * n), F.floor((1 - F.ln(F.tan(p) + 1 / F.cos(p)) / F.pi()) / 2 * n)


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Latitude and longitude of a tile's north-west corner."""
    n = 2**zoom
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / n)))), x / n * 360 - 180


#: Limits of overlay levels and of named intensities in dBZ (fixed values).
OVERLAY_LEVELS = [(15, 1), (20, 2), (25, 3), (30, 4), (35, 5), (40, 6), (50, 7)]
DBZ_NAMES = [(20, "zeer licht"), (30, "licht"), (40, "matig"), (50, "zwaar")]


def overlay_level(dbz: Column) -> Column:
    return steps(dbz, OVERLAY_LEVELS, 8)


def dbz_name(dbz: Column) -> Column:
    return steps(dbz, DBZ_NAMES, "zeer zwaar")


def box_changed(old: Column, new: Column, threshold: float = 0.01) -> Column:
    """Whether a side of a box (an array of its sides) has moved by more than the threshold; a box that comes or goes has."""
    moved = F.exists(F.zip_with(old, new, lambda a, b: F.abs(a - b)), lambda d: d > threshold)
    return F.when(old.isNull() | new.isNull(), ~old.eqNullSafe(new)).otherwise(moved)
