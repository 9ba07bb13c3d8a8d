"""Helpers that several operators are made of."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squallframe.functions.geo import EARTH_KM, haversine


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; the plan is one shuffle by key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_where_null: list[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; nulls in some columns keep the old value."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    is_new = F.lit(False)
    for k in keys:
        is_new = is_new | F.col(f"n.{k}").isNotNull()
    columns = []
    for c in old.columns:
        fresh = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old_where_null or c in keys else F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        columns.append(fresh.alias(c))
    return joined.select(*columns)


def islands(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Number runs (__island) of rows whose neighbours are at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(at)
    broke = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__broke", broke).withColumn("__island", F.sum("__broke").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__broke")


def within_km(left: DataFrame, right: DataFrame, l_lat: str, l_lon: str, r_lat: str, r_lon: str, km: float, equal: list[str] = ()) -> DataFrame:
    """Pairs of rows at most ``km`` apart, by an equi-join on cells of a grid and the exact distance (column km).

    Bands of latitude are ``km`` high. Each is cut into columns that are as wide as ``km`` is at the highest latitude of the band
    and its neighbours, so that right rows need to stand in their own and the neighbouring cells only; longitudes wrap
    around, and bands near the poles, where fewer than three columns fit, are taken whole.
    """
    l, r = in_cells(left, right, l_lat, l_lon, r_lat, r_lon, km)
    out = l.join(r, ["__cy", "__cx", *equal]).withColumn("km", haversine(F.col(l_lat), F.col(l_lon), F.col(r_lat), F.col(r_lon)))
    return out.where(F.col("km") <= km).drop("__cy", "__cx")


def in_cells(left: DataFrame, right: DataFrame, l_lat: str, l_lon: str, r_lat: str, r_lon: str, km: float) -> tuple[DataFrame, DataFrame]:
    """The two sides of ``within_km`` with their cells (__cy, __cx)."""
    high = math.degrees(km / EARTH_KM) * (1 + 1e-9)
    column_of = lambda lon, columns: F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / 360.0 * columns)

    def columns_of(band: Column) -> Column:
        top = F.least(F.lit(90.0), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * high)
        sine = F.least(F.lit(1.0), math.sin(km / EARTH_KM / 2) * (1 + 1e-9) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12)))
        columns = F.floor(180.0 / F.degrees(F.asin(sine)))
        return F.when(columns >= 3, columns).otherwise(1)

    l = left.withColumn("__cy", F.floor(F.col(l_lat) / high))
    l = l.withColumn("__cx", F.least(column_of(l_lon, columns_of(F.col("__cy"))), columns_of(F.col("__cy")) - 1))
    near = F.sequence(F.lit(-1), F.lit(1))
    r = right.withColumn("__dy", F.explode(near)).withColumn("__cy", F.floor(F.col(r_lat) / high) + F.col("__dy")).withColumn("__n", columns_of(F.col("__cy")))
    r = r.withColumn("__dx", F.explode(F.when(F.col("__n") >= 3, near).otherwise(F.array(F.lit(0)))))
    r = r.withColumn("__cx", F.pmod(F.least(column_of(r_lon, F.col("__n")), F.col("__n") - 1) + F.col("__dx"), F.col("__n"))).drop("__dy", "__dx", "__n")
    return l, r


def any_within_km(left: DataFrame, right: DataFrame, l_lat: str, l_lon: str, r_lat: str, r_lon: str, km: float, equal: list[str] = ()) -> DataFrame:
    """Rows of ``left`` with any row of ``right`` at most ``km`` away, without the pairs of all of them.

    Rows are held against one place of each square of the right side first, which come as a list for each cell. Where rows have no such place within
    reach, these (and only these) go through a semi-join with all of the right side; to know that, the first step runs once more.
    """
    side = math.degrees(km / EARTH_KM) / 2
    places = right.select(*equal, r_lat, r_lon).dropna()
    squares = places.groupBy(*equal, F.floor(F.col(r_lat) / side).alias("__sy"), F.floor(F.col(r_lon) / side).alias("__sx"))
    some = squares.agg(F.min(F.struct(r_lat, r_lon)).alias("__p")).select(*equal, F.col(f"__p.{r_lat}").alias(r_lat), F.col(f"__p.{r_lon}").alias(r_lon))
    cell = ["__cy", "__cx", *equal]
    rows, near = in_cells(left, some, l_lat, l_lon, r_lat, r_lon, km)
    lists = near.groupBy(*cell).agg(F.collect_list(F.struct(F.col(r_lat).alias("lat"), F.col(r_lon).alias("lon"))).alias("__near"))
    hit = F.exists("__near", lambda p: haversine(F.col(l_lat), F.col(l_lon), p["lat"], p["lon"]) <= km)
    told = rows.join(lists, cell, "left").withColumn("__hit", F.coalesce(hit, F.lit(False)))
    found, rest = told.where("__hit").select(*left.columns), told.where("NOT __hit").select(*left.columns)
    if rest.isEmpty():
        return found
    a, b = in_cells(rest, places, l_lat, l_lon, r_lat, r_lon, km)
    same = haversine(F.col(f"a.{l_lat}"), F.col(f"a.{l_lon}"), F.col(f"b.{r_lat}"), F.col(f"b.{r_lon}")) <= km
    for c in cell:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return found.union(a.alias("a").join(b.alias("b"), same, "left_semi").select(*left.columns))
