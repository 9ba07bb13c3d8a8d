"""Motion of storms: a straight or an accelerated track for each, whichever predicts its last points better."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallframe.functions import geo, rules
from squallframe.operators.observing import QUERIES
from squallframe.sources.observations import observations

# Points of a history, limits of plausible motion (km/h, km/h2) and what makes the accelerated track better.
MOST_POINTS, LEAST_POINTS = 20, 4
TOP_SPEED, TOP_LATER_SPEED, TOP_ACCELERATION = 150.0, 180.0, 160.0
LEAST_ACCELERATED_POINTS, LEAST_ACCELERATED_MINUTES = 6, 10.0
ERROR_MARGIN, ERROR_SHARE, FIT_GAIN = 0.25, 0.85, 0.12
RESULT = (
    "model string, east double, north double, east2 double, north2 double, fit double, error_km double, "
    "linear_error_km double, gain double, points int, minutes double"
)


def spaced(t: np.ndarray) -> np.ndarray:
    """Which points of a sorted history are kept: one less than a second after the last kept one takes its place."""
    kept: list[int] = []
    for i, at in enumerate(t):
        if kept and at - t[kept[-1]] < 1.0:
            kept[-1] = i
        else:
            kept.append(i)
    return np.array(kept, int)


def polynomial(hours: np.ndarray, km: np.ndarray, degree: int) -> np.ndarray | None:
    """Least squares coefficients, constant first, of both axes at once; None where times are too few."""
    powers = np.vander(hours, degree + 1, increasing=True)
    if np.linalg.matrix_rank(powers) <= degree:
        return None
    return np.linalg.lstsq(powers, km, rcond=None)[0]


def misses(track: np.ndarray, hours: np.ndarray, km: np.ndarray) -> np.ndarray:
    return np.hypot(*(km - np.vander(hours, len(track), increasing=True) @ track).T)


def fit_quality(track: np.ndarray, hours: np.ndarray, km: np.ndarray) -> float:
    """Mean R2 of the axes; an axis without spread counts 1 if it is met, else 0."""
    left = ((km - np.vander(hours, len(track), increasing=True) @ track) ** 2).sum(0)
    spread = ((km - km.mean(0)) ** 2).sum(0)
    r2 = [max(0.0, 1 - a / b) if b > 1e-12 else float(a <= 1e-12) for a, b in zip(left, spread, strict=True)]
    return round(sum(r2) / 2, 3)


def hindcast_error(hours: np.ndarray, km: np.ndarray, degree: int) -> float:
    """Root mean square miss of up to three last points, each predicted from all before it; else that of all points."""
    found = []
    for last in range(max(degree + 2, len(hours) - 3), len(hours)):
        track = polynomial(hours[:last], km[:last], degree)
        if track is not None:
            found.append(misses(track, hours[last : last + 1], km[last : last + 1])[0])
    if not found:
        track = polynomial(hours, km, degree)
        if track is None:
            return float("inf")
        found = misses(track, hours, km)
    return round(float(np.sqrt(np.mean(np.square(found)))), 3)


def track_of(t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple | None:
    """The track through a history (seconds, degrees) in the order of RESULT, None for less than two times."""
    order = np.argsort(t, kind="stable")
    order = order[spaced(t[order])]
    t, lat, lon = t[order], lat[order], lon[order]
    if len(t) < 2:
        return None
    wide = geo.KM_EAST * max(0.05, np.cos(np.radians(lat[-1])))
    hours, km = (t - t[-1]) / 3600, np.column_stack([(lon - lon[-1]) * wide, (lat - lat[-1]) * geo.KM_NORTH])
    straight, minutes = polynomial(hours, km, 1), (t[-1] - t[0]) / 60
    fit, error = fit_quality(straight, hours, km), hindcast_error(hours, km, 1)
    result = ("linear", *straight[1], 0.0, 0.0, fit, error, error, 0.0, len(t), minutes)
    curved = polynomial(hours, km, 2) if len(t) >= LEAST_ACCELERATED_POINTS and minutes >= LEAST_ACCELERATED_MINUTES else None
    if curved is None:
        return result
    curved_fit, curved_error = fit_quality(curved, hours, km), hindcast_error(hours, km, 2)
    plausible = np.hypot(*(2 * curved[2])) <= TOP_ACCELERATION and np.hypot(*(curved[1] + 3 * curved[2])) <= TOP_LATER_SPEED
    better = curved_error + ERROR_MARGIN < error * ERROR_SHARE or (curved_error <= error and curved_fit - fit >= FIT_GAIN)
    if plausible and better:
        gain = max(0.0, (error - curved_error) / max(error, 0.1))
        return ("constant_acceleration", *curved[1], *(2 * curved[2]), curved_fit, curved_error, error, gain, len(t), minutes)
    return result


def tracks(points: DataFrame, keys: list[str], time: str, lat: str, lon: str) -> DataFrame:
    """One track for each storm from its newest points (seconds, degrees).

    What is shuffled of a storm is at most its rows; nulls in time or place go; a storm of one time gives no row. A history
    has at most MOST_POINTS points, which the caller sees to by its keys (a storm and an hour of frames, for example):
    more are cut to the newest ones.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        newest = group.sort_values([time, lat, lon]).tail(MOST_POINTS)
        found = track_of(*(newest[c].to_numpy(float) for c in (time, lat, lon)))
        names = [*keys, *(c.split()[0] for c in RESULT.split(", "))]
        return pd.DataFrame([] if found is None else [(*group[keys].iloc[0], *found)], columns=names)

    chosen = points.select(*keys, time, lat, lon).dropna(subset=[time, lat, lon])
    return chosen.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + RESULT)


def later_speed(minutes: float) -> Column:
    hours = minutes / 60
    return F.hypot(F.col("east") + F.col("east2") * hours, F.col("north") + F.col("north2") * hours)


def displacement(minutes: Column) -> tuple[Column, Column]:
    """Kilometres to the east and north from now."""
    hours = F.greatest(minutes, F.lit(0.0)) / 60
    return tuple(F.col(v) * hours + F.col(f"{v}2") * hours * hours / 2 for v in ("east", "north"))


def movement(fitted: DataFrame) -> DataFrame:
    """What is published of tracks of LEAST_POINTS points or more: heading, speed and confidence, null where too fast.

    A speed below 0.5 km/h has no heading.
    """
    speed = later_speed(0)
    credible = (speed <= TOP_SPEED) & (later_speed(90) <= TOP_LATER_SPEED)
    heading = F.when(credible & (speed >= 0.5), F.pmod(F.degrees(F.atan2("east", "north")), F.lit(360.0)))
    rows = fitted.where(F.col("points") >= LEAST_POINTS).withColumn("heading", heading).withColumn("speed", F.when(credible, speed))
    tier = rules.motion_confidence(F.col("points"), F.col("minutes"), F.col("heading"), F.col("speed"), F.col("fit"), F.col("error_km"))
    return rows.withColumn("confidence", tier).withColumn("heading", F.round("heading", 1)).withColumn("speed", F.round("speed", 1))


def adaptive_motion(spark, sf_dir):
    """Motion of each storm from each hour's frames, with the place it is expected at half an hour on."""
    radar = observations(spark, sf_dir, "radar")
    frames = radar.groupBy("blob", F.expr("frame_s DIV 3600").alias("hour"), "frame_s").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    out = movement(tracks(frames, ["blob", "hour"], "frame_s", "lat", "lon"))
    east, north = displacement(F.lit(30.0))
    return out.select(
        "blob", "hour", "model", "points", "heading", "speed", "confidence", "fit", "error_km", F.round("gain", 3).alias("gain"),
        F.round(east, 3).alias("east_in_30"), F.round(north, 3).alias("north_in_30"),
    )


#: SQL has no choice of models by refitting prefixes; `tests/test_motion.py` holds the rows against a plain version.
QUERIES["T1_T2_T4_W8_W12_adaptive_motion"] = adaptive_motion
