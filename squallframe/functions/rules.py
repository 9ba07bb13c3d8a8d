"""Rules on single rows: texts and numbers of states, statuses, ranks, forecasts and source choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of statuses, countries and sources, and limits.
NO_NUMBER = ["unknown", "unavailable", "none", ""]
TRUE_TEXTS = ["1", "true", "yes", "on"]
COUNTRIES = {
    "BELGIE": "BE", "BELGIUM": "BE", "NEDERLAND": "NL", "NETHERLANDS": "NL", "DUITSLAND": "DE", "GERMANY": "DE", "FRANKRIJK": "FR", "FRANCE": "FR",
    "GROOT-BRITTANNIE": "GB", "UNITED KINGDOM": "GB", "ITALIE": "IT", "ITALY": "IT", "SPANJE": "ES", "SPAIN": "ES", "LUXEMBURG": "LU", "LUXEMBOURG": "LU",
    "GRIEKENLAND": "GR", "GREECE": "GR",
}
FALLBACKS = ["opera", "rainviewer", "hsaf_h40b", "noaa_goes_rrqpe"]
MIN_PROFILE, PENALTY, WINDOW_S = 12, 10, 600
MOTION_SAMPLES, MOTION_MINUTES, MOTION_FIT = 4, 10.0, 0.60
#: Product ages in minutes up to which a source is healthy.
HEALTHY_MINUTES = {"national": 20, "hsaf_h40b": 90, "noaa_goes_rrqpe": 45}


def numeric_state(x: Column) -> Column:
    """The number that a state's text says, else null."""
    return F.when(~x.isin(NO_NUMBER), x.try_cast("double"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def truth(x: Column) -> Column:
    return F.lower(F.trim(x)).isin(TRUE_TEXTS)


def slug(x: Column) -> Column:
    """Lower case, all but a-z and 0-9 as single underscores, none at the ends; "target" if nothing is left."""
    text = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(text == "", "target").otherwise(text)


def country(x: Column) -> Column:
    names = F.create_map(*(F.lit(v) for pair in COUNTRIES.items() for v in pair))
    return F.coalesce(names[F.upper(x)], F.upper(x))


def product_time(key: Column) -> Column:
    """The time in a composite's key, as yyyyMMddHHmm, else null."""
    time = F.regexp_extract(key, r"\d{4}/\d{2}/\d{2}/OPERA/COMP/OPERA@(\d{8}T\d{4})@0@DBZH\.h5", 1)
    return F.try_to_timestamp(F.nullif(time, F.lit("")), F.lit("yyyyMMdd'T'HHmm"))


def pressure_class(delta_60m: Column) -> Column:
    return (
        F.when(delta_60m.isNull(), "onvoldoende_data").when(delta_60m <= -2, "snelle_daling").when(delta_60m <= -1, "dalend")
        .when(delta_60m >= 2, "snelle_stijging").when(delta_60m >= 1, "stijgend").otherwise("stabiel")
    )


def tracking_status(dormant: Column, frames: Column, strikes: Column) -> Column:
    return F.when(dormant, "sluimerend").when(frames >= 2, "bevestigd").when(frames == 1, "waargenomen").when(strikes > 0, "alleen_bliksem").otherwise("onvoldoende_data")


def motion_confidence(points: Column, minutes: Column, heading: Column, speed: Column, fit: Column, error_km: Column) -> Column:
    error = F.coalesce(error_km, F.lit(float("inf")))
    none = heading.isNull() | (points < 4) | (minutes < 5)
    high = (points >= 6) & (minutes >= 15) & (fit >= 0.80) & (error <= 3.0) & F.coalesce(speed > 1, F.lit(False))
    return F.when(none, "Onvoldoende data").when(high, "Hoog").when((minutes >= 10) & (fit >= 0.55) & (error <= 8.0), "Matig").otherwise("Laag")


def reliable_motion(heading: Column, speed: Column, status: Column, confidence: Column, points: Column, minutes: Column, fit: Column) -> Column:
    """Whether a motion may be published."""
    return F.coalesce(heading.isNotNull() & (speed > 0) & (status == "bevestigd") & confidence.isin("Matig", "Hoog") & (points >= MOTION_SAMPLES) & (minutes >= MOTION_MINUTES) & (fit >= MOTION_FIT), F.lit(False))


def candidate_rank(status: Column, distance: Column, passage: Column, minutes: Column, approach: Column) -> Column:
    """A struct that orders storms by their relevance to a target, and names it; minutes count in three ranks only."""
    ahead = F.coalesce(minutes.between(0, 90), F.lit(False))
    rank = lambda first, second, name, timed=False: F.struct(F.lit(first).alias("c1"), F.lit(second).alias("c2"), (minutes if timed else F.lit(0)).cast("double").alias("minutes"), distance.alias("distance"), F.lit(name).alias("relevance"))
    return (
        F.when(~status.eqNullSafe(F.lit("bevestigd")), rank(1, 8, "observed")).when(distance <= 5, rank(0, 0, "current_precipitation"))
        .when(ahead & (passage == "raak"), rank(0, 1, "forecast_hit", True)).when(ahead & (passage == "rand"), rank(0, 2, "forecast_edge", True))
        .when((approach > 1) & ahead & ~passage.eqNullSafe(F.lit("mist")), rank(0, 3, "approaching", True)).when(approach > 1, rank(0, 4, "approaching"))
        .when(F.abs(approach) <= 1, rank(0, 5, "lateral")).when(approach < -1, rank(0, 6, "moving_away")).otherwise(rank(0, 7, "confirmed"))
    )


def forecast_block(status: Column, confidence: Column, minutes: Column, passage: Column, dbz: Column) -> Column:
    """Why there is no forecast for a target, null if there is one."""
    return (
        F.when(~status.eqNullSafe(F.lit("bevestigd")), "systeem_nog_niet_bevestigd").when(~F.coalesce(confidence.isin("Matig", "Hoog"), F.lit(False)), "bewegingsvector_onvoldoende_betrouwbaar")
        .when(minutes.isNull() | passage.isNull(), "passage_nog_niet_berekenbaar").when(passage == "mist", "geen_passage_binnen_corridor")
        .when((minutes < 0) | (minutes > 90), "buiten_prognosehorizon").when(dbz.isNull(), "intensiteit_onbekend")
    )


def forecast_dbz(dbz: Column, trend_per_hour: Column, minutes: Column) -> Column:
    change = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), trend_per_hour * minutes / 60))
    return F.greatest(F.lit(0.0), F.least(F.lit(75.0), dbz + change))


def forecast_confidence(confidence: Column, frames: Column, minutes: Column) -> Column:
    base, bonus = F.when(confidence == "Hoog", 82).otherwise(64), F.least(F.lit(10), F.greatest(F.lit(0), frames - 2) * 3)
    return F.greatest(F.lit(25), F.least(F.lit(95), base + bonus - F.bround(minutes / 90.0 * 24))).cast("int")


def transition_penalty(samples: Column, f1: Column, detection: Column) -> Column:
    """Points off the confidence while sources change: fewer where they have agreed."""
    agreement = F.coalesce(f1, detection)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), agreement))
    learned = F.bround(F.greatest(F.lit(3.0), F.least(F.lit(13.0), 3 + (1 - clamped) * 10))).cast("int")
    return F.when((samples < MIN_PROFILE) | agreement.isNull(), PENALTY).otherwise(learned)


def profile_tier(samples: Column) -> Column:
    return F.when(samples < MIN_PROFILE, "insufficient").when(samples < 30, "low").when(samples < 100, "medium").otherwise("high")


def transition_window(samples: Column, f1: Column, detection: Column) -> Column:
    agreement, tier = F.coalesce(f1, detection), profile_tier(samples)
    return F.when((samples < MIN_PROFILE) | agreement.isNull(), WINDOW_S).when((tier == "high") & (agreement >= 0.75), 300).when(tier.isin("medium", "high") & (agreement >= 0.55), 420).otherwise(WINDOW_S)


def warning_stage(status: Column, reliable: Column, passage: Column, eta: Column) -> Column:
    near = (status == "naderend") & reliable & passage.isin("raak", "rand")
    return F.when(near, F.when(eta <= 15, "imminent").when(eta <= 45, "dichtbij").when(eta <= 90, "vroeg"))


def source_status(active: Column, rows: Column, age_minutes: Column) -> Column:
    return F.when(rows > 0, "neerslag").when(~active, "niet_actief").when(age_minutes.isNull(), "wacht_op_frame").when(age_minutes <= 30, "droog").otherwise("verouderd")


def chosen_source(local: Column, healthy: Column) -> Column:
    """The one national source of a region if it is healthy, else the first healthy fallback; both are arrays of names."""
    national = F.when((F.size(local) == 1) & F.array_contains(healthy, F.get(local, F.lit(0))), F.get(local, F.lit(0)))
    return F.coalesce(national, F.get(F.filter(F.array(*map(F.lit, FALLBACKS)), lambda s: F.array_contains(healthy, s)), F.lit(0)))


def echo_override(source: Column, healthy: Column, rows: dict[str, Column], complete: Column, corroborated: Column) -> Column:
    """Another source where the chosen one sees nothing (or an edge that none confirms) and that one sees rain."""
    wet = lambda s: (rows[s] > 0) & F.array_contains(healthy, s)
    empty = (rows["opera"] == 0) | (~complete & (corroborated == 0))
    dry_tiles = (source == "rainviewer") & (rows["rainviewer"] == 0)
    return (
        F.when((source == "opera") & empty & wet("rainviewer"), "rainviewer").when(dry_tiles & wet("hsaf_h40b"), "hsaf_h40b")
        .when(dry_tiles & wet("noaa_goes_rrqpe"), "noaa_goes_rrqpe").otherwise(source)
    )


def sampled_ring(points: Column, most: int) -> Column:
    """Every so many-th point of a ring, so that at most ``most`` are left, closed if it has three."""
    step = F.greatest(F.lit(1), F.ceil(F.size(points) / most)).cast("int")
    kept = F.filter(points, lambda _, i: i % step == 0)
    return F.when((F.size(kept) >= 3) & (F.get(kept, F.lit(0)) != F.element_at(kept, -1)), F.concat(kept, F.slice(kept, 1, 1))).otherwise(kept)


def compact_footprint(points: Column, most: int = 24) -> Column:
    step = F.greatest(F.lit(1), F.floor(F.size(points) / most)).cast("int")
    return F.slice(F.filter(points, lambda _, i: i % step == 0), 1, most)
