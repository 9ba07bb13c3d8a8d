import json

import pytest
from pyspark.sql import functions as F

from squallframe.operators.guidance import fleet_summary, nowcast_summary, shared_locations, summaries, target_guidance


def model(current=0.0, forecast=0.0, **changes):
    rain = [forecast] + [0.0] * 12
    return {
        "latitude": 51.0, "longitude": 4.0, "elevation": 10.0, "timezone": "UTC", "generationtime_ms": 1.25, "current": {"precipitation": current},
        "minutely_15": {
            "precipitation": rain, "rain": rain, "showers": [0.0] * 13, "cape": [600.0, 1200.0] + [800.0] * 11, "lightning_potential": [None, 1.5] + [0.0] * 11,
            "wind_gusts_10m": [35.0, 55.0] + [30.0] * 11, "weather_code": [80.0] * 13, "freezing_level_height": [2300.0, 2100.0] + [2200.0] * 11,
        },
        "hourly": {
            "precipitation_probability": [20.0, 70.0, 40.0, 10.0, 5.0, 0.0, 99.0], "pressure_msl": [1008.2, 1007.9, 1007.7, 1007.5, 1007.4, 1007.3], "lifted_index": [-1.0, -3.5, -2.0, 0.0, 1.0, 1.0],
            "convective_inhibition": [-10.0, -40.0, -15.0, 0.0, 0.0, 0.0], "wind_speed_850hPa": [45.0] * 6, "wind_direction_850hPa": [230.0] * 6, "wind_speed_700hPa": [60.0] * 6,
            "wind_direction_700hPa": [240.0] * 6, "relative_humidity_700hPa": [75.0] * 6, "cloud_cover": [80.0] * 6,
        },
        **changes,
    }


def summary(spark, *documents):
    rows = spark.createDataFrame([(i, d if isinstance(d, str | None) else json.dumps(d)) for i, d in enumerate(documents)], "i int, document string")
    return [r.asDict() for r in summaries(rows, "document").orderBy("i").collect()]


def test_a_whole_document(spark):
    [got] = summary(spark, model(current=2.5, forecast=1.2))
    want = {
        "current_mm": 2.5, "max_90m_mm": 1.2, "total_90m_mm": 1.2, "wet_steps_90m": 1, "first_wet_90m_min": 0, "max_3h_mm": 1.2, "probability_max_6h": 70.0, "cape_max_3h": 1200.0, "lightning_max_3h": 1.5,
        "gusts_max_3h_kmh": 55.0, "freezing_min_3h_m": 2100.0, "pressure_hpa": 1008.2, "lifted_min_6h": -3.5, "inhibition_min_6h": -40.0, "wind_700_kmh": 60.0, "wind_700_deg": 240.0, "convective": True,
        "aloft_wind": True, "model_lat": 51.0, "elevation": 10.0, "timezone": "UTC", "generation_ms": 1.25,
    }
    assert {k: got[k] for k in want} == want
    assert len(got["variables"]) == 18 and got["precipitation_90m"] == [1.2] + [0.0] * 6 and len(got["precipitation_3h"]) == 13


def test_only_known_steps_count(spark):
    ragged = model(minutely_15={"precipitation": [None, "0.5", "wet", "NaN", 0.25, None, 0.0] + [0.0] * 5 + [1.0, 9.0], "cape": "none"}, hourly={"pressure_msl": [None, 1001.26]})
    late = model(minutely_15={"precipitation": [None] * 7 + [3.0]}, hourly=[1, 2])
    got, after, *broken = summary(spark, ragged, late, {"current": 5, "minutely_15": None}, "{", "", None, "[]", model(current=float("inf")))
    assert (got["max_90m_mm"], got["total_90m_mm"], got["wet_steps_90m"], got["first_wet_90m_min"]) == (0.5, 0.75, 2, 15)
    assert (got["max_3h_mm"], got["total_3h_mm"], got["pressure_hpa"], got["cape_max_3h"], got["convective"]) == (1.0, 1.75, 1001.3, None, False)
    assert got["precipitation_90m"] == [None, 0.5, None, None, 0.25, None, 0.0] and got["variables"] == ["precipitation", "pressure_msl"]
    assert (after["max_90m_mm"], after["wet_steps_90m"], after["first_wet_90m_min"], after["max_3h_mm"], after["variables"]) == (None, None, None, 3.0, ["precipitation"])
    assert all(b["current_mm"] is None for b in broken)
    assert all(b["variables"] == [] and b["timezone"] == "UTC" and b["precipitation_90m"] == [] and b["aloft_wind"] is False for b in broken[:-1])


def test_targets_share_locations_and_fleets_gears(spark):
    places = [("f", "home", 51.0001, 4.0001), ("f", "person", 51.001, 4.001), ("f", "remote", 48.85, 2.35), ("f", "nowhere", None, 1.0), ("f", "beyond", 91.0, 0.0), ("dry", "a", 51.0, 4.0), ("dark", "b", 51.0, 4.0), ("half", "c", 0.0, 0.0)]
    targets = spark.createDataFrame(places, "fleet string, target_id string, lat double, lon double")
    located = {(r.fleet, r.target_id): r.location for r in shared_locations(targets, "fleet").collect()}
    assert located == {("f", "home"): "home", ("f", "person"): "home", ("f", "remote"): "remote", ("dry", "a"): "a", ("dark", "b"): "b", ("half", "c"): "c"}
    documents = [("f", "home", model(2.5, 1.2)), ("f", "remote", model()), ("dry", "a", model()), ("half", "c", model(None, 0.5))]
    rows = spark.createDataFrame([(f, t, json.dumps(d)) for f, t, d in documents], "fleet string, location string, document string")
    guided = target_guidance(targets, rows, "fleet")
    assert {r.target_id: (r.max_90m_mm, r.model_lat) for r in guided.collect()} == {"home": (1.2, 51.0), "person": (1.2, 51.0), "remote": (0.0, 51.0), "a": (0.0, 51.0), "b": (None, 51.0), "c": (0.5, 51.0)}
    got = {r.fleet: tuple(r)[1:] for r in fleet_summary(guided, "fleet").collect()}
    assert got["f"] == (3, 2, 2, 2, 2, 2.5, True, "HIGH")
    assert got["dry"] == (1, 1, 0, 0, 0, 0.0, False, "LOW")
    assert got["dark"] == (1, 1, None, None, None, None, None, "PARTIAL")
    assert got["half"] == (1, 1, None, 1, 1, 0.5, None, "HIGH")
    assert fleet_summary(target_guidance(targets.limit(0), rows, "fleet"), "fleet").count() == 0


@pytest.mark.parametrize("data, want", [([0.1, None, 0.25, 1.0], (3, 1.35, 1.0)), ([], (0, 0.0, 0.0)), ([None], (0, 0.0, 0.0)), (None, (0, 0.0, 0.0))])
def test_nowcasts(spark, data, want):
    document = {"reference_time": "2026-01-01T00:00Z", "features": [{"properties": {"parameters": {"rr": {"data": data}}}}] if data is not None else []}
    row = nowcast_summary(spark.createDataFrame([(json.dumps(document),)], "d string").withColumn("k", F.lit(1)), "d").first()
    assert (row.k, row.reference_time, row.steps, row.rain_3h_mm, row.max_15min_mm) == (1, "2026-01-01T00:00Z", *want)
