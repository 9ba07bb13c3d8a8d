"""Regions that follow the targets of a fleet: shared while near, made for a target that none is near, removed with their last one."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallframe.functions.geo import EARTH_KM
from squallframe.operators.observing import QUERIES
from squallframe.sources.observations import observations
from squallframe.streaming.state import DAY_S, LATE_S, event_stream, in_event_order
from squallframe.streaming.windows import drain

#: How far a region's targets may be from its middle, from where on a target has moved, how far a primary target's radar sees; km of a degree (fixed values).
SHARING_KM, MOVED_KM, RADAR_KM, DEGREE_KM = 150.0, 1.0, 350.0, 111.32
UPDATE = ["event_id", "sim_s", "target_id", "main", "gone", "lat", "lon"]
REPORT = "event_id bigint, sim_s bigint, target_id bigint, action string, region bigint, removed bigint, regions int, covered boolean"


def distance(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half = lambda x: math.sin(math.radians(x) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, half(lat2 - lat1) + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half(lon2 - lon1))))


class Fleet:
    """The regions of one fleet: as many rows as it has targets, however many updates there were."""

    def __init__(self) -> None:
        self.middles: dict[int, tuple[float, float]] = {}
        self.region_of: dict[int, int] = {}
        self.places: dict[int, tuple[float, float]] = {}
        self.made = 0
        self.main_place: tuple[float, float] | None = None

    def release(self, target: int) -> int | None:
        """Take a target out of its region. Gives the region if that was its last one."""
        region = self.region_of.pop(target, None)
        if region is None or region in self.region_of.values():
            return None
        del self.middles[region]
        return region

    def assign(self, target: int, lat: float, lon: float) -> tuple[str, int | None]:
        """A target stays in its region while within SHARING_KM of its middle; else it goes to the nearest one within that, the older of two, or to a new one."""
        old = self.region_of.get(target)
        if old is not None and distance(*self.middles[old], lat, lon) <= SHARING_KM:
            return "stays", None
        near, region = min(((distance(*middle, lat, lon), r) for r, middle in self.middles.items()), default=(math.inf, 0))
        removed = self.release(target)
        action = "joins"
        if near > SHARING_KM:
            self.made += 1
            action, region = "makes", self.made
            self.middles[region] = (lat, lon)
        self.region_of[target] = region
        return action, removed

    def update(self, event_id: int, sim_s: int, target: int, main: bool, gone: bool, lat: float | None, lon: float | None) -> tuple:
        """Report of an update. A main target's small move is measured on the plane, another's on the sphere; moves count from the last place that was taken up."""
        action, removed = "unavailable", None
        before = self.places.get(target)
        if gone:
            action, removed = "released", self.release(target)
            self.places.pop(target, None)
        elif lat is not None and lon is not None and math.isfinite(lat) and math.isfinite(lon):
            moved = math.inf
            if before and main:
                moved = math.hypot((lat - before[0]) * DEGREE_KM, (lon - before[1]) * DEGREE_KM * math.cos(math.radians(lat)))
            elif before:
                moved = distance(*before, lat, lon)
            if moved < MOVED_KM:
                action = "still"
            else:
                action, removed = self.assign(target, lat, lon)
                self.places[target] = (lat, lon)
                if main:
                    self.main_place = (lat, lon)
        place, covered = self.places.get(target), None
        if place and self.main_place:
            covered = main or distance(*self.main_place, *place) <= RADAR_KM
        return event_id, sim_s, target, action, self.region_of.get(target), removed, len(self.middles), covered


def assigned(updates: DataFrame, fleet: str) -> DataFrame:
    """Each update of a fleet's targets in the order of sim_s and event_id, with what it did: fleet and REPORT.

    updates: fleet and UPDATE. Rows are dealt by fleet, sorted, and gone through batch by batch with one fleet in memory; updates depend on those before, so a fleet
    is one task. Rows with nulls in fleet, target or time go; a null main or gone is false.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, None
        for batch in batches:
            out = []
            for key, *row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                if held is None or key != name:
                    name, held = key, Fleet()
                out.append((key, *held.update(*row)))
            yield pd.DataFrame(out, columns=names)

    kind = updates.schema[fleet].dataType.simpleString()
    names = [fleet, *(c.split()[0] for c in REPORT.split(", "))]
    rows = _usable(updates, fleet).select(fleet, *UPDATE)
    return rows.repartition(fleet).sortWithinPartitions(fleet, "sim_s", "event_id").mapInPandas(walk, f"`{fleet}` {kind}, {REPORT}")


def _usable(updates: DataFrame, fleet: str) -> DataFrame:
    rows = updates.dropna(subset=[fleet, "target_id", "sim_s"])
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("main", "gone")})


def assigned_stream(stream: DataFrame, fleet: str, late_s: int = LATE_S) -> DataFrame:
    """As ``assigned``, of a stream with a timestamp ``at``, which runs as sim_s does. State is a fleet's regions and targets and the updates that the watermark hasn't passed."""
    rows = _usable(stream, fleet).select(fleet, "at", *UPDATE)

    def work(key: tuple, held: Any, ready: list[tuple], until: float) -> tuple:
        held = held or Fleet()
        out = [(*key, *held.update(*row[2:])) for row in ready]
        return (held if held.region_of or held.made else None), out, None

    kind = rows.schema[fleet].dataType.simpleString()
    return in_event_order(rows, [fleet], "at", ["event_id"], work, f"`{fleet}` {kind}, {REPORT}", late_s)


def target_updates(rows: DataFrame) -> DataFrame:
    """Readings of stations as updates of targets: four stations are a fleet, the first its main target; some readings have no place, some give the target up."""
    missing = F.col("event_id") % 23 == 0
    return rows.select(
        F.expr("station_id DIV 4").alias("fleet"), "event_id", "sim_s", F.col("station_id").alias("target_id"), (F.col("station_id") % 4 == 0).alias("main"), (F.col("event_id") % 29 == 0).alias("gone"),
        F.when(~missing, F.col("lat")).alias("lat"), F.when(~missing, F.col("lon")).alias("lon"), *(["at"] if "at" in rows.columns else []),
    )


def regions_of_targets(spark, sf_dir):
    return assigned(target_updates(observations(spark, sf_dir)), "fleet")


def stream_regions(spark, sf_dir):
    return drain(assigned_stream(target_updates(event_stream(spark, sf_dir)), "fleet"), "regions")


#: SQL has no state that each row changes; `tests/test_regions.py` has the rules' cases and holds the stream against the batch walk.
QUERIES["ST4_X12_X13_regions"] = regions_of_targets
QUERIES["ST4_stream_regions"] = stream_regions
