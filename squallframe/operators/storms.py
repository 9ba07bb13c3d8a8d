"""Storms followed over time: repeats removed, observations clustered in cycles, storms merged, put to rest and removed."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squallframe.functions.geo import EARTH_KM, haversine_sql
from squallframe.functions.relational import islands
from squallframe.operators.observing import HAV_REGION, ORACLES, QUERIES, routed
from squallframe.sources.observations import OBS_SQL, observations

# Repeats (seconds, degrees), reach of a storm and of its gauges, merging distance (km), retention and rest (seconds).
REPEAT_S, REPEAT_DEGREES = 1, 0.001
REACH_KM, GAUGE_KM, MERGE_KM, WET_MM = 30.0, 60.0, 60.0, 0.1
CELLS_S, STRIKES_S, RECENT_S, REST_S, GONE_S = 1200, 3600, 300, 300, 900
MOST_STORMS, CYCLE_S = 15, 300
#: Distances nearer than this to a limit are looked at one by one (km); most and fewest rows that are told by bounds at once.
CLOSE_KM, MOST_ROWS, FEWEST_ROWS = 1e-6, 16_384, 64


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Groups dealt to tasks by key and sorted there (which spills), so that a task can go through them with a small state."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def changes(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row is True."""
    return (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()


def runs(rows: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Number runs (run) of rows whose neighbours are at most ``gap`` apart; the windows see each time of a group once."""
    times = islands(rows.select(*keys, at).distinct(), keys, at, gap).withColumnRenamed("__island", "run")
    return rows.join(times, [*keys, at])


class Recent:
    """Rows kept of the last seconds, found by squares of two REPEAT distances a side."""

    def __init__(self, seconds: float, degrees: float):
        self.seconds, self.degrees, self.rows, self.squares = seconds, degrees, deque(), {}

    def square(self, lat: float, lon: float) -> tuple[int, int]:
        return math.floor(lat / (2 * self.degrees)), math.floor(lon / (2 * self.degrees))

    def forget(self, at: float) -> None:
        """Rows more than the seconds before a time; each is the oldest of its square."""
        while self.rows and self.rows[0][0] < at - self.seconds:
            row = self.rows.popleft()
            square = self.square(*row[1:])
            of = self.squares[square]
            of.popleft()
            if not of:
                del self.squares[square]

    def keeps(self, rain: bool, at: float, lat: float, lon: float) -> bool:
        """Whether a row, the newest so far, repeats no kept one; then it is kept. All of rain are at one place. Rows without a place repeat none."""
        self.forget(at)
        if rain:
            fresh, lat, lon = not self.rows, 0.0, 0.0
        elif lat is None or lon is None or not (math.isfinite(lat) and math.isfinite(lon)):
            return True
        else:
            r, c = self.square(lat, lon)
            near = (row for y in (r - 1, r, r + 1) for x in (c - 1, c, c + 1) for row in self.squares.get((y, x), ()))
            fresh = not any(abs(y - lat) < self.degrees and abs(x - lon) < self.degrees for _, y, x in near)
        if fresh:
            row = (at, lat, lon)
            self.rows.append(row)
            self.squares.setdefault(self.square(lat, lon), deque()).append(row)
        return fresh


def drop_repeats(rows: DataFrame, keys: list[str], seconds: float = REPEAT_S, degrees: float = REPEAT_DEGREES) -> DataFrame:
    """Rows (event_id, station_id, kind, lat, lon, sim_s) without those that repeat a kept one of the ``seconds`` before.

    Rain repeats by station, everything else by place: less than ``degrees`` apart both ways, whatever the source. A row that
    repeats only a dropped one stays. Rows go by time and then id; rain without a station is never a repeat. Rows more than
    ``seconds`` apart can't meet, so groups are runs of close rows, and a task's state is the rows kept of the last seconds.
    Rows with nulls in keys, kind or time go.
    """
    station = F.when(F.col("kind") == "rain", F.coalesce(F.col("station_id"), -F.col("event_id") - 1)).otherwise(F.lit(0))
    usable = rows.dropna(subset=[*keys, "kind", "sim_s"]).withColumn("__station", station)
    numbered = runs(usable, [*keys, "kind", "__station"], "sim_s", seconds)
    columns = rows.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    group = [*keys, "kind", "__station", "run"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, Recent(seconds, degrees)
        for batch in batches:
            if batch.empty:
                continue
            new, chosen = changes(batch, group), np.empty(len(batch), bool)
            new[0] = tuple(batch[group].iloc[0]) != current  # a group may go on from the batch before
            values = zip(new.tolist(), (batch["kind"] == "rain").tolist(), batch["sim_s"].tolist(), batch["lat"].tolist(), batch["lon"].tolist(), strict=True)
            for i, (first, rain, at, lat, lon) in enumerate(values):
                if first:
                    kept = Recent(seconds, degrees)
                chosen[i] = kept.keeps(rain, at, lat, lon)
            current = tuple(batch[group].iloc[-1])
            yield batch.loc[chosen, columns]

    return in_order(numbered, group, ["sim_s", "event_id"]).mapInPandas(choose, types)


def two_feeds(rows: DataFrame) -> DataFrame:
    """Each observation and what a relay of it reports: 0 to 2 seconds later, every other one moved by half a thousandth of a degree."""
    own = rows.select("event_id", "station_id", "kind", "lat", "lon", "sim_s", "blob")
    relayed = F.explode(F.array(
        F.struct("event_id", "lat", "lon", "sim_s"),
        F.struct((F.col("event_id") + 1_000_000_000).alias("event_id"), (F.col("lat") + F.col("event_id") % 2 * 0.0005).alias("lat"), (F.col("lon") + F.col("event_id") % 5 * 0.0003).alias("lon"), (F.col("sim_s") + F.col("event_id") % 3).alias("sim_s")),
    ))
    return own.select("station_id", "kind", "blob", relayed.alias("r")).select("r.event_id", "station_id", "kind", "r.lat", "r.lon", "r.sim_s", "blob")


def without_repeats(spark, sf_dir):
    return drop_repeats(two_feeds(observations(spark, sf_dir)), ["blob"]).select("event_id", "blob", "kind", "sim_s")


QUERIES["ST5_without_repeats"] = without_repeats
#: Row by row through each run of close rows, with the list of kept rows.
ORACLES["ST5_without_repeats"] = OBS_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f"""
, feeds AS (
    SELECT event_id, station_id, kind, lat, lon, sim_s, blob FROM obs
    UNION ALL
    SELECT event_id + 1000000000, station_id, kind, lat + event_id % 2 * 0.0005e0, lon + event_id % 5 * 0.0003e0, sim_s + event_id % 3, blob FROM obs
),
keyed AS (SELECT *, CASE WHEN kind = 'rain' THEN station_id ELSE 0 END AS st FROM feeds),
broken AS (SELECT *, CASE WHEN sim_s - lag(sim_s) OVER (PARTITION BY blob, kind, st ORDER BY sim_s, event_id) > {REPEAT_S} THEN 1 ELSE 0 END AS b FROM keyed),
runs AS (SELECT *, sum(b) OVER (PARTITION BY blob, kind, st ORDER BY sim_s, event_id) AS run FROM broken),
seq AS (SELECT *, row_number() OVER (PARTITION BY blob, kind, st, run ORDER BY sim_s, event_id) AS i FROM runs),
walk AS (
    SELECT blob, kind, st, run, i, event_id, sim_s, true AS fresh, [{{'t': sim_s, 'y': lat, 'x': lon}}] AS kept FROM seq WHERE i = 1
    UNION ALL
    SELECT blob, kind, st, run, i, event_id, sim_s, fresh, CASE WHEN fresh THEN list_append(kept, {{'t': sim_s, 'y': lat, 'x': lon}}) ELSE kept END
    FROM (
        SELECT s.*, w.kept, len(list_filter(w.kept, lambda k: k.t >= s.sim_s - {REPEAT_S}
            AND (s.kind = 'rain' OR (abs(k.y - s.lat) < {REPEAT_DEGREES}e0 AND abs(k.x - s.lon) < {REPEAT_DEGREES}e0)))) = 0 AS fresh
        FROM walk w JOIN seq s ON w.blob = s.blob AND w.kind = s.kind AND w.st = s.st AND w.run = s.run AND s.i = w.i + 1
    )
)
SELECT event_id, blob, kind, sim_s FROM walk WHERE fresh
"""


def distances(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    y, x = np.radians(lats - lat), np.radians(lons - lon)
    a = np.sin(y / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(np.radians(lats)) * np.sin(x / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


class Storm:
    """One storm's bounded memory: cells of 20 minutes, strikes of an hour, gauges' counts.

    Cells and strikes are arrays of (time, lat, lon, weight) rows that double when full.
    """

    def __init__(self, number: int, lat: float, lon: float, now: int):
        self.number, self.lat, self.lon, self.seen, self.resting = number, lat, lon, now, False
        self.basis, self.strongest, self.wet, self.dry = "none", 0, 0, 0
        self.systems: dict[str, int] = {}
        self.cells, self.n_cells = np.empty((8, 4)), 0
        self.strikes, self.n_strikes = np.empty((8, 4)), 0
        self.radius = 0.0

    def add(self, what: str, rows: np.ndarray) -> None:
        """Rows in their order; ``radius`` isn't kept up."""
        held, n = getattr(self, what), getattr(self, f"n_{what}")
        if n + len(rows) > len(held):
            held = np.concatenate([held, np.empty((max(len(held), n + len(rows) - len(held)), 4))])
            setattr(self, what, held)
        held[n : n + len(rows)] = rows
        setattr(self, f"n_{what}", n + len(rows))

    def measure(self) -> None:
        """How far the farthest cell is from the centre."""
        cells = self.of("cells")
        self.radius = float(distances(self.lat, self.lon, cells[:, 1], cells[:, 2]).max()) if len(cells) else 0.0

    def centre_km(self, lat: float, lon: float) -> float:
        return float(distances(lat, lon, np.array([self.lat]), np.array([self.lon]))[0])

    def of(self, what: str) -> np.ndarray:
        return getattr(self, what)[: getattr(self, f"n_{what}")]

    def keep(self, what: str, rows: np.ndarray) -> None:
        setattr(self, what, rows.copy() if len(rows) else np.empty((8, 4)))
        setattr(self, f"n_{what}", len(rows))

    def distance(self, lat: float, lon: float) -> float:
        """To the centre or the nearest cell."""
        cells = self.of("cells")
        return float(distances(lat, lon, np.append(cells[:, 1], self.lat), np.append(cells[:, 2], self.lon)).min())

    def recent_strikes(self, now: int, seconds: int) -> np.ndarray:
        strikes = self.of("strikes")
        return strikes[strikes[:, 0] >= now - seconds]

    def settle(self, now: int) -> None:
        """Forget what is old; the centre is that of the newest radar cells, else of the last strikes, newer ones weighing more."""
        self.keep("cells", self.of("cells")[self.of("cells")[:, 0] >= now - CELLS_S])
        self.keep("strikes", self.recent_strikes(now, STRIKES_S))
        self.systems = {k: t for k, t in self.systems.items() if t >= now - CELLS_S}
        rows, self.basis = self.of("cells"), "radar"
        if len(rows):
            rows = rows[rows[:, 0] == rows[:, 0].max()]
            weights = rows[:, 3]
        else:
            rows, self.basis = self.recent_strikes(now, RECENT_S), "lightning"
            if not len(rows):
                return
            weights = np.maximum(0.1, 1 - (rows[:, 0].max() - rows[:, 0]) / RECENT_S)
        self.lat, self.lon = (float(v) for v in weights @ rows[:, 1:3] / weights.sum())

    def absorb(self, other: Storm, now: int) -> None:
        """Take in another storm's memory; the centre moves by the two numbers of strikes, the taker's counted with the other's."""
        for what in ("strikes", "cells"):
            self.add(what, other.of(what))
        self.systems = {k: max(t, self.systems.get(k, t)) for k, t in {**self.systems, **other.systems}.items()}
        mine, theirs = (len(s.recent_strikes(now, STRIKES_S)) for s in (self, other))
        if mine + theirs:
            self.lat, self.lon = (self.lat * mine + other.lat * theirs) / (mine + theirs), (self.lon * mine + other.lon * theirs) / (mine + theirs)


class Region:
    """The storms of a region. A cycle's rows come as lightning, radar, rain; at most MOST_STORMS are active."""

    def __init__(self):
        self.storms: list[Storm] = []
        self.made = self.dropped = 0

    def active(self) -> list[Storm]:
        return [s for s in self.storms if not s.resting]

    def rest(self, now: int) -> None:
        """Storms without a row for five minutes rest, after fifteen they are gone."""
        self.storms = [s for s in self.storms if now - s.seen <= GONE_S]
        for storm in self.storms:
            storm.resting = storm.resting or now - storm.seen > REST_S

    def owner(self, lat: float, lon: float, system: str | None) -> Storm | None:
        active = self.active()
        if system is not None:
            for storm in active:
                if system in storm.systems:
                    return storm
        centres = [(storm.centre_km(lat, lon), storm) for storm in active]
        centres = [(km, storm) for km, storm in centres if km - storm.radius <= REACH_KM + CLOSE_KM]  # others have nothing within reach
        if len(centres) == 1 and centres[0][0] < REACH_KM:
            return centres[0][1]
        near = [(d, k) for k, d in enumerate(storm.distance(lat, lon) for _, storm in centres) if d < REACH_KM]
        return centres[min(near)[1]][1] if near else None

    def place_one(self, what: str, row: tuple, now: int) -> None:
        """row: time, lat, lon, intensity, weight, system; for a row that bounds don't tell."""
        at, lat, lon, intensity, weight, system = row
        storm = self.owner(lat, lon, system if what == "cells" else None)
        if storm is None:
            if len(self.active()) >= MOST_STORMS:
                self.dropped += 1
                return
            self.made += 1
            storm = Storm(self.made, lat, lon, now)
            self.storms.append(storm)
        storm.seen = now
        if what == "strikes":
            storm.add("strikes", np.array([(at, lat, lon, 1.0)]))
            return
        storm.add("cells", np.array([(at, lat, lon, max(weight, 1.0))]))
        storm.radius = max(storm.radius, storm.centre_km(lat, lon))
        storm.strongest = max(storm.strongest, intensity)
        if system is not None:
            storm.systems[system] = at

    def place_block(self, what: str, columns: list[np.ndarray], now: int) -> int:
        """Give rows to storms as far as the storms' centres and radii tell whose they are; the number of rows that were given.

        A row goes to the storm whose centre is within reach if no other storm has a cell within reach, not even one of this block's cells, or to the
        storm of its system. So rows are told in any order as they would be one after the other.
        """
        at, lat, lon, intensity, weight, system = columns
        active = self.active()
        if not active:
            return 0
        km = np.stack([distances(s.lat, s.lon, lat, lon) for s in active], axis=1)
        sure = km < REACH_KM - CLOSE_KM
        chosen, by_place = np.where(sure.sum(axis=1) == 1, sure.argmax(axis=1), -1), np.ones(len(lat), bool)
        groups = []
        if what == "cells":
            codes, names = pd.factorize(system, use_na_sentinel=True)
            order = np.argsort(codes, kind="stable")
            groups = [(names[codes[of[0]]], of) for of in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if codes[of[0]] >= 0]
            for name, of in groups:
                holder = next((k for k, s in enumerate(active) if name in s.systems), None)
                rest = of if holder is not None else of[1:]  # the first row of a new system goes by its place
                chosen[rest], by_place[rest] = chosen[of[0]] if holder is None else holder, False
        many = int(np.argmax(chosen < 0)) if (chosen < 0).any() else len(chosen)
        radii = np.array([s.radius for s in active])
        if what == "cells":
            np.maximum.at(radii, chosen[:many], km[np.arange(many), chosen[:many]])
        apart = km[:many] - radii > REACH_KM + CLOSE_KM
        apart[np.arange(many), chosen[:many]] = True
        unsure = by_place[:many] & ~apart.all(axis=1)
        many = int(np.argmax(unsure)) if unsure.any() else many
        rows = np.column_stack([at[:many], lat[:many], lon[:many], np.ones(many) if what == "strikes" else np.maximum(weight[:many], 1.0)])
        for k, storm in enumerate(active):
            of = np.flatnonzero(chosen[:many] == k)
            if not len(of):
                continue
            storm.seen = now
            storm.add(what, rows[of])
            if what == "cells":
                storm.radius = max(storm.radius, float(km[of, k].max()))
                storm.strongest = max(storm.strongest, int(intensity[of].max()))
        for name, of in groups:
            of = of[of < many]
            if len(of):
                active[chosen[of[0]]].systems[name] = int(at[of[-1]])
        return many

    def place(self, what: str, columns: list[np.ndarray], now: int) -> None:
        """Rows in their order: in growing blocks while bounds tell whose they are, one by one where they don't."""
        k, size, singles, n = 0, FEWEST_ROWS, 1, len(columns[0])
        while k < n:
            window = [c[k : k + size] for c in columns]
            given = self.place_block(what, window, now)
            k += given
            if given == len(window[0]):
                size, singles = min(size * 4, MOST_ROWS), 1
                continue
            for row in zip(*(c[k : k + singles].tolist() for c in columns), strict=True):
                self.place_one(what, row, now)
            k, size, singles = k + singles, FEWEST_ROWS, min(singles * 2, FEWEST_ROWS)

    def gauges(self, lat: np.ndarray, lon: np.ndarray, rain_mm: np.ndarray) -> None:
        for storm in self.active():
            km = distances(storm.lat, storm.lon, lat, lon)
            near = km <= GAUGE_KM
            for k in np.flatnonzero(np.abs(km - GAUGE_KM) < CLOSE_KM):
                near[k] = storm.centre_km(lat[k], lon[k]) <= GAUGE_KM
            wet = int((rain_mm[near] >= WET_MM).sum())  # a null reading is dry
            storm.wet, storm.dry = storm.wet + wet, storm.dry + int(near.sum()) - wet

    def cycle(self, start: int, rows: list[tuple] | pd.DataFrame) -> None:
        """rows: (kind, time, lat, lon, intensity, rain_mm, weight, system), in FIELDS or as tuples."""
        now = start + CYCLE_S
        self.rest(start)
        rows = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows, columns=FIELDS)
        kinds = rows["kind"].to_numpy(object)
        at, intensity = (rows[c].to_numpy("int64") for c in ("sim_s", "intensity"))
        lat, lon, rain_mm, weight = (rows[c].to_numpy("float64", na_value=np.nan) for c in ("lat", "lon", "rain_mm", "weight"))
        system = rows["system"].astype(object)
        system = system.where(system.notna(), None).to_numpy(object)
        cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if kinds[a] == "rain":
                self.gauges(lat[a:b], lon[a:b], rain_mm[a:b])
            else:
                self.place("strikes" if kinds[a] == "lightning" else "cells", [c[a:b] for c in (at, lat, lon, intensity, weight, system)], now)
        for storm in self.storms:
            storm.settle(now)
        self.merge(now)
        self.rest(now)
        for storm in self.storms:
            storm.measure()

    def merge(self, now: int) -> None:
        """Active storms in order of age take in younger ones within MERGE_KM; a taker's centre moves while it looks."""
        active, gone = self.active(), set()
        for i, taker in enumerate(active):
            if taker.number in gone:
                continue
            for other in active[i + 1 :]:
                if other.number not in gone and distances(taker.lat, taker.lon, np.array([other.lat]), np.array([other.lon]))[0] <= MERGE_KM:
                    taker.absorb(other, now)
                    gone.add(other.number)
        self.storms = [s for s in self.storms if s.number not in gone]

    def report(self, now: int) -> list[tuple]:
        return [
            (s.number, round(s.lat, 5), round(s.lon, 5), s.basis, len(s.recent_strikes(now, RECENT_S)), s.n_strikes, s.n_cells, s.strongest, s.wet, s.dry, s.resting, s.seen)
            for s in self.storms
        ]


REPORT = "storm int, lat double, lon double, basis string, strikes_5min int, strikes_60min int, cells int, strongest int, wet int, dry int, resting boolean, seen_s bigint"
FIELDS = ["kind", "sim_s", "lat", "lon", "intensity", "rain_mm", "weight", "system"]


def in_cycles(rows: DataFrame, key: str, more: list[str] = ()) -> DataFrame:
    """Usable rows with their cycle and the rank of their kind in it."""
    kinds = F.create_map(*[F.lit(v) for pair in (("lightning", 0), ("radar", 1), ("rain", 2)) for v in pair])
    usable = rows.dropna(subset=[key, "kind", "sim_s", "lat", "lon"]).withColumn("__kind", kinds[F.col("kind")])
    usable = usable.withColumn("cycle_s", F.expr(f"(sim_s - pmod(sim_s, {CYCLE_S}))")).withColumn("intensity", F.coalesce("intensity", F.lit(0)))
    return usable.withColumn("weight", F.coalesce("weight", F.lit(1.0))).select(key, "event_id", "cycle_s", "__kind", *FIELDS, *more)


def follow(rows: DataFrame, key: str) -> DataFrame:
    """The storms of each region after each cycle of CYCLE_S seconds that has rows.

    rows: the key, event_id, kind, sim_s, lat, lon, intensity, rain_mm, weight (of a cell, 1 at least) and system (null:
    none), every row in each region it belongs to; a row without time, place, kind or key goes. Storms are gone when nothing came for fifteen
    minutes after their last cycle, so runs of cycles further apart than that know nothing of each other and are followed as groups of their own, which
    spreads a busy region over tasks. Storms are numbered within their run (``run``).
    """
    usable = in_cycles(rows, key)
    numbered = runs(usable, [key], "cycle_s", CYCLE_S + GONE_S)

    names = [key, "run", "cycle_s", *(c.split()[0] for c in REPORT.split(", "))]

    def cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole cycles; the last one of a batch waits for the next batch."""
        held, last = [], None
        for batch in batches:
            if batch.empty:
                continue
            starts = np.flatnonzero(changes(batch, names[:3])).tolist()
            if tuple(batch[names[:3]].iloc[0]) == last:
                held.append(batch.iloc[: starts[1] if len(starts) > 1 else len(batch)])
                starts = starts[1:]
            last = tuple(batch[names[:3]].iloc[-1])
            if starts:
                if held:
                    yield pd.concat(held, ignore_index=True)
                yield from (batch.iloc[a:b] for a, b in zip(starts, starts[1:], strict=False))
                held = [batch.iloc[starts[-1] :]]
        if held:
            yield pd.concat(held, ignore_index=True)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, region, out = None, None, []
        for piece in cycles(batches):
            group, start = (piece[key].iloc[0], int(piece["run"].iloc[0])), int(piece["cycle_s"].iloc[0])
            if group != current:
                current, region = group, Region()
            region.cycle(start, piece)
            out += [(*group, start, *r) for r in region.report(start + CYCLE_S)]
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    type_of = usable.schema[key].dataType.simpleString()
    return in_order(numbered, [key, "run"], ["cycle_s", "__kind", "sim_s", "event_id"]).mapInPandas(walk, f"`{key}` {type_of}, run bigint, cycle_s bigint, {REPORT}")


def weighed(rows: DataFrame, more: list[str] = ()) -> DataFrame:
    """Observations of regions as ``follow`` takes them."""
    system = F.when((F.col("kind") == "radar") & (F.col("source") == "comp"), F.concat_ws(":", "blob", "frame_s"))
    return rows.select("region_id", "event_id", "kind", "sim_s", "lat", "lon", "intensity", "rain_mm", (F.col("quality") * 10).alias("weight"), system.alias("system"), *more)


def follow_storms(spark, sf_dir):
    """Storms of each region; cells of the composite belong to the system of their blob and frame."""
    return follow(weighed(routed(spark, sf_dir)), "region_id")


#: SQL has no state that each row changes; `tests/test_storms.py` holds the rows against a plain version and written-out cases.
QUERIES["ST1_ST2_ST3_storms"] = follow_storms


def linked(lats: np.ndarray, lons: np.ndarray, km: float) -> np.ndarray:
    """The number of each place's part; parts are linked by steps of at most ``km``.

    Places of a square that are all within reach of one of them are taken together. Two squares are linked by these places, or not at all if they
    are too far for any; only squares in between are searched, place by place, while they aren't in one part.
    """
    places, of = np.unique(np.stack([lats, lons], axis=1), axis=0, return_inverse=True)
    of = of.reshape(-1)
    y, x = places[:, 0], places[:, 1]
    high = math.degrees(km / EARTH_KM) / 1.5
    row = np.floor(y / high)
    wide = high / np.maximum(np.cos(np.radians(np.minimum(np.maximum(np.abs(row), np.abs(row + 1)) * high, 90.0))), 1e-3)
    _, square = np.unique(np.stack([row, np.floor(x / wide)], axis=1), axis=0, return_inverse=True)
    order = np.argsort(square.reshape(-1), kind="stable")
    groups, radii = [], []
    for members in np.split(order, np.flatnonzero(np.diff(square.reshape(-1)[order])) + 1):
        reach = distances(y[members[0]], x[members[0]], y[members], x[members])
        close = reach <= km
        groups.append(members[close])
        radii.append(float(reach[close].max()))
        groups += [np.array([m]) for m in members[~close]]
        radii += [0.0] * int((~close).sum())
    firsts, radii = np.array([g[0] for g in groups]), np.array(radii)
    part = np.arange(len(groups))

    def meet(a: np.ndarray, b: np.ndarray, first_a: int, first_b: int, k: int, j: int) -> bool:
        a = a[distances(y[first_b], x[first_b], y[a], x[a]) - radii[j] <= km + CLOSE_KM]
        b = b[distances(y[first_a], x[first_a], y[b], x[b]) - radii[k] <= km + CLOSE_KM]
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        return any((distances(y[p], x[p], y[b], x[b]) <= km).any() for p in a)

    between = []
    for k in range(len(groups)):
        apart = distances(y[firsts[k]], x[firsts[k]], y[firsts[k + 1 :]], x[firsts[k + 1 :]])
        for j in k + 1 + np.flatnonzero(apart <= km):
            part[part == part[j]] = part[k]
        between += [(k, int(j)) for j in k + 1 + np.flatnonzero((apart > km) & (apart - radii[k] - radii[k + 1 :] <= km + CLOSE_KM))]
    for k, j in between:
        if part[k] != part[j] and meet(groups[k], groups[j], firsts[k], firsts[j], k, j):
            part[part == part[j]] = part[k]
    of_place = np.empty(len(places), int)
    for members, number in zip(groups, part, strict=True):
        of_place[members] = number
    return of_place[of]


def lightning_zones(strikes: DataFrame, keys: list[str], km: float = 25.0) -> DataFrame:
    """Strikes with their zone: those linked by steps of at most ``km`` within their group, named by the smallest event_id.

    A group is what one region has seen in five minutes and is labelled in one task, square by square; no pairs are
    written out. Rows with nulls in keys, id or place go.
    """
    types = ", ".join(f"`{k}` {strikes.schema[k].dataType.simpleString()}" for k in keys)

    def label(group: pd.DataFrame) -> pd.DataFrame:
        part = linked(group["lat"].to_numpy(), group["lon"].to_numpy(), km)
        return group[[*keys, "event_id"]].assign(zone=group["event_id"].groupby(part).transform("min"))

    usable = strikes.dropna(subset=[*keys, "event_id", "lat", "lon"]).select(*keys, "event_id", "lat", "lon")
    return usable.groupBy(*keys).applyInPandas(label, f"{types}, event_id bigint, zone bigint")


def zones(spark, sf_dir):
    """Zones of each region and frame: strikes, newest one and box."""
    strikes = routed(spark, sf_dir, "lightning").select("region_id", "frame_s", "event_id", "lat", "lon", "sim_s")
    named = lightning_zones(strikes, ["region_id", "frame_s"]).join(strikes, ["region_id", "frame_s", "event_id"])
    return named.groupBy("region_id", "frame_s", "zone").agg(
        F.count(F.lit(1)).alias("strikes"), F.max("sim_s").alias("newest_s"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
    )


QUERIES["L1_lightning_zones"] = zones
ORACLES["L1_lightning_zones"] = OBS_SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f"""
, st AS (SELECT region_id, frame_s, event_id, sim_s, lat, lon FROM obs o JOIN regions r ON {HAV_REGION} <= r.radius_km WHERE kind = 'lightning'),
near AS (SELECT a.region_id, a.frame_s, a.event_id AS a, b.event_id AS b FROM st a JOIN st b USING (region_id, frame_s) WHERE {haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} <= 25),
reach AS (
    SELECT region_id, frame_s, event_id AS a, event_id AS b FROM st
    UNION
    SELECT r.region_id, r.frame_s, r.a, n.b FROM reach r JOIN near n ON r.region_id = n.region_id AND r.frame_s = n.frame_s AND r.b = n.a
),
named AS (SELECT region_id, frame_s, a AS event_id, min(b) AS zone FROM reach GROUP BY 1, 2, 3)
SELECT region_id, frame_s, zone, count(*) AS strikes, max(sim_s) AS newest_s, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east
FROM named JOIN st USING (region_id, frame_s, event_id) GROUP BY 1, 2, 3
"""
