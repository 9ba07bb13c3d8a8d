"""State by key that rows pass in the order of their event times, once the watermark is beyond them."""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from squallframe.operators import storms
from squallframe.operators.observing import ORACLES, QUERIES, in_regions
from squallframe.sources.observations import OBS_SQL, from_events
from squallframe.streaming.windows import drain, shared_path

LATE_S, DAY_S = 120, 86_400
#: Hours of pressure that a station keeps, how far a reading may be from the asked time, and credible readings (fixed values).
KEPT_S, NEAR_S, LOWEST, HIGHEST = 7200, 480, 850.0, 1100.0
MINUTES = (15, 30, 60)
#: Stations of rain share so many states of a key.
STATION_PARTS = 16
#: Rows of a batch when a table is played as a stream.
SLICE_ROWS = 250_000

#: What a key's work gets: the key, what it held, its rows up to a time (in order) and that time; what it gives: what it holds now (None: nothing),
#: output rows and the time when it wants to be called again without rows (None: only with rows).
Work = Callable[[tuple, Any, list[tuple], float], tuple[Any, list[tuple], float | None]]


def in_event_order(stream: DataFrame, keys: list[str], at: str, order: list[str], work: Work, schema: str, late_s: int) -> DataFrame:
    """Rows of each key in the order of ``at`` (a timestamp) and ``order``, as far as the watermark has passed them, through ``work``.

    A row waits in its key's state until the watermark, the newest time less ``late_s``, is beyond it; rows that come after that are dropped. Timers wake
    keys whose rows have waited long enough or whose work wants it, and the state of a key that holds nothing is removed, so state is
    bounded by what the watermark leaves open and what work holds. Rows with nulls in keys or time go. Work gets rows as tuples: the time in seconds,
    then the stream's columns but for ``at``.
    """
    columns = [c for c in stream.columns if c != at]
    ordering = [columns.index(c) for c in order]
    out_names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def call(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() / 1000.0
        waiting, held, wake = pickle.loads(state.get[0]) if state.exists else ([], None, None)
        for batch in batches:
            rows = batch[columns].astype(object).where(batch[columns].notna(), None).itertuples(index=False, name=None)
            waiting += [(t, [r[k] for k in ordering], r) for t, r in zip(batch["__t"].tolist(), rows, strict=True) if t >= passed]
        ready = sorted((w for w in waiting if w[0] < passed), key=lambda w: (w[0], w[1]))
        waiting = [w for w in waiting if w[0] >= passed]
        out = []
        if ready or wake is not None and wake <= passed:
            held, out, wake = work(key, held, [(w[0], *w[2]) for w in ready], passed)
        times = [w[0] for w in waiting] + ([wake] if wake is not None else [])
        if held is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps((waiting, held, wake)),))
            if times:
                state.setTimeoutTimestamp(int(max(min(times), passed) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=out_names)

    rows = stream.dropna(subset=[*keys, at]).withColumn("__t", F.unix_micros(at) / 1e6).withWatermark(at, f"{late_s} seconds")
    return rows.groupBy(*keys).applyInPandasWithState(call, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def repeats_dropped(stream: DataFrame, keys: list[str], late_s: int = LATE_S) -> DataFrame:
    """As ``storms.drop_repeats``, of a stream with a timestamp ``at``, which runs as sim_s does: rows (event_id, keys, kind, sim_s) that repeat no kept one of the second before."""
    station = F.when(F.col("kind") == "rain", F.coalesce(F.col("station_id"), -F.col("event_id") - 1)).otherwise(F.lit(0))
    rows = stream.withColumn("__station", station).withColumn("__part", F.pmod(F.hash("__station"), F.lit(STATION_PARTS)))
    rows = rows.select(*keys, "kind", "__part", "__station", "at", "event_id", "lat", "lon", "sim_s")
    group = [*keys, "kind", "__part"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    n = len(group)

    def work(key: tuple, held: tuple | None, ready: list[tuple], until: float) -> tuple:
        (stations, shift), out = held or ({}, 0.0), []
        rain = key[n - 2] == "rain"
        for row in ready:
            of, event, lat, lon, at = row[n + 1 :]
            shift = row[0] - at
            if of not in stations:
                stations[of] = storms.Recent(storms.REPEAT_S, storms.REPEAT_DEGREES)
            if stations[of].keeps(rain, at, lat, lon):
                out.append((*key[: n - 1], event, at))
        gone = {of: kept.rows[-1][0] + storms.REPEAT_S + 1 + shift if kept.rows else until for of, kept in stations.items()}
        stations = {of: kept for of, kept in stations.items() if gone[of] > until}
        return ((stations, shift), out, max(gone[of] for of in stations)) if stations else (None, out, None)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in group[:-1]) + ", event_id bigint, sim_s bigint"
    return in_event_order(rows, group, "at", ["event_id"], work, schema, late_s)


def pressure_changes(stream: DataFrame, key: str, late_s: int = LATE_S) -> DataFrame:
    """Each credible reading of a station and its changes over MINUTES: key, at_s, pressure, change_15, change_30, change_60, readings.

    A station keeps two hours of readings; of several at one time the last stays. A change is against the reading nearest to the asked time, the
    earlier of two, null where none is within NEAR_S of it. stream: key, a timestamp ``at``, event_id, pressure and sim_s, which runs as it does.
    """
    rows = stream.where(F.col("pressure").between(LOWEST, HIGHEST)).select(key, "at", "event_id", "pressure", "sim_s")

    def work(station: tuple, held: tuple | None, ready: list[tuple], until: float) -> tuple:
        (history, shift), out = held or ([], 0.0), []
        shift = ready[-1][0] - ready[-1][4] if ready else shift
        last_of = {row[4]: row[3] for row in ready}  # a later row of the same time takes the place
        for at, pressure in last_of.items():
            history = [h for h in history if h[0] >= at - KEPT_S and h[0] != at] + [(at, pressure)]
            changes = []
            for m in MINUTES:
                near = [(abs(t - (at - 60 * m)), t, p) for t, p in history[:-1] if abs(t - (at - 60 * m)) <= NEAR_S]
                changes.append(round(pressure - min(near)[2], 4) if near else None)
            out.append((*station, at, pressure, *changes, len(history)))
        gone = history[-1][0] + KEPT_S + 1 + shift
        return (None, out, None) if gone <= until else ((history, shift), out, gone)

    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, at_s bigint, pressure double, {', '.join(f'change_{m} double' for m in MINUTES)}, readings int"
    return in_event_order(rows, [key], "at", ["event_id"], work, schema, late_s)


def storms_followed(stream: DataFrame, key: str, late_s: int = LATE_S) -> DataFrame:
    """As ``storms.follow``, of a stream with a timestamp ``at``, which runs as sim_s does: the storms of each region after each cycle that the watermark has passed.

    State is a region's storms, which hold at most an hour, and the rows of cycles that are still open.
    """
    rows = storms.in_cycles(stream, key, ["at"])
    first = 5  # of the time, key, event_id, cycle_s and kind's rank
    timed = first + storms.FIELDS.index("sim_s")

    def work(region: tuple, held: tuple | None, ready: list[tuple], until: float) -> tuple:
        here, run, last, open_, shift = held or (storms.Region(), 0, None, {}, 0.0)
        shift = ready[-1][0] - ready[-1][timed] if ready else shift
        for row in ready:
            open_.setdefault(row[3], []).append((row[4], row[timed], row[2], row[first:]))
        out = []
        for cycle in sorted(c for c in open_ if c + storms.CYCLE_S + shift <= until):
            if last is not None and cycle - last > storms.CYCLE_S + storms.GONE_S:
                here, run = storms.Region(), run + 1
            here.cycle(cycle, [r[3] for r in sorted(open_.pop(cycle), key=lambda r: r[:3])])
            last = cycle
            out += [(*region, run, cycle, *s) for s in here.report(cycle + storms.CYCLE_S)]
        if last is not None and last + storms.CYCLE_S + storms.GONE_S + shift < until and not open_:
            here = storms.Region()  # all its storms are gone; the number of the run is kept
        return (here, run, last, open_, shift), out, min((c + storms.CYCLE_S + shift for c in open_), default=None)

    kind = rows.schema[key].dataType.simpleString()
    return in_event_order(rows, [key], "at", ["event_id"], work, f"`{key}` {kind}, run bigint, cycle_s bigint, {storms.REPORT}", late_s)


def event_stream(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Observations of a stream over the events table, with their times as ``at``, a day on: rows of the first second aren't late that way."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern may also name a single file
    return from_events(events, kind).withColumn("at", F.timestamp_seconds(F.col("sim_s") + DAY_S))


def replayed(spark: SparkSession, sf_dir: str, label: str, rows: int = SLICE_ROWS) -> DataFrame:
    """As ``event_stream``, of a table of any size: all its observations as files of about so many rows in the order of their times, one a batch.

    A batch's rows wait in state until the watermark is beyond them, so one batch of a whole table would hold all of it in memory. Files are cut by time
    and read in the order of their modification times, which are set by their numbers; rows without a time stay in the first.
    """
    events = from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    n = max(1, -(-events.count() // rows))
    folder = shared_path(spark, f"{label}-slices")
    events.repartitionByRange(n, "sim_s").write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in store.listStatus(path) if f.getPath().getName().endswith(".parquet")), key=lambda f: f.getName())
    begun = int(time.time()) - len(files)
    for k, f in enumerate(files):
        store.setTimes(f, (begun + k) * 1000, -1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn("at", F.timestamp_seconds(F.col("sim_s") + DAY_S))


def stream_without_repeats(spark, sf_dir):
    feeds = storms.two_feeds(replayed(spark, sf_dir, "repeats")).withColumn("at", F.timestamp_seconds(F.col("sim_s") + DAY_S))
    return drain(repeats_dropped(feeds, ["blob"]), "repeats").select("event_id", "blob", "kind", "sim_s")


QUERIES["ST5_stream_without_repeats"] = stream_without_repeats
ORACLES["ST5_stream_without_repeats"] = ORACLES["ST5_without_repeats"].rstrip() + f" AND sim_s < (SELECT max(sim_s) FROM feeds) - {LATE_S}"


def stream_pressure(spark, sf_dir):
    return drain(pressure_changes(event_stream(spark, sf_dir, "rain"), "station_id"), "pressure")


QUERIES["ST10_pressure_history"] = stream_pressure
ORACLES["ST10_pressure_history"] = OBS_SQL + f"""
, r AS (SELECT station_id, sim_s, pressure, event_id FROM obs WHERE kind = 'rain' AND pressure BETWEEN {LOWEST} AND {HIGHEST}),
p AS (SELECT station_id, sim_s, max_by(pressure, event_id) AS pressure FROM r GROUP BY 1, 2),
near AS (
    SELECT a.station_id, a.sim_s, m, a.pressure - b.pressure AS change, row_number() OVER (PARTITION BY a.station_id, a.sim_s, m ORDER BY abs(b.sim_s - (a.sim_s - 60 * m)), b.sim_s) AS k
    FROM p a JOIN p b ON b.station_id = a.station_id AND b.sim_s < a.sim_s, (VALUES (15), (30), (60)) v(m) WHERE abs(b.sim_s - (a.sim_s - 60 * m)) <= {NEAR_S}
),
kept AS (SELECT a.station_id, a.sim_s, count(*) AS readings FROM p a JOIN p b ON b.station_id = a.station_id AND b.sim_s BETWEEN a.sim_s - {KEPT_S} AND a.sim_s GROUP BY 1, 2)
SELECT p.station_id, p.sim_s AS at_s, pressure, {', '.join(f'round(max(change) FILTER (m = {m} AND k = 1), 4) AS change_{m}' for m in MINUTES)}, CAST(any_value(readings) AS INT) AS readings
FROM p JOIN kept USING (station_id, sim_s) LEFT JOIN near n ON n.station_id = p.station_id AND n.sim_s = p.sim_s
WHERE p.sim_s < (SELECT max(sim_s) FROM r) - {LATE_S} GROUP BY p.station_id, p.sim_s, pressure
"""


def recent_counts(stream: DataFrame, keys: list[str], late_s: int = LATE_S) -> DataFrame:
    """Rows of the last five and sixty minutes of each key, every five minutes, once the watermark has passed: keys, until_s, last_5, last_60."""
    rows = stream.withWatermark("at", f"{late_s} seconds").withColumn("w", F.window("at", "60 minutes", "5 minutes"))
    recent = F.col("at") >= F.col("w.end") - F.expr("INTERVAL 5 MINUTES")
    counted = rows.groupBy("w", *keys).agg(F.count_if(recent).alias("last_5"), F.count(F.lit(1)).alias("last_60"))
    return counted.select(*keys, F.unix_seconds("w.end").alias("until_s"), "last_5", "last_60")


def stream_counts(spark, sf_dir):
    return drain(recent_counts(event_stream(spark, sf_dir), ["blob", "kind"]), "counts").withColumn("until_s", F.col("until_s") - DAY_S)


QUERIES["ST8_recent_counts"] = stream_counts
ORACLES["ST8_recent_counts"] = OBS_SQL + f"""
SELECT blob, kind, CAST(sim_s // 300 * 300 + 300 * i AS BIGINT) AS until_s, count(*) FILTER (sim_s >= sim_s // 300 * 300 + 300 * i - 300) AS last_5, count(*) AS last_60 FROM obs, range(1, 13) r(i)
GROUP BY 1, 2, 3 HAVING until_s <= (SELECT max(sim_s) FROM obs) - {LATE_S}
"""


def stream_storms(spark, sf_dir):
    rows = in_regions(replayed(spark, sf_dir, "storms"), spark)
    return drain(storms_followed(storms.weighed(rows, ["at"]), "region_id"), "storms")


#: As in batch, SQL has no state that each row changes; `tests/test_state.py` holds the rows against the batch walk.
QUERIES["ST1_ST2_ST3_stream_storms"] = stream_storms
