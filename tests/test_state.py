import pickle
import random

from pyspark.sql import functions as F

from squallframe.operators import storms
from squallframe.sources.observations import observations
from squallframe.streaming import state

DATA = "/root/testdata/sf0.001"
LATE = 120


def run(spark, folder, schema, build, out, checkpoint):
    """All files of a folder that this checkpoint hasn't seen, one a batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = build(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def in_files(rows, folder, n, shuffle=0.0):
    """Rows in files by time, each rows's place moved by up to ``shuffle`` seconds; files get names in that order."""
    rng = random.Random(1)
    found = sorted(rows.collect(), key=lambda r: (r.sim_s + rng.uniform(0, shuffle), r.event_id))
    size = -(-len(found) // n)
    return [found[i : i + size] for i in range(0, len(found), size)]


def in_two_goes(spark, rows, build, tmp_path):
    """Half of the files, then, from the checkpoint, the rest. Gives the rows out and the state's size in rows after each go."""
    folder, schema, sizes = f"{tmp_path}/in", rows.schema, []
    parts = in_files(rows, folder, 6, shuffle=60.0)
    for go in (parts[:3], parts[3:]):
        for part in go:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        query = run(spark, folder, schema, build, f"{tmp_path}/out", f"{tmp_path}/state")
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return spark.read.parquet(f"{tmp_path}/out").collect(), sizes


def with_times(rows):
    return rows.withColumn("at", F.timestamp_seconds(F.col("sim_s") + 1_000_000))


def test_repeats_as_in_batch(spark, tmp_path):
    rows = with_times(storms.two_feeds(observations(spark, DATA)))
    until = rows.agg(F.max("sim_s")).first()[0] - LATE
    got, sizes = in_two_goes(spark, rows, lambda s: state.repeats_dropped(s, ["blob"], LATE), tmp_path)
    batch = storms.drop_repeats(rows.drop("at"), ["blob"]).where(F.col("sim_s") < until).collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in batch)
    assert sizes[1] < 60  # keys of the last two minutes only


def test_storms_as_in_batch(spark, tmp_path):
    radar = storms.weighed(observations(spark, DATA).withColumn("region_id", F.col("blob").cast("string")))
    rows = with_times(radar)
    until = rows.agg(F.max("sim_s")).first()[0] - LATE
    got, sizes = in_two_goes(spark, rows, lambda s: state.storms_followed(s, "region_id", LATE), tmp_path)
    batch = storms.follow(radar, "region_id").where(F.col("cycle_s") + storms.CYCLE_S <= until).collect()
    assert len(got) > 300 and sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r) for r in batch)))
    assert sizes == [4, 4]


def test_pressure_of_two_goes_equals_one(spark, tmp_path):
    rows = with_times(observations(spark, DATA, "rain").select("station_id", "event_id", "pressure", "sim_s"))
    got, sizes = in_two_goes(spark, rows, lambda s: state.pressure_changes(s, "station_id", LATE), tmp_path)
    until = rows.agg(F.max("sim_s")).first()[0] - LATE
    history, expected = {}, []
    for r in sorted((r for r in rows.collect() if r.sim_s < until), key=lambda r: (r.sim_s, r.event_id)):
        history.setdefault(r.station_id, {})[r.sim_s] = r.pressure
    for station, readings in history.items():
        for at, pressure in readings.items():
            changes = []
            for m in state.MINUTES:
                near = [(abs(t - (at - 60 * m)), t, p) for t, p in readings.items() if t < at and abs(t - (at - 60 * m)) <= state.NEAR_S]
                changes.append(round(pressure - min(near)[2], 4) if near else None)
            expected.append((station, at, pressure, *changes, sum(at - state.KEPT_S <= t <= at for t in readings)))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))
    assert sizes[1] < len(history)  # stations that were quiet for two hours are forgotten


def test_late_rows_nulls_and_repeated_times(spark, tmp_path):
    schema = "station_id long, event_id long, pressure double, sim_s long"
    first = [(1, 1, 1000.0, 1000), (1, 2, 1001.0, 1000), (1, 3, 999.0, 1900), (None, 4, 1000.0, 1000), (2, 5, None, 1000), (2, 6, 2000.0, 1000), (3, 7, 1000.0, 5000)]
    late = [(1, 8, 990.0, 1500), (1, 9, 998.0, 4890), (3, 10, 1000.0, 9000)]
    rows = with_times(spark.createDataFrame(first, schema))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    build = lambda s: state.pressure_changes(s, "station_id", LATE)
    run(spark, f"{tmp_path}/in", rows.schema, build, f"{tmp_path}/out", f"{tmp_path}/state")
    with_times(spark.createDataFrame(late, schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, f"{tmp_path}/in", rows.schema, build, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # the later of two readings of one time stays; the row of 1500 came when the watermark was at 4880
    assert got == [(1, 1000, 1001.0, None, None, None, 1), (1, 1900, 999.0, -2.0, None, None, 2), (1, 4890, 998.0, None, None, -3.0, 3), (3, 5000, 1000.0, None, None, None, 1)]


def test_a_region_can_be_kept_between_batches():
    region = storms.Region()
    region.cycle(0, [("radar", 10, 50.0, 5.0, 3, None, 1.0, None)])
    again = pickle.loads(pickle.dumps(region))
    for r in (region, again):
        r.cycle(300, [("lightning", 310, 50.05, 5.0, 0, None, 1.0, None)])
    assert region.report(600) == again.report(600)


def test_a_table_is_played_in_slices_of_its_time(spark, tmp_path):
    """One batch of a whole table would hold all its rows in state."""
    whole = observations(spark, DATA).count()
    stream = state.replayed(spark, DATA, "test", rows=200)
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, _: seen.append(df.agg(F.count(F.lit(1)), F.min("sim_s"), F.max("sim_s")).first())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    slices = [tuple(r) for r in seen if r[0]]
    assert len(slices) == -(-whole // 200) and sum(n for n, _, _ in slices) == whole and max(n for n, _, _ in slices) < whole // 2
    assert all(a[2] < b[1] for a, b in zip(slices, slices[1:], strict=False))


def test_queries_don_t_hold_a_table_in_state(spark, monkeypatch):
    """In slices of two hundred rows each state holds few, and rows stay as they are in one go."""
    whole = {name: sorted(map(repr, state.QUERIES[name](spark, DATA).collect())) for name in ("ST5_stream_without_repeats", "ST1_ST2_ST3_stream_storms")}
    plain = state.replayed
    played = []
    monkeypatch.setattr(state, "replayed", lambda s, d, label: (played.append(label), plain(s, d, label, 200))[1])
    for name, rows in whole.items():
        assert rows and sorted(map(repr, state.QUERIES[name](spark, DATA).collect())) == rows
    assert played == ["repeats", "storms"]


def test_recent_rows_by_squares_as_by_all():
    rng = random.Random(2)
    recent, kept = storms.Recent(storms.REPEAT_S, storms.REPEAT_DEGREES), []
    for k in range(4000):
        at, lat, lon = k // 40, rng.randrange(40) * 0.0005 - 0.01, rng.randrange(40) * 0.0005 - 0.01
        kept = [r for r in kept if r[0] >= at - storms.REPEAT_S]
        fresh = not any(abs(y - lat) < storms.REPEAT_DEGREES and abs(x - lon) < storms.REPEAT_DEGREES for _, y, x in kept)
        kept += [(at, lat, lon)] if fresh else []
        assert recent.keeps(False, at, lat, lon) == fresh and list(recent.rows) == kept
    recent.forget(10_000)
    assert not recent.rows and not recent.squares
