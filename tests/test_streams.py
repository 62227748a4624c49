"""Streams with a state: sessions over two runs, the best of a key, a polled source, the filter of a gap; streams without rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import smoother as Z
from trackweave.streaming import live as L
from trackweave.streaming import stateful as W
from trackweave.streaming import tables as Y

H = 3_600_000_000
REPORTS = "icao24 string, event_id long, t long, latitude double, longitude double"


def reports(spark, rows):
    return spark.createDataFrame(rows, REPORTS).withColumn("time", F.timestamp_micros("t"))


def run(spark, tmp_path, batches, gap=2 * H):
    out = None
    for rows in batches:
        df = reports(spark, rows)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        out = W.stream_segments(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), gap, f"{tmp_path}/out", f"{tmp_path}/state")
    return sorted(tuple(r) for r in out.collect())


def test_a_session_over_two_runs_is_given_once(spark, tmp_path):
    day = 24 * H
    first = [("a", 1, day - 3 * H, 1.0, 1.0), ("a", 2, day - H, 2.0, 2.0), ("b", 3, day - 2 * H, 5.0, 5.0)]
    late = [("a", 4, day + H, 4.0, 4.0), ("a", 5, day, 3.0, 3.0), ("b", 6, day + H // 2, 6.0, 6.0), ("b", 7, day + H, 7.0, 7.0), ("z", 8, day + 40 * H, 0.0, 0.0)]
    assert run(spark, tmp_path, [first, late]) == [("a", day - 3 * H, day + H, 4, 1.0, 1.0, 4.0, 4.0), ("b", day + H // 2, day + H, 2, 6.0, 6.0, 7.0, 7.0)]


def test_a_delta_of_just_the_gap_does_not_split_and_single_reports_are_no_segment(spark, tmp_path):
    rows = [("a", 1, H, 1.0, 1.0), ("a", 2, 3 * H, 2.0, 2.0), ("a", 3, 5 * H + 1, 3.0, 3.0), ("c", 4, H, 1.0, 1.0), ("c", 5, H, 1.0, 1.0), ("z", 9, 100 * H, 0.0, 0.0)]
    assert run(spark, tmp_path, [rows]) == [("a", H, 3 * H, 2, 1.0, 1.0, 2.0, 2.0)]


def test_streams_without_rows(spark, tmp_path):
    assert run(spark, tmp_path, [[]]) == []
    spark.createDataFrame([], "k string, n long, day string").write.parquet(f"{tmp_path}/none")
    source = spark.readStream.schema("k string, n long, day string").parquet(f"{tmp_path}/none")
    assert Y.stream_by_day(source, F.col("day"), f"{tmp_path}/o1", f"{tmp_path}/s1").count() == 0
    assert Y.stream_latest(source.groupBy("k").agg(F.sum("n").alias("n")), ["k"], f"{tmp_path}/o2", f"{tmp_path}/s2").count() == 0
    assert W.stream_best(source, "k", [F.col("n")], f"{tmp_path}/o3", f"{tmp_path}/s3").count() == 0


def test_a_better_row_that_comes_later_replaces_the_first(spark, tmp_path):
    schema, best = "k string, listed boolean, size long, name string", None
    for rows in ([("x", False, 9, "a"), ("y", True, 1, "b"), (None, True, 1, "n")], [("x", True, 1, "c"), ("y", True, 1, "a")], [("x", True, 1, "d"), ("y", False, 99, "z")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        best = W.stream_best(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "k", [~F.col("listed"), -F.col("size"), F.col("name")], f"{tmp_path}/out", f"{tmp_path}/state")
    assert {tuple(r) for r in best.select("k", "listed", "size", "name").collect()} == {("x", True, 1, "c"), ("y", True, 1, "a"), (None, True, 1, "n")}


def vector(icao, contact, lon=-30.0, lat=50.0, baro=9000.0, ground=False, speed=200.0, heading=None, geo=None):
    return [icao, " F1 ", None, None, contact, lon, lat, baro, ground, speed, heading, None, None, geo]


def test_polls(spark, tmp_path):
    lines = {
        1: [vector("a", 90), vector("b", 60, ground=True), vector("c", 90, lat=None), None, []],
        2: [vector("a", 90, geo=10000.0), vector("d", 180, speed=None), vector("e", 180, lon=40.0), vector("f", 60)],
        3: [vector("a", 270)], L.BLOCK: [vector("g", L.BLOCK * 90)], 5 * L.BLOCK: [vector("h", 5 * L.BLOCK * 90)],
    }
    for poll, states in lines.items():
        folder = tmp_path / f"block={poll // L.BLOCK}"
        folder.mkdir(exist_ok=True)
        (folder / f"{poll}.txt").write_text(json.dumps({"time": poll * 90, "states": states}) + "\n")
    spark.dataSource.register(L.LiveStates)
    states = spark.readStream.format("live_states").options(path=f"file://{tmp_path}", first=1, last=5 * L.BLOCK, box="35,75,-75,15", failing=3).load()
    up = L.airborne(states).drop("heading_deg", "latitude", "longitude")
    Y.finish(up.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start())
    got = {tuple(r) for r in spark.read.schema(up.schema).parquet(f"{tmp_path}/out").collect()}
    feet = round(9000 * 3.28084)
    # poll 3 and those of the last blocks that are divisible by three fail; folders 2 to 4 are not there
    assert got == {(1, "a", "F1", feet, 389), (2, "a", "F1", 32808, 389)}
    assert L.vector(1, None) is None and L.vector(1, []) is None
    assert L.poll_range(spark.createDataFrame([], "t long")) == (0, -1)


def test_polls_are_read_one_at_a_time(tmp_path):
    """A later line that cannot be read does not hold up the polls before it, as no folder is held whole."""
    (tmp_path / "block=0").mkdir()
    state = ["a", "F1", None, 1, 1, 2.0, 50.0, 1.0, False, 5.0, 6.0, None, None, 4.0]
    (tmp_path / "block=0" / "part.txt").write_text(json.dumps({"time": 90, "states": [state]}) + "\n" + json.dumps({"time": 180, "states": None}) + "\nnot yet written")
    rows = L.LiveReader({"path": f"file://{tmp_path}", "first": "1", "last": "9"}).read(L.Polls(0, 1, 9))
    assert next(rows)[:3] == (1, 1, "a")
    with pytest.raises(ValueError):
        next(rows)
    assert list(L.LiveReader({"path": f"file://{tmp_path}", "first": "1", "last": "9"}).read(L.Polls(7, 1, 9))) == []


def test_snapshots_hold_the_newest_report_of_an_aircraft(spark, tmp_path):
    rows = [("a", "x", 10_000_000, 1.0, 2.0, 3.0, None, False, 5.0, 6.0, 1), ("a", "x", 20_000_000, 1.5, 2.0, 3.0, 4.0, False, 5.0, 6.0, 2), ("b", None, 95_000_000, None, 2.0, 3.0, 4.0, True, 5.0, 6.0, 3)]
    df = spark.createDataFrame(rows, "icao24 string, callsign string, t long, latitude double, longitude double, baro_m double, altitude_m double, on_ground boolean, velocity_mps double, heading_deg double, event_id long")
    L.write_snapshots(df, f"{tmp_path}/polls")
    polls = {s["time"] // 90: s["states"] for s in (json.loads(r.value) for r in spark.read.text(f"{tmp_path}/polls").select("value").collect())}
    assert [len(polls[p]) for p in (1, 2, 3)] == [1, 2, 1]
    assert polls[1] == [["a", "x", None, 20, 20, 2.0, 1.5, 3.0, False, 5.0, 6.0, None, None, 4.0]] and polls[3][0][6] is None


def test_filter_as_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        for k in range(0 if g == 5 else 30):
            t = (g + 1) * H + k * H // 10 + rng.randrange(1000)
            seen = rng.random() < (0.0 if g == 4 else 0.5)
            rows.append((f"s{g}", t, rng.gauss(0, 1e4) if seen else None, rng.gauss(0, 1e3) if seen else None, None if seen else 100 * g + k, (g + 7) * H))
    rows.append(("z", 50 * H, 1.0, 1.0, None, 60 * H))
    schema = "segment_id string, t long, along_m double, cross_m double, event_id long, until long"
    params, got = (500.0, 0.01, 0.003), None
    for late, part in ((False, [r for r in rows if r[1] < 5 * H]), (True, [r for r in rows if r[1] >= 5 * H])):
        part = part[::-1] if late else part
        df = spark.createDataFrame(part, schema).withColumn("time", F.timestamp_micros("t"))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        got = W.stream_smoothed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), params, f"{tmp_path}/out", f"{tmp_path}/state")
    want = Z.smooth_gaps(spark.createDataFrame(rows, schema).drop("until"), [params])
    a, b = ({(r.segment_id, r.event_id): (r.along_m, r.cross_m) for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) > 40 and all(np.allclose(a[k], b[k]) for k in a)


def test_alerts_follow_the_newest_statistics(spark, tmp_path):
    from trackweave.operators import monitor as M

    schema, told = "month string, n long, gap double", None
    none = spark.createDataFrame([], "month string, n_flights long, improvement double")
    first = [(f"m{i}", 1, 10.0) for i in range(4)] + [("m9", 100, 10.0)]
    for rows in (first, [(f"m{i}", 99, 20.0) for i in range(1, 4)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stats = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").groupBy("month").agg(F.sum("n").alias("n_segments"), F.max("gap").alias("mean_gap_min"))
        told = Y.stream_alerts(stats, ["month"], lambda latest: M.alerts(latest, none), f"{tmp_path}/out", f"{tmp_path}/state")
        if rows is first:
            assert {(r.type, r.month) for r in told.collect()} == {("LOW_COVERAGE", f"m{i}") for i in range(4)}
    assert {(r.type, r.month) for r in told.collect()} == {("LOW_COVERAGE", "m0")}
    empty = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*none*").groupBy("month").agg(F.sum("n").alias("n_segments"), F.max("gap").alias("mean_gap_min"))
    assert Y.stream_alerts(empty, ["month"], lambda latest: M.alerts(latest, none), f"{tmp_path}/o2", f"{tmp_path}/s2").count() == 0
