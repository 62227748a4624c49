"""Numbering in parts, sessions by days, windows with a manifest, saved runs, weights and tensors on small hand-made rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import numbering
from trackweave.operators import recurrent as N
from trackweave.operators import segments as S
from trackweave.operators import smoother as Z
from trackweave.plans import smoothing
from trackweave.sources import runs as R
from trackweave.sources.windows import Windows

DAY = 86_400_000_000


def digest(seed, name):
    return hashlib.md5(f"{seed}|{name}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 3])
def test_places_do_not_depend_on_the_layout(spark, digits):
    names = [f"n{i}" for i in range(300)]
    want = {n: i for i, n in enumerate(sorted(names, key=lambda n: (digest(5, n), n)), 1)}
    for parts in (1, 7):
        rows = numbering.permuted(spark.createDataFrame([(n,) for n in names], "name string").repartition(parts), F.col("name"), 5, digits).collect()
        assert {r.name: r.place for r in rows} == want and {r.total for r in rows} == {300}
    last = numbering.permuted(spark.createDataFrame([("a",), (None,), ("b",)], "name string"), F.col("name"), 5).orderBy("place").collect()
    assert last[-1].name is None and [r.place for r in last] == [1, 2, 3]
    assert numbering.permuted(spark.createDataFrame([], "name string"), F.col("name"), 5).count() == 0
    assert numbering.sampled(spark.createDataFrame([(n,) for n in names], "name string"), F.col("name"), 20, 5).count() == 20


def test_splits_have_exact_sizes_and_null_is_train(spark):
    keys = spark.createDataFrame([(f"k{i % 10}",) for i in range(40)] + [(None,)] * 3, "icao24 string")
    rows = numbering.split_of_keys(keys, "icao24").collect()
    assert sorted(r.split for r in rows if r.icao24) == ["test"] + ["train"] * 7 + ["val"] * 2
    assert [r.split for r in rows if r.icao24 is None] == ["train"]
    assert numbering.split_of_keys(keys.limit(0), "icao24").count() == 0


def test_sessions_by_days_equal_one_pass_over_an_aircraft(spark):
    rng = random.Random(1)
    rows = [("hot", i, t) for i, t in enumerate(sorted(rng.randrange(40 * DAY) for _ in range(600)))]
    rows += [("two", 1000, 0), ("two", 1001, DAY // 2), ("two", 1002, DAY + 1), ("two", 1003, 9 * DAY), (None, 1004, 5), (None, 1005, 5 * DAY), ("null", 1006, None), ("null", 1007, None), ("null", 1008, 3 * DAY)]
    gap, want = DAY // 2, {}
    for key in {r[0] for r in rows}:
        last, seq = None, 0
        for _, e, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            seq += last is not None and t is not None and t - last > gap
            last = t if t is not None else last
            want[e] = seq
    df = spark.createDataFrame(rows, "icao24 string, event_id long, t long").repartition(4)
    for day in (DAY, DAY // 7):
        assert {r.event_id: r.seq for r in S.sessionize(df, gap, day=day).collect()} == want
    assert S.sessionize(df.limit(0), gap).count() == 0


def test_a_broken_write_is_done_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i // 10}") for i in range(50)], "id long, window string")
    store = Windows(spark, str(tmp_path))
    assert store.finished().count() == 0 and store.read(rows).count() == 0 and store.todo(rows).count() == 50
    store.write(rows.where("window = 'w0'"))
    store.write(rows.where("window = 'w1' AND id % 2 = 0"), finish=False)
    assert store.todo(rows).count() == 40
    store.write(store.todo(rows))
    assert sorted(r.id for r in store.read(rows).collect()) == list(range(50))
    store.write(rows.where("window = 'w2'"))  # a second attempt at a finished window changes nothing
    assert store.read(rows).count() == 50


def test_windows_without_rows_are_finished_but_not_taken_from_the_cache(spark, tmp_path):
    store, rows = Windows(spark, str(tmp_path)), spark.createDataFrame([(1, "a")], "id long, window string")
    store.write(rows, windows=spark.createDataFrame([("a",), ("b",)], "window string"))
    assert {r.window: r.n for r in store.finished().collect()} == {"a": 1, "b": 0}
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    assert [store.cached("x", lambda n=n: make(n), "id long").count() for n in (0, 3, 5)] == [0, 3, 3]
    assert calls == [0, 3]


def test_master_of_runs(spark, tmp_path):
    root, out = f"{tmp_path}/runs", f"{tmp_path}/master"
    names = ["20240101_a_000000_010000", "20240102_b_000000_010000"]
    for run, segments in (("step1_raw_1", names), ("step1_raw_2", names[:1])):
        parts = [(s, i, i, s[:8], section) for s in segments for i, section in enumerate(R.SECTIONS) if not (s == names[1] and section == "adsb_after")]
        meta = [(s, s[:8], s[9], 0, 1, True, {x: 1 for x in R.SECTIONS}) for s in segments]
        sections = spark.createDataFrame(parts, "segment_id string, event_id long, t long, day string, section string")
        metadata = spark.createDataFrame(meta, "segment_id string, day string, icao24 string, s0 long, s1 long, is_valid boolean, files map<string, long>")
        R.write_run(root, run, sections, metadata, spark.createDataFrame([(s, 1) for s in segments], "segment_id string, n_points long") if run == "step1_raw_2" else None)
    row = "segment_id string, event_id long, t long, day string, section string"
    with pytest.raises(FileNotFoundError):
        R.catalogue(spark, out, "master_flights_catalog")
    version = R.build_master(spark, root, out, row)
    assert R.published(spark, out) == version
    get = lambda name: R.catalogue(spark, out, name)
    assert [(r.source_run, r.segment_id) for r in get("master_flights_catalog").collect()] == [("step1_raw_2", names[0])]  # the listed one wins
    assert get("duplicates").count() == 2 and get("all_saved_flight_folders").count() == 3
    kinds = {(r.source_run, r.segment_id, r.issue_type) for r in get("integrity_issues").collect()}
    assert ("step1_raw_1", names[1], "empty_adsb_after_file") in kinds and ("step1_raw_1", names[0], "saved_folder_missing_from_summary") in kinds
    assert spark.read.parquet(f"{version}/flights").count() == 4
    t = R.totals(spark, version).first()
    assert (t.raw_saved_flight_folders_found, t.valid_saved_flights_found, t.duplicate_records_found, t.final_unique_master_flights) == (3, 2, 1, 1)


def test_smoother_side_by_side_equals_one_by_one(spark):
    rng = np.random.default_rng(0)
    params = [(2000.0, 0.001, 0.01), (100.0, 0.01, 0.003)]
    rows, want = [], {}
    for g in range(25):
        n = int(rng.integers(1, 40))
        t = np.sort(rng.choice(10**6, n, replace=False)) * 10_000
        z = rng.normal(0, 1e4, (n, 2))
        z[rng.random(n) < 0.4] = np.nan
        got = None if np.isnan(z[:, 0]).all() else Z._smooth((t - t[0]) / 1e6, z, np.array(params))
        for i in range(n):
            measured = not np.isnan(z[i, 0])
            rows.append((f"s{g:02}", int(t[i]), *(z[i].tolist() if measured else (None, None)), 1000 * g + i))
            if got is not None:
                want |= {(1000 * g + i, p): got[i, p] for p in range(2)}
    df = spark.createDataFrame(rows, "segment_id string, t long, along_m double, cross_m double, event_id long").repartition(3)
    old = Z.CELLS
    try:
        for Z.CELLS in (old, 100):
            found = {(r.event_id, r.param_id): (r.along_m, r.cross_m) for r in Z.smooth_gaps(df, params).collect()}
            assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)
    finally:
        Z.CELLS = old
    assert Z.smooth_gaps(df.limit(0), params).count() == 0


def test_tuning_needs_a_validation_split(spark):
    none = spark.createDataFrame([], "segment_id string, t long, along_m double, cross_m double, event_id long")
    ends = spark.createDataFrame([], "segment_id string, lat0 double, lon0 double, lat1 double, lon1 double")
    truth = spark.createDataFrame([], "event_id long, latitude double, longitude double")
    with pytest.raises(ValueError):
        Z.tuned(none, ends, truth, spark.createDataFrame([], "segment_id string, split string"), [(1.0, 1.0, 1.0)])


def test_a_gap_of_a_joined_table_stays_whole(spark):
    # a join that turns into a broadcast at run time reads its other side as the mappers wrote it
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in confs.items():
        spark.conf.set(name, value)
    try:
        at = spark.range(0, 4000, 1, 8)
        rows = at.select(F.concat(F.lit("s"), F.col("id") % 100).alias("segment_id"), (F.col("id") * 1_000_000).alias("t"), *[F.when(F.col("id") >= 3000, F.col("id") * 1.0).alias(c) for c in ("along_m", "cross_m")], F.when(F.col("id") < 3000, F.col("id")).alias("event_id"))
        some = spark.range(100).where("id % 10 < 8").select(F.concat(F.lit("s"), F.col("id")).alias("segment_id"))
        got = Z.smooth_gaps(rows.join(some, "segment_id", "left_semi"), [(100.0, 0.01, 0.003)]).collect()
        assert len(got) == len({r.event_id for r in got}) == 2400
    finally:
        for name in confs:
            spark.conf.unset(name)


def test_tables_without_validation_gaps_tune_nothing(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for query in (smoothing.kalman_tune, smoothing.kalman_run):
        assert query(spark, str(tmp_path)).count() == 0


def test_improvement_over_nothing(spark):
    rows = spark.createDataFrame([("test", "a", 1.0, 0.0), ("test", "b", 1.0, 2.0)], "split string, segment_id string, kalman_km double, baseline_km double")
    got = {r.segment_id: r.improvement_mean_pct for r in Z.compare_with_base(rows, ["split", "segment_id"]).collect()}
    assert got["b"] == 50.0 and got["a"] == (1 - 1 / 1e-9) * 100


def test_weights_are_checked(spark, tmp_path):
    w = N.seeded_weights(hidden=4, layers=1)
    N.write_weights(spark, w, f"file://{tmp_path}/w")
    back = N.load_weights(f"file://{tmp_path}/w", 4, 1)
    assert back.keys() == w.keys() and all(np.array_equal(back[k], w[k]) for k in w)
    for wrong in ({k: v for k, v in w.items() if k != "h0.b"}, w | {"more": np.zeros(1)}, w | {"h0.b": np.zeros(5)}, w | {"h0.b": np.full(4, np.nan)}):
        with pytest.raises(ValueError):
            N.checked(wrong, 4, 1)


def test_tensors_of_another_shape_are_an_error(spark, tmp_path):
    step = [0.5] * N.FEATURES
    schema = "segment_id string, before_seq array<array<double>>, before_mask array<double>, after_seq array<array<double>>, after_mask array<double>, split string"
    for name, n in (("good", 3), ("bad", 2)):
        N.write_tensors(spark.createDataFrame([("a", [step] * n, [1.0] * n, [step] * 2, [1.0] * 2, "val")], schema), f"{tmp_path}/{name}")
    assert N.read_tensors(spark, f"{tmp_path}/good", "val", 3, 2).first().before_seq[0] == step
    assert N.read_tensors(spark, f"{tmp_path}/good", "test", 3, 2).count() == 0
    with pytest.raises(Exception, match="before_seq"):
        N.read_tensors(spark, f"{tmp_path}/bad", None, 3, 2).collect()
