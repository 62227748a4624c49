"""Sections, runs, stores and streams on small hand-made rows."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from trackweave.operators import catalog as C
from trackweave.operators import sections as X
from trackweave.operators import segments as S
from trackweave.operators import tracks as K
from trackweave.plans import sections as P
from trackweave.plans.queries import ORACLE
from trackweave.sources import tables as T
from trackweave.streaming import tables as Y

MIN = 60_000_000
ROW = "segment_id string, source_section string, ord long, t long, latitude double, longitude double"


def made(spark, data, section="adsc"):
    return spark.createDataFrame([("s", section, i, *p) for i, p in enumerate(data)], ROW)


def test_clean_counts_before_it_drops(spark):
    rows = [(0, 0.0, 0.0), (None, 0.0, 0.0), (MIN, None, 0.0), (2 * MIN, 91.0, 181.0), (4 * MIN, 0.0, 0.01), (4 * MIN, 0.0, 0.01), (4 * MIN, 0.0, 0.02), (3 * MIN, 0.0, 0.01)]
    kept, m = X.clean(made(spark, rows, "before"), ["latitude", "longitude"])
    (a,) = m.collect()
    assert (a.rows_raw, a.timestamp_null_count, a.invalid_coord_count, a.missing_key_value_count) == (8, 1, 2, 2)
    assert (a.duplicate_exact_count, a.duplicate_timestamp_count, a.rows_clean, a.was_unsorted) == (1, 1, 3, True)
    assert [r.ord for r in kept.orderBy("t").collect()] == [0, 7, 4]


def test_spikes_go_from_sparse_sections_only(spark):
    rows = [(0, 0.0, 0.0), (60 * MIN, 0.0, 5.0), (61 * MIN, 0.0, 40.0), (62 * MIN, 0.0, 5.2), (120 * MIN, 0.0, 10.0)]
    both = made(spark, rows).unionByName(made(spark, rows, "before"))
    kept, m = X.clean(both, ["latitude", "longitude"])
    got = {r.source_section: r for r in m.collect()}
    assert got["adsc"].isolated_spike_removed_count == 1 and got["before"].isolated_spike_removed_count == 0
    assert got["adsc"].speed_valid and not got["before"].speed_valid and got["adsc"].speed_before_kt > 700
    assert sorted(r.ord for r in kept.where("source_section = 'adsc'").collect()) == [0, 1, 3, 4]


@pytest.mark.parametrize("query", ["clean_audit", "clean_sections", "keep_drop_reasons", "section_issues"])
def test_sections_with_spikes_equal_their_sql(spark, tmp_path, query):
    # back and forth: the second and third sparse report are spikes between their own neighbours, the third not without the second
    reports = [(1, 0, "click", 0.0), (2, 60, "view", 0.0), (3, 70, "view", 500.0), (4, 80, "view", 0.0), (5, 90, "view", 500.0), (11, 300, "click", 0.0)]
    alone = [(12, 0, "click", 0.0), (13, 60, "view", 0.0), (15, 70, "view", 500.0), (16, 80, "view", 0.0), (17, 300, "click", 0.0)]
    start = dt.datetime(2024, 1, 3, 6)
    rows = [(i, start + dt.timedelta(minutes=m), user, kind, value, "{}") for user, some in ((7, reports), (8, alone)) for i, m, kind, value in some]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = getattr(P, query)(spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[query]})").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    if query == "clean_audit":
        assert sum(r.isolated_spike_removed_count for r in got.collect()) == 3


def test_spike_loop_equals_restarting_scan(spark):
    import random

    rnd = random.Random(3)
    rows = [(g, i, i * 10 * MIN, 0.0, rnd.choice((0.0, 0.5, 3.0, 9.0))) for g in range(40) for i in range(9)]

    def kt(a, b):
        return abs(b[2] - a[2]) * 6371.0 * 3.141592653589793 / 180 * 0.539956803 / ((b[0] - a[0]) / 3.6e9)

    want = set()
    for g in range(40):
        p = [r[2:] + (r[1],) for r in rows if r[0] == g]
        again = True
        while again:
            again = False
            for i in range(1, len(p) - 1):
                if kt(p[i - 1], p[i]) > 300 and kt(p[i], p[i + 1]) > 300 and kt(p[i - 1], p[i + 1]) <= 300:
                    del p[i]
                    again = True
                    break
        want |= {(g, x[3]) for x in p}
    df = spark.createDataFrame(rows, "g long, event_id long, t long, latitude double, longitude double")
    assert {(r.g, r.event_id) for r in K.drop_spikes(df, ["g"], 300).collect()} == want


def test_verdict_of_empty_and_broken_flights(spark):
    kept, m = X.clean(made(spark, []), ["latitude", "longitude"])
    assert kept.count() == m.count() == 0
    files = spark.createDataFrame([("s", True, True, True), ("x", False, False, False)], "segment_id string, required boolean, readable boolean, columns_ok boolean")
    got = {r.segment_id: (r.step2_keep, r.drop_reason) for r in X.keep_drop(files, m, X.boundaries(kept)).collect()}
    assert got == {"s": (False, "section_too_short_after_clean"), "x": (False, "missing_required_file;schema_issue;section_too_short_after_clean;unreadable_input")}


def test_kept_flight_and_its_issues(spark):
    rows = made(spark, [(0, 0.0, 0.0), (MIN, 0.0, 0.05)], "before").unionByName(made(spark, [(30 * MIN, 0.0, 1.0), (60 * MIN, 0.0, 2.0)])).unionByName(made(spark, [(61 * MIN, 0.0, 9.0)], "after"))
    kept, m = X.clean(rows, ["latitude", "longitude"])
    b = X.boundaries(kept)
    files = spark.createDataFrame([("s", True, True, True)], "segment_id string, required boolean, readable boolean, columns_ok boolean")
    v = X.keep_drop(files, m, b)
    assert [tuple(r) for r in v.collect()] == [("s", False, "implausible_anchor_speed_after_clean")]
    issues = {(r.source_section, r.issue_type) for r in X.section_issues(m, b, v).collect()}
    assert issues == {("after", "implausible_anchor_speed_after_clean"), ("after", "boundary_too_sparse")}


def test_unknown_boundary_speed_is_unreasonable(spark):
    screened = spark.createDataFrame([("s", "a", 0, 1, 0, 1)], "segment_id string, icao24 string, seq long, n_before long, n_during long, n_after long")
    one = spark.createDataFrame([("a", 0, 1, "A")], "icao24 string, seq long, n_flights long, flight_icao24 string")
    profile = spark.createDataFrame([("a", 0, 10.0)], "icao24 string, seq long, max_kt double")
    edges = spark.createDataFrame([("s", None, 750.0)], "segment_id string, before_kt double, after_kt double")
    assert S.validate(screened, one, profile, 700, edges).first().reasons == "boundary_speed_before_unreasonable"


def test_ranking_prefers_listed_then_metadata_then_run(spark):
    rows = [("k", "b", "s1", True, True, 1), ("k", "a", "s2", True, False, 9), ("k", "a", "s3", False, True, 9), ("k", None, "s4", True, True, 9), ("k", "b", "s0", True, True, 2)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "dedup_key string, source_run string, segment_id string, summary_present boolean, metadata_present boolean, adsc_rows long, adsb_before_rows long, adsb_after_rows long, stitched_rows long")
    assert [r.segment_id for r in C.rank_master(df).orderBy("duplicate_rank").collect()] == ["s0", "s1", "s4", "s2", "s3"]


def test_twins_and_parts(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5), ("b", "", None), ("c", 'x,"y"\nz', float("inf"))], "k string, v string, d double")
    parquet, csv = T.write_twins(df, f"file://{tmp_path}/t")
    assert sorted(parquet.collect(), key=str) == sorted(csv.collect(), key=str) == sorted(df.collect(), key=str)
    days = spark.createDataFrame([("1", 1), ("2", 2)], "day string, v long")
    T.overwrite_parts(days, f"file://{tmp_path}/p", ["day"])
    for _ in range(2):
        got = T.overwrite_parts(days.where("day = '2'").withColumn("v", F.lit(7).cast("long")), f"file://{tmp_path}/p", ["day"])
    assert sorted(map(tuple, got.collect())) == [("1", 1), ("2", 7)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("src", "out", "state"))
    for v in (1, 2):
        spark.createDataFrame([(v, f"d{v}"), (v + 10, "d0")], "id long, day string").coalesce(1).write.mode("append").parquet(src)
        got = Y.stream_by_day(spark.readStream.schema("id long, day string").parquet(src), F.col("day"), out, state)
    assert sorted(r.id for r in got.collect()) == [1, 2, 11, 12]


def test_no_window_of_resampling_is_gone_through_again_at_every_row(spark):
    """A frame that reaches to the end of a track costs the square of its rows."""
    rows = spark.createDataFrame([("s", 0, 1.0, None), ("s", 2 * MIN, 3.0, 5.0)], "k string, t long, a double, b double")
    got = K.resample(rows, ["k"], ["a", "b"], MIN, True)
    assert sorted(map(tuple, got.collect())) == [("s", 0, 1.0, None), ("s", MIN, 2.0, None), ("s", 2 * MIN, 3.0, 5.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
