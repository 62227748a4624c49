"""Every track query against its SQL in another engine, and small hand-made tracks."""

import duckdb
import pytest

from trackweave.functions import geo
from trackweave.operators import segments as S
from trackweave.operators import tracks as K
from trackweave.plans import audits, catalog, full, learning, reconstruct, runs, sections, smoothing, stores  # noqa: F401  register their queries
from trackweave.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events".split()
MIN = 60_000_000
MAY_BE_EMPTY = {"alerts", "stream_alerts"}  # shown by hand in test_reconstruct.py and test_streams.py


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    assert got or name in MAY_BE_EMPTY
    if name in Q.ORACLE:
        cur = duck.execute(Q.ORACLE[name])
        want = rows([c[0] for c in cur.description], cur.fetchall())
        assert sorted(df.columns) == sorted(c[0] for c in cur.description)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=1e-9)) for x, y in zip(a, b)), (a, b)


def track(spark, data):
    return spark.createDataFrame([("a", i, t, *p) for i, (t, *p) in enumerate(data)], "icao24 string, event_id long, t long, latitude double, longitude double")


def test_sessionize_gap_is_strict(spark):
    df = track(spark, [(0, 0.0, 0.0), (90 * MIN, 0.0, 0.0), (180 * MIN + 1, 0.0, 0.0)])
    assert [r.seq for r in S.sessionize(df, 90 * MIN).orderBy("t").collect()] == [0, 0, 1]


def test_merge_windows(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 12), ("a", 13, 15), ("a", 14, 20)], "icao24 string, w0 long, w1 long")
    assert sorted((r.w0, r.w1) for r in S.merge_windows(df).collect()) == [(0, 12), (13, 20)]


def test_resampling(spark):
    pts = spark.createDataFrame([("a", t * 1_000_000, v) for t, v in ((10, 1.0), (60, 2.0), (150, 30.0), (240, 4.0))], "icao24 string, t long, v double")
    got = [r.v for r in K.resample(pts, ["icao24"], ["v"], MIN, True).orderBy("t").collect()]
    assert got[:2] == [None, 2.0] and got[2:] == pytest.approx([2 + 2 / 3, 3 + 1 / 3, 4])
    union = [r.v for r in K.resample(pts, ["icao24"], ["v"], MIN, False).orderBy("t").collect()]
    assert union == pytest.approx([1.0, 2 + 28 * 10 / 90, 2 + 28 * 70 / 90, 30 - 26 * 40 / 90])


def test_spike_goes(spark):
    df = track(spark, [(0, 50.0, 0.0), (10 * MIN, 50.5, 0.0), (20 * MIN, 70.0, 0.0), (30 * MIN, 51.5, 0.0)])
    assert sorted(r.event_id for r in K.drop_spikes(df, ["icao24"], 620).collect()) == [0, 1, 3]


def test_haversine_and_speed(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), 6371.0088).alias("d"), geo.wrap_lon(F.lit(-190.0)).alias("w"), geo.speed_kt(F.lit(1.0), F.lit(0.0)).alias("s")).first()
    assert r.d == pytest.approx(111.195080, abs=1e-6) and r.w == 170 and r.s is None


def test_smoother_meets_exact_reports(spark):
    df = track(spark, [(i * MIN, 50 + 0.1 * i, -30 + 0.2 * i) for i in range(6)])
    assert all(abs(r.smooth_lat - r.latitude) < 1e-3 and abs(r.smooth_lon - r.longitude) < 1e-3 for r in K.kalman_smooth(df, ["icao24"], sigma_m=1.0).collect())


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from trackweave.streaming.sessions import stream_sessions

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value")
    end = events.agg(F.max("ts")).first()[0]
    import datetime

    far = spark.createDataFrame([(-1, end + datetime.timedelta(days=30 * k), 0.0) for k in (1, 2)], "user_id long, ts timestamp_ntz, value double")
    for i, part in enumerate((events, far.where("ts < timestamp_ntz'%s'" % (end + datetime.timedelta(days=40))), far)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = stream_sessions(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.user_id, r.start, r.n_events) for r in out.where("user_id >= 0").collect()}
    batch = events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "24 hours").alias("w")).agg(F.count("*").alias("n"))
    assert got == {(r.user_id, r.w.start, r.n) for r in batch.collect()}
