"""Times of every type, emissions by type and the report of a flight on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trackweave.operators import monitor as M
from trackweave.operators import segments as S
from trackweave.operators import times as X


def seconds(df, c):
    return [r[0] for r in df.orderBy("i").select(F.unix_seconds(c)).collect()]


def test_texts_that_fail_are_numbers_of_a_unit_of_their_own(spark):
    rows = [(1, "g", "2024-01-01 00:00:00"), (2, "g", "1704067200000"), (3, "g", "1704067201000"), (4, "g", "?"), (5, "g", None), (6, None, "17"), (7, "h", "2024/01/01T00:00:01Z")]
    got = X.coerced(spark.createDataFrame(rows, "i int, g string, x string"), "x", "g")
    assert seconds(got, "coerced") == [1704067200, 1704067200, 1704067201, None, None, 17, 1704067201]
    assert X.coerced(spark.createDataFrame([], "i int, g string, x string"), "x", "g").count() == 0


@pytest.mark.parametrize("scale", [1, 1e3, 1e6, 1e9])
def test_unit_of_numbers(spark, scale):
    got = X.coerced(spark.createDataFrame([(1, "g", 1704067200.0 * scale), (2, "g", None), (3, "g", 1704067300.0 * scale)], "i int, g string, x double"), "x", "g")
    assert seconds(got, "coerced") == [1704067200, None, 1704067300]


def test_times_by_type(spark):
    df = spark.createDataFrame([(1, 10.5, "10.5", "1970-01-01 00:00:10", dt.datetime(1970, 1, 1, 0, 0, 10)), (2, None, "x", "x", None)], "i int, number double, time string, other string, stamp timestamp_ntz")
    for c in ("number", "time", "other", "stamp"):
        assert seconds(df.withColumn("t", X.as_time(df, c)), "t") == [10, None]
        assert X.within(df, c, 10_000_000, 11_000_000).count() == 1 and X.within(df, c, 11_000_000, 12_000_000).count() == 0 and X.within(df, c, 0, 10_000_000).count() == 0


def test_emissions(spark):
    rows = [("a", 100.0, 37000.0, "b787"), ("b", 0.0, 37000.0, "B787"), ("c", 100.0, None, "unknown"), ("d", 100.0, -1.0, None), ("e", None, 1e6, "A330"), ("f", 100.0, 1e6, "A330")]
    got = {r.name: r for r in M.emissions(spark.createDataFrame(rows, "name string, km double, ft double, kind string"), "km", "ft", "kind").collect()}
    assert (got["a"].fuel_kg, got["a"].co2_kg, got["a"].co2_per_km, got["a"].aircraft_type) == (550.0, 1738.0, 17.38, "B787")
    assert (got["b"].co2_kg, got["b"].mean_altitude_ft, got["b"].aircraft_type, got["b"].distance_km) == (0.0, 35000.0, "fleet_average", 0.0)
    assert got["c"].efficiency_factor == round(1 + 8 * (2000 / 37000) ** 2, 4) and got["d"].efficiency_factor == 1.0
    assert got["e"].co2_kg == 0.0 and got["f"].efficiency_factor == 1.2


def test_first_callsign(spark):
    rows = [("a", 2, 1, " X "), ("a", 1, 2, None), ("b", 1, 3, "  "), ("b", 2, 4, "Y"), ("c", 1, 5, None)]
    got = {r.k: r.callsign for r in S.first_callsign(spark.createDataFrame(rows, "k string, t long, event_id long, cs string"), ["k"], "cs").collect()}
    assert got == {"a": "X", "b": None}


def test_report_of_a_flight(spark):
    ends = spark.createDataFrame([("s", 0, 60_000_000, 0.0, 0.0, 0.0, 2.0)], "segment_id string, t0 long, t1 long, lat0 double, lon0 double, lat1 double, lon1 double")
    placed = spark.createDataFrame([("s", 1, 30_000_000, 1.0, 1.0, 0.0, 1.0)], "segment_id string, event_id long, t long, smooth_lat double, smooth_lon double, latitude double, longitude double")
    r = M.flight_report(placed, ends, 35000.0).first()
    assert r.gap_duration_minutes == 1.0 and r.n_waypoints == 1 and r.true_dist_km == 0.0
    assert abs(r.anchor_dist_km - 222.39) < 0.01 and abs(r.mean_xt_km - 111.19) < 0.01 and abs(r.smooth_dist_km - 2 * 157.25) < 0.05
    assert abs(r.co2_diff_kg - (r.smooth_co2_kg - r.baseline_co2_kg)) < 1e-6
    assert M.flight_report(placed.limit(0), ends, 35000.0).count() == 0
