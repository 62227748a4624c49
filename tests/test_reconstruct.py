"""The gap smoother, the recurrent network, alerts, schema resolution and the bucketed range join on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import monitor as M
from trackweave.operators import recurrent as N
from trackweave.operators import smoother as Z
from trackweave.operators.ranges import points_within
from trackweave.sources import schema

MIN = 60_000_000


def plain_smoother(t, z, sigma, qa, qc):
    """Four states at once with full matrices, to compare."""
    h, r, n = np.eye(2, 4), np.eye(2) * sigma**2, len(t)
    known = [i for i in range(n) if not np.isnan(z[i, 0])]
    v = (z[known[1]] - z[known[0]]) / max(t[known[1]] - t[known[0]], 1.0) if len(known) > 1 else np.zeros(2)
    x, p = np.concatenate([z[known[0]], v]), np.diag([4 * sigma**2, 4 * sigma**2, 250.0**2, 50.0**2])
    got, pred, fs = [], [], []
    for i in range(n):
        dt = t[i] - t[i - 1] if i else 0.0
        f = np.eye(4) + dt * np.eye(4, k=2)
        if i:
            g = np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
            x, p = f @ x, f @ p @ f.T + np.kron(g, np.diag([qa**2, qc**2]))
        pred.append((x, p)), fs.append(f)
        if not np.isnan(z[i, 0]):
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            x, p = x + k @ (z[i] - h @ x), (np.eye(4) - k @ h) @ p
        got.append((x, p))
    out = [got[-1][0]]
    for i in range(n - 2, -1, -1):
        c = got[i][1] @ fs[i + 1].T @ np.linalg.inv(pred[i + 1][1])
        out.append(got[i][0] + c @ (out[-1] - pred[i + 1][0]))
    return np.array(out[::-1])[:, :2]


def test_smoother_equals_full_matrices():
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(30, 900, 25))
    z = np.stack([t * 230, 2000 * np.sin(t / 3000)], axis=1) + rng.normal(0, 300, (25, 2))
    z[rng.permutation(25)[:10]] = np.nan
    sets = [(250.0, 0.005, 0.001), (1000.0, 0.05, 0.01)]
    got = Z._smooth(t, z, np.array(sets))
    for i, s in enumerate(sets):
        assert np.allclose(got[:, i], plain_smoother(t, z, *s), atol=0.5)


def test_gaps_without_measurements_give_nothing(spark):
    rows = spark.createDataFrame([("a", 0, None, None, 1), ("b", 0, 0.0, 0.0, None), ("b", MIN, None, None, 2), ("b", 2 * MIN, 24000.0, 0.0, None)], "segment_id string, t long, along_m double, cross_m double, event_id long")
    got = Z.smooth_gaps(rows, [(100.0, 0.001, 0.001)]).collect()
    assert [(g.segment_id, g.event_id) for g in got] == [("b", 2)] and got[0].along_m == pytest.approx(12000, abs=200)
    assert Z.smooth_gaps(rows.limit(0), [(100.0, 0.001, 0.001)]).count() == 0


def test_path_position_undoes_along_cross(spark):
    from trackweave.functions import geo

    row = spark.createDataFrame([(50.0, -50.0, 55.0, -10.0, x, y) for x, y in ((500_000.0, 0.0), (900_000.0, 30_000.0), (1_500_000.0, -45_000.0))], "lat0 double, lon0 double, lat1 double, lon1 double, along double, across double")
    lat, lon = Z.path_position(F.col("along"), F.col("across"))
    back = geo.along_cross_m(*map(F.col, ("lat0", "lon0", "lat1", "lon1")), lat, lon)
    # the course is the bearing at the point 10 km before, so it differs by up to 10 km * tan(latitude) / radius from that at the place
    for r in row.select("along", "across", back[0].alias("a"), back[1].alias("c")).collect():
        assert r.a == pytest.approx(r.along, abs=1 + 0.0025 * abs(r.across)) and r.c == pytest.approx(r.across, abs=1)


def test_tune_takes_the_first_of_equal_ones(spark):
    placed = spark.createDataFrame([("a", 1, p, 50.0 + x, 0.0) for p, x in ((0, 0.2), (1, 0.1), (2, 0.1))], "segment_id string, event_id long, param_id int, smooth_lat double, smooth_lon double")
    truth = spark.createDataFrame([(1, 50.0, 0.0)], "event_id long, latitude double, longitude double")
    assert [r.param_id for r in Z.tune(placed, truth, Z.parameter_grid("compact")).collect()] == [1, 2, 0]
    assert len(Z.parameter_grid("deep")) == 210


def test_network_sizes_and_forward_step_by_step():
    assert sum(int(np.prod(s)) for s in N.shapes().values()) == 1_045_795
    rng, w = np.random.default_rng(3), N.seeded_weights(hidden=5)
    w = {k: v + rng.normal(0, 0.1, v.shape) for k, v in w.items()}
    before, after, way = rng.normal(size=(3, 7, 6)), rng.normal(size=(3, 4, 6)), rng.normal(size=(3, 2, 3))
    mb, ma = np.array([[0] * 4 + [1] * 3, [1] * 7, [0] * 7], dtype=float), np.array([[1, 1, 0, 0], [1] * 4, [0] * 4], dtype=float)
    gap = np.array([6000.0, 12000.0, 0.0])

    def step(name, x, h):
        head, tail = name.split(".")
        i, s = w[f"{head}.w_ih_{tail}"] @ x + w[f"{head}.b_ih_{tail}"], w[f"{head}.w_hh_{tail}"] @ h + w[f"{head}.b_hh_{tail}"]
        (ri, zi, ni), (rh, zh, nh) = np.split(i, 3), np.split(s, 3)
        sig = lambda v: 1 / (1 + np.exp(-v))
        z = sig(zi + zh)
        return (1 - z) * np.tanh(ni + sig(ri + rh) * nh) + z * h

    def run(name, xs):
        h, out = np.zeros(5), []
        for x in xs:
            h = step(name, x, h)
            out.append(h)
        return out

    import math

    gelu = np.vectorize(lambda v: 0.5 * v * (1 + math.erf(v / math.sqrt(2))))
    got = N.forward(w, before, mb, after, ma, gap, way)
    for b in range(3):
        x = list(before[b][: max(1, int(mb[b].sum()))])
        for layer in (0, 1):
            f, r = run(f"before.{layer}", x), run(f"before.{layer}_reverse", x[::-1])[::-1]
            x = [np.concatenate(p) for p in zip(f, r)]
        y = list(after[b][: max(1, int(ma[b].sum()))])
        for layer in (0, 1):
            y = run(f"after.{layer}", y)
        valid = np.flatnonzero(mb[b])
        h = np.tanh(w["h0.w"] @ np.concatenate([f[-1], r[0], y[-1], [gap[b] / 6000], before[b][valid[-1]] if len(valid) else np.zeros(6)]) + w["h0.b"])
        for i in range(2):
            h = step("decoder.0", way[b, i], h)
            v = w["head.w_0"] @ h + w["head.b_0"]
            v = (v - v.mean()) / np.sqrt(v.var() + 1e-5) * w["norm.w"] + w["norm.b"]
            want = w["head.w_2"] @ gelu(w["head.w_1"] @ gelu(v) + w["head.b_1"]) + w["head.b_2"]
            assert np.allclose(got[b, i], want, atol=1e-5)


def test_infer_on_an_empty_table(spark):
    dense = spark.createDataFrame([], "icao24 string, t long, event_id long, latitude double, longitude double, velocity_mps double, heading_deg double, altitude_m double")
    ends = spark.createDataFrame([], "segment_id string, icao24 string, seq long, t0 long, t1 long, lat0 double, lon0 double, lat1 double, lon1 double")
    targets = spark.createDataFrame([], "icao24 string, seq long, event_id long, t long, latitude double, longitude double")
    assert N.infer(N.samples(dense, targets, ends, MIN), N.seeded_weights(hidden=4)).count() == 0


def test_tracks_side_by_side_equal_the_filter_of_each(spark, monkeypatch):
    """Against matrices, a track at a time; tracks of one row, equal times, a null key, a row without a place, several batches."""
    import random

    from trackweave.operators import tracks as K

    rng, rows = random.Random(5), []
    for g in range(60):
        for i in range(rng.choice((1, 2, 7, 30))):
            rows.append((None if g == 0 else f"k{g // 2}", g % 2, 100 * g + i, rng.randrange(40) * 600_000_000, 50 + rng.random(), rng.random()))
    df = spark.createDataFrame([*rows, ("k9", 0, 9999, 5, None, 1.0)], "icao24 string, seq long, event_id long, t long, latitude double, longitude double").repartition(3)
    k, want = 6371000.0 * np.pi / 180, {}
    for key in {r[:2] for r in rows}:
        g = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[2]))
        la0, lo0, h = g[0][4], g[0][5], np.eye(2, 4)
        z = [np.array([(r[5] - lo0) * k * np.cos(np.radians(la0)), (r[4] - la0) * k]) for r in g]
        x, p, seen = np.array([*z[0], 0.0, 0.0]), np.diag([4 * 2000.0**2] * 2 + [250.0**2] * 2), []
        for i, r in enumerate(g):
            dt = (r[3] - g[i - 1][3]) / 1e6 if i else 0.0
            f = np.eye(4) + dt * np.eye(4, k=2)
            x, p = f @ x, f @ p @ f.T + np.kron(np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]]) * 0.01, np.eye(2))
            ahead = x, p
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + 2000.0**2 * np.eye(2))
            x, p = x + gain @ (z[i] - h @ x), (np.eye(4) - gain @ h) @ p
            seen.append([x, p, f, *ahead])
        for i in range(len(g) - 2, -1, -1):
            seen[i][0] = seen[i][0] + seen[i][1] @ seen[i + 1][2].T @ np.linalg.pinv(seen[i + 1][4]) @ (seen[i + 1][0] - seen[i + 1][3])
        want |= {r[2]: (la0 + s[0][1] / k, lo0 + s[0][0] / (k * np.cos(np.radians(la0)))) for r, s in zip(g, seen)}
    for cells in (K.CELLS, 16):
        monkeypatch.setattr(K, "CELLS", cells)
        got = {r.event_id: (r.smooth_lat, r.smooth_lon) for r in K.kalman_smooth(df, ["icao24", "seq"]).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[e], want[e], atol=1e-7, rtol=0) for e in want)
    many = np.arange(400.0) * 60 + np.zeros((500, 1)), np.zeros((500, 400, 2))
    assert np.abs(K.smooth_tracks(*many, 2000.0, 0.01)).max() == 0


def test_samples_go_through_the_network_in_bounded_parts():
    import pandas as pd

    got = list(N.in_parts(iter([pd.DataFrame({"a": range(n)}) for n in (0, 3, 2 * N.TOGETHER + 1)])))
    assert [len(f) for f in got] == [3, N.TOGETHER, N.TOGETHER, 1] and got[2]["a"].iloc[0] == N.TOGETHER


def test_padding_masks_and_missing_features(spark):
    dense = spark.createDataFrame([("a", 1, 1, 53.0, None, 240.0, float("nan"), 10500.0), ("a", 9, 2, 61.0, -30.0, 270.0, 90.0, 11500.0)], "icao24 string, t long, event_id long, latitude double, longitude double, velocity_mps double, heading_deg double, altitude_m double")
    ends = spark.createDataFrame([("s", "a", 1, 9)], "segment_id string, icao24 string, t0 long, t1 long")
    p = N.padded(dense, ends, MIN, 2, 3).first()
    assert p.before_mask == [0, 1] and p.after_mask == [1, 0, 0]
    assert p.before_seq == [[0.0] * 6, [0.0] * 6] and p.after_seq[0] == pytest.approx([1, 0, 1, 1, 0, 1])


def test_alerts(spark):
    stats = spark.createDataFrame([("2024-01", 100, 50.0), ("2024-02", 100, 60.0), ("2024-03", 10, 90.0), ("2024-04", 100, 95.0)], "month string, n_segments long, mean_gap_min double")
    errors = spark.createDataFrame([("2024-01", 5, 4.94), ("2024-02", 4, 1.0), ("2024-03", 9, None), ("2024-04", 9, 5.0)], "month string, n_flights long, improvement double")
    got = {(a.type, a.month): a.message for a in M.alerts(stats, errors).collect()}
    assert got == {
        ("LOW_COVERAGE", "2024-03"): "Only 10 segments (mean=78). Possible ADS-C coverage gap.",
        ("MODEL_DRIFT", "2024-01"): "GRU improvement only 4.9% (threshold=5.0%). Possible model drift.",
        ("GAP_DURATION_TREND", "overall"): "Average gap duration increased from 55min to 93min. Possible ADS-C reporting change.",
    }
    assert M.alerts(stats.limit(0), errors.limit(0)).count() == 0


def test_fleet_mean():
    assert M.CO2_A_KM == pytest.approx(19.2077, abs=1e-4)


def test_first_of_equal_times_stays(spark):
    p = lambda v: spark.createDataFrame([("s", 1, v, v)], "segment_id string, t long, latitude double, longitude double")
    assert [(r.source, r.latitude) for r in M.full_track(p(1.0), p(0.0), p(2.0)).collect()] == [("before", 1.0)]


def test_schema_resolution(spark):
    t = spark.createDataFrame([("1.5", 7, 1)], "TS string, user_id long, `a.b` long")
    got = schema.resolve(t, {"time": ("double", ["time", "ts"]), "x": ("long", ["A.B"]), "alt": ("double", ["alt"])}, ["alt"])
    assert got.columns == ["time", "x", "alt"] and tuple(got.first()) == (1.5, 1, None)
    with pytest.raises(ValueError, match="no column for lat"):
        schema.resolve(t, {"lat": ("double", ["lat"])})


def test_points_within_meets_each_pair_once(spark):
    w = spark.createDataFrame([("a", 0, 250), ("a", 90, 100), ("a", 5, 5), ("a", None, 9), ("b", -150, 1)], "icao24 string, s long, e long")
    p = spark.createDataFrame([("a", 0, 1), ("a", 99, 2), ("a", 100, 3), ("a", 249, 4), ("a", 250, 5), ("b", -100, 6), ("b", None, 7)], "icao24 string, t long, event_id long")
    got = sorted((r.s, r.event_id) for r in points_within(w, p, F.col("s"), F.col("e"), ["t", "event_id"], 100).collect())
    assert got == [(-150, 6), (0, 1), (0, 2), (0, 3), (0, 4), (90, 2)]
