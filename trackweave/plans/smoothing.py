"""Queries of the smoother: places in a gap, their errors, parameters tuned on one split and judged on another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numbering as N
from ..operators import smoother as Z
from ..operators import tracks as K
from ..sources.reports import points
from ..sources.tables import shared_folder, stage
from ..streaming.stateful import stream_smoothed
from .queries import _BASE, _CTE, CONTEXT, HOUR, _anc, _brg, _gc, _hav, _pts, _seg, query, r
from .reconstruct import _gap_rows

DEFAULT = (2000.0, 0.001, 0.01)  # fixed values: measurement std (m), acceleration std along and across (m/s2)
_P = "PARTITION BY segment_id"


def _clip(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


def _updated(r2: str) -> str:
    g, h = f"CASE WHEN z IS NULL THEN 0.0 ELSE pxx / (pxx + {r2}) END", f"CASE WHEN z IS NULL THEN 0.0 ELSE pxv / (pxx + {r2}) END"
    off = "(coalesce(z, px) - px)"
    return f"segment_id, ax, i, px, pv, pxx, pxv, pvv, px + {g} * {off} AS x, pv + {h} * {off} AS v, pxx - {g} * pxx AS xx, pxv - {g} * pxv AS xv, pvv - {h} * pxv AS vv"


def _smoothed_sql(params: tuple[float, float, float], before: int = 64, after: int = 32) -> str:
    """CTEs up to ``placed`` (segment_id, event_id, smooth_lat, smooth_lon): the filter and the pass back as recursions over steps."""
    r2, qa, qc = (f"{p * p!r}::DOUBLE" for p in params)
    dd, turn = f"{_hav('lat0', 'lon0', 'latitude', 'longitude')} / 6371000.0", f"radians({_brg('lat0', 'lon0', 'latitude', 'longitude')}) - radians({_brg('lat0', 'lon0', 'lat1', 'lon1')})"
    near, back, fore = (_gc(t) for t in ("tau", "tb", "ta"))
    return f"""{_CTE.replace('WITH proj', 'WITH RECURSIVE proj', 1)},
ctx0 AS (SELECT a.*, p.t, p.event_id, p.latitude, p.longitude, p.t <= a.t0 AS early FROM anc a JOIN adsb p ON p.icao24 = a.icao24 AND p.t >= a.t0 - {CONTEXT} AND p.t < a.t1 + {CONTEXT} WHERE p.t <= a.t0 OR p.t >= a.t1),
ctx1 AS (SELECT * FROM ctx0 QUALIFY row_number() OVER ({_P}, early ORDER BY CASE WHEN early THEN -t ELSE t END, CASE WHEN early THEN -event_id ELSE event_id END) <= CASE WHEN early THEN {before} ELSE {after} END),
ctx AS (SELECT * FROM ctx1 QUALIFY row_number() OVER ({_P}, t ORDER BY event_id DESC) = 1),
meas AS (SELECT segment_id, t, atan2(sin(dd) * cos(turn), cos(dd)) * 6371000.0 AS along_m, asin(least(1.0, greatest(-1.0, sin(dd) * sin(turn)))) * 6371000.0 AS cross_m FROM (SELECT segment_id, t, {dd} AS dd, {turn} AS turn FROM ctx)),
asked AS (SELECT a.segment_id, p.t, p.event_id, p.latitude, p.longitude FROM pts p JOIN anc a ON a.icao24 = p.icao24 AND a.seq = p.seq),
line AS (SELECT segment_id, t, row_number() OVER ({_P} ORDER BY t) AS i, count(*) OVER ({_P}) AS n, (t - lag(t) OVER ({_P} ORDER BY t)) / 1e6 AS dt, along_m, cross_m FROM (SELECT segment_id, t FROM meas UNION SELECT segment_id, t FROM asked) LEFT JOIN meas USING (segment_id, t)),
ln AS (SELECT segment_id, t, i, n, dt, ax, CASE ax WHEN 0 THEN along_m ELSE cross_m END AS z, CASE ax WHEN 0 THEN {qa} ELSE {qc} END AS q, CASE ax WHEN 0 THEN 62500.0::DOUBLE ELSE 2500.0::DOUBLE END AS v0 FROM line, (SELECT unnest([0, 1]) AS ax)),
kn AS (SELECT *, row_number() OVER ({_P}, ax ORDER BY i) AS k FROM ln WHERE z IS NOT NULL),
ini AS (SELECT a.segment_id, a.ax, a.z AS x, coalesce((b.z - a.z) / greatest((b.t - a.t) / 1e6, 1.0), 0.0) AS v FROM (SELECT * FROM kn WHERE k = 1) a LEFT JOIN (SELECT * FROM kn WHERE k = 2) b USING (segment_id, ax)),
fw AS (SELECT {_updated(r2)} FROM (SELECT l.segment_id, l.ax, l.i, l.z, s.x AS px, s.v AS pv, 4 * {r2} AS pxx, 0.0::DOUBLE AS pxv, l.v0 AS pvv FROM ln l JOIN ini s USING (segment_id, ax) WHERE l.i = 1)
 UNION ALL SELECT {_updated(r2)} FROM (SELECT l.segment_id, l.ax, l.i, l.z, f.x + l.dt * f.v AS px, f.v AS pv, f.xx + 2 * l.dt * f.xv + l.dt * l.dt * f.vv + l.q * pow(l.dt, 4) / 4 AS pxx, f.xv + l.dt * f.vv + l.q * pow(l.dt, 3) / 2 AS pxv, f.vv + l.q * l.dt * l.dt AS pvv FROM fw f JOIN ln l ON l.segment_id = f.segment_id AND l.ax = f.ax AND l.i = f.i + 1)),
st AS (SELECT f.*, l.n, lead(l.dt) OVER w AS nd, lead(px) OVER w AS ax_, lead(pv) OVER w AS av, lead(pxx) OVER w AS axx, lead(pxv) OVER w AS axv, lead(pvv) OVER w AS avv FROM fw f JOIN ln l USING (segment_id, ax, i) WINDOW w AS (PARTITION BY f.segment_id, f.ax ORDER BY f.i)),
bk AS (SELECT segment_id, ax, i, x AS sx, v AS sv FROM st WHERE i = n
 UNION ALL SELECT segment_id, ax, i, x + (xx + nd * xv) * ex + xv * ev, v + (xv + nd * vv) * ex + vv * ev FROM (SELECT s.*, (avv * dx - axv * dv) / det AS ex, (axx * dv - axv * dx) / det AS ev FROM (SELECT s.*, b.sx - s.ax_ AS dx, b.sv - s.av AS dv, s.axx * s.avv - s.axv * s.axv AS det FROM bk b JOIN st s ON s.segment_id = b.segment_id AND s.ax = b.ax AND s.i = b.i - 1) s)),
smooth AS (SELECT a.segment_id, a.event_id, a.latitude, a.longitude, any_value(sx) FILTER (WHERE ax = 0) AS along_m, any_value(sx) FILTER (WHERE ax = 1) AS cross_m FROM asked a JOIN line l USING (segment_id, t) JOIN bk b ON b.segment_id = l.segment_id AND b.i = l.i GROUP BY ALL),
way AS (SELECT s.*, lat0, lon0, lat1, lon1, {_clip('along_m / total')} AS tau, least(0.01, 10000.0 / total) AS eps FROM smooth s JOIN (SELECT *, greatest({_hav('lat0', 'lon0', 'lat1', 'lon1')}, 1.0) AS total FROM anc) USING (segment_id)),
ends AS (SELECT *, {_clip('tau - eps')} AS tb, {_clip('tau + eps')} AS ta FROM way),
spot AS (SELECT *, {near[0]} AS hl, {near[1]} AS ho, {back[0]} AS bl, {back[1]} AS bo, {fore[0]} AS fl, {fore[1]} AS fo FROM ends),
turn AS (SELECT *, radians({_brg('bl', 'bo', 'fl', 'fo')} + CASE WHEN cross_m >= 0 THEN 90.0 ELSE -90.0 END) AS c, abs(cross_m) / 6371000.0 AS s FROM spot),
dest AS (SELECT *, asin(sin(radians(hl)) * cos(s) + cos(radians(hl)) * sin(s) * cos(c)) AS la FROM turn),
placed AS (SELECT segment_id, event_id, latitude, longitude, degrees(la) AS smooth_lat, x - 360 * floor(x / 360) - 180 AS smooth_lon FROM (SELECT *, degrees(radians(ho) + atan2(sin(c) * sin(s) * cos(radians(hl)), cos(s) - sin(radians(hl)) * sin(la))) + 180 AS x FROM dest))
"""


@query(_smoothed_sql(DEFAULT) + "SELECT segment_id, event_id, round(smooth_lat, 4) AS smooth_lat, round(smooth_lon, 4) AS smooth_lon FROM placed", cte=False)
def kalman_gap(spark, d):
    """Each sparse report's place as smoothed along and across the great circle, by the default parameters."""
    p = Z.positions(Z.smooth_gaps(_gap_rows(spark, d), [DEFAULT]), _anc(spark, d))
    return p.select("segment_id", "event_id", r("smooth_lat", 4), r("smooth_lon", 4))


_SPLITS = """splits AS (SELECT segment_id, CASE WHEN rn <= round_even(0.7 * n, 0) THEN 'train' WHEN rn <= round_even(0.7 * n, 0) + round_even(0.15 * n, 0) THEN 'val' ELSE 'test' END AS split
 FROM seg JOIN (SELECT icao24, row_number() OVER (ORDER BY md5('42|' || icao24), icao24) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT icao24 FROM seg)) USING (icao24))"""
_WAY = f"""{_smoothed_sql(DEFAULT)}, {_SPLITS}, base AS ({_BASE}),
waypoints AS (SELECT split, p.segment_id, p.event_id, {_hav('p.latitude', 'p.longitude', 'smooth_lat', 'smooth_lon')} / 1000 AS kalman_km, {_hav('p.latitude', 'p.longitude', 'base_lat', 'base_lon')} / 1000 AS baseline_km FROM placed p JOIN splits USING (segment_id) JOIN base b ON b.event_id = p.event_id AND b.segment_id = p.segment_id)
"""


def _splits(spark, d):
    seg = _seg(spark, d)
    return seg.join(N.split_of_keys(seg, "icao24"), "icao24").select("segment_id", "split")


def _waypoints(spark, d, params, rows=None):
    """Errors of the smoother and of the great circle at each report, with the split of its aircraft."""
    ends, truth = _anc(spark, d), _pts(spark, d)
    own = Z.errors(Z.positions(Z.smooth_gaps(_gap_rows(spark, d) if rows is None else rows, [params]), ends), truth)
    base = K.baseline(truth, ends).select("segment_id", "event_id", (F.col("error_m") / 1000).alias("baseline_km"))
    return own.select("segment_id", "event_id", F.col("km").alias("kalman_km")).join(base, ["segment_id", "event_id"]).join(_splits(spark, d), "segment_id")


_MEANS = [f"{w}_{n}_error_km" for w in ("kalman", "baseline") for n in ("mean", "median")]
_BETTER = [f"improvement_{n}_pct" for n in ("mean", "median")]
_BY_FLIGHT = "SELECT split, segment_id, count(*) AS n_waypoints, avg(kalman_km) AS kalman_mean_error_km, median(kalman_km) AS kalman_median_error_km, avg(baseline_km) AS baseline_mean_error_km, median(baseline_km) AS baseline_median_error_km FROM waypoints GROUP BY ALL"
_PCT = ", ".join(f"round((1 - kalman_{n}_error_km / greatest(baseline_{n}_error_km, 1e-9)) * 100, 4) AS improvement_{n}_pct" for n in ("mean", "median"))


@query(f"{_WAY} SELECT split, segment_id, n_waypoints, {', '.join(f'round({c}, 4) AS {c}' for c in _MEANS)}, {_PCT} FROM ({_BY_FLIGHT}) WHERE split = 'test'", cte=False)
def kalman_eval(spark, d):
    """Errors of each flight of the test split beside those of the great circle."""
    m = Z.compare_with_base(_waypoints(spark, d, DEFAULT).where("split = 'test'"), ["split", "segment_id"])
    return m.select("split", "segment_id", "n_waypoints", *[r(c, 4) for c in (*_MEANS, *_BETTER)])


@query(f"""{_WAY} SELECT split, n_flights, {', '.join(f'round({c}, 4) AS {c}' for c in _MEANS)}, round(kp, 4) AS kalman_p90_error_km, round(bp, 4) AS baseline_p90_error_km, {_PCT} FROM
 (SELECT split, count(*) AS n_flights, avg(k) AS kalman_mean_error_km, median(k) AS kalman_median_error_km, avg(b) AS baseline_mean_error_km, median(b) AS baseline_median_error_km FROM (SELECT split, segment_id, avg(kalman_km) AS k, avg(baseline_km) AS b FROM waypoints GROUP BY ALL) GROUP BY split)
 JOIN (SELECT split, quantile_cont(kalman_km, 0.9) AS kp, quantile_cont(baseline_km, 0.9) AS bp FROM waypoints GROUP BY split) USING (split)""", cte=False)
def kalman_summary(spark, d):
    """Errors by split: means over flights, the 90th percentile over waypoints, improvements."""
    s = Z.summarize_split(_waypoints(spark, d, DEFAULT))
    return s.select("split", "n_flights", *[r(c, 4) for c in (*_MEANS, "kalman_p90_error_km", "baseline_p90_error_km", *_BETTER)])


@query()
def kalman_tune(spark, d):
    """The compact grid by its errors on the validation split, best parameters first."""
    return Z.tuning(_gap_rows(spark, d), _anc(spark, d), _pts(spark, d), _splits(spark, d), Z.parameter_grid("compact")).select("param_id", "measurement_std_m", "accel_along", "accel_cross", r("mean_km", 3), r("median_km", 3), "flights")


@query()
def kalman_run(spark, d):
    """Tuned on the validation split, then judged on it and on the test split; no rows, where nothing can be tuned on."""
    rows, grid = stage(_gap_rows(spark, d)), Z.parameter_grid("compact")
    first = Z.tuning(rows, _anc(spark, d), _pts(spark, d), _splits(spark, d), grid).first()
    best = grid[first["param_id"] if first else 0]
    s = Z.summarize_split(_waypoints(spark, d, best, rows).where("split IN ('val', 'test')").where(F.lit(first is not None)))
    names = ("measurement_std_m", "accel_along", "accel_cross")
    return s.select("split", "n_flights", *[r(c, 4) for c in (*_MEANS, "kalman_p90_error_km", "baseline_p90_error_km", *_BETTER)], *[F.lit(v).alias(n) for n, v in zip(names, best)])


@query(_smoothed_sql(DEFAULT, 10**9, 10**9) + f"SELECT segment_id, event_id, round({_hav('latitude', 'longitude', 'smooth_lat', 'smooth_lon')} / 1000, 4) AS km FROM placed", cte=False)
def kalman_native(spark, d):
    """Errors of each report with all dense reports as they are for context, on demand and for any flight."""
    ends, truth = _anc(spark, d), _pts(spark, d)
    rows = Z.gap_rows(Z.context_measurements(points(spark, d, "adsb"), ends, CONTEXT, None, None), truth, ends)
    return Z.errors(Z.positions(Z.smooth_gaps(rows, [DEFAULT]), ends), truth).select("segment_id", "event_id", r("km", 4))


_LATE = 4 * HOUR


@query(_smoothed_sql(DEFAULT) + f"SELECT segment_id, event_id, round(along_m, 2) AS along_m, round(cross_m, 2) AS cross_m FROM smooth JOIN anc USING (segment_id) WHERE t1 + {CONTEXT} < (SELECT max(t) // 1000 * 1000 FROM line) - {_LATE}", cte=False)
def stream_kalman(spark, d):
    """The smoother as a stream in two runs: forward as reports come, back when a gap closes."""
    out, ends = shared_folder(spark), _anc(spark, d)
    rows = _gap_rows(spark, d).join(ends.select("segment_id", (F.col("t1") + CONTEXT).alias("until")), "segment_id").withColumn("time", F.timestamp_micros("t"))
    rows = stage(rows)
    last = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    middle = ((last.a or 0) + (last.b or 0)) // 2
    for run in (F.col("t") < middle, F.col("t") >= middle):
        rows.where(run).write.mode("append").parquet(f"{out}/rows")
        got = stream_smoothed(spark.readStream.schema(rows.schema).parquet(f"{out}/rows"), DEFAULT, f"{out}/places", f"{out}/state")
    return got.select("segment_id", "event_id", r("along_m", 2), r("cross_m", 2))
