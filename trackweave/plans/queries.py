"""Registered queries over the track operators, each with the SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import numbering as N
from ..operators import segments as S
from ..operators import tracks as K
from ..operators.ranges import points_within
from ..sources.reports import PROJECTION, flights, points

HOUR = 3_600_000_000
GAP, CONTEXT = 24 * HOUR, 36 * HOUR
BOX = (52.0, 58.0, -50.0, -10.0)
KEY = ["icao24", "seq"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_CTE = f"""WITH proj AS (SELECT *, epoch_us(ts) AS t FROM ({PROJECTION.format(events="events")})),
adsc AS (SELECT * FROM proj WHERE kind = 'adsc'), adsb AS (SELECT * FROM proj WHERE kind = 'adsb'),
flights AS (SELECT icao24, event_id AS flight_id, t - {20 * HOUR} AS f0, t + {20 * HOUR} AS f1 FROM proj WHERE kind = 'flight'),
flag AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY icao24 ORDER BY t, event_id) > {GAP} THEN 1 ELSE 0 END AS nw FROM adsc),
sess AS (SELECT * EXCLUDE (nw), CAST(sum(nw) OVER (PARTITION BY icao24 ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq FROM flag),
seg AS (SELECT strftime(min(ts), '%Y%m%d') || '_' || icao24 || '_' || strftime(min(ts), '%H%M%S') || '_' || strftime(max(ts), '%H%M%S') AS segment_id,
 icao24, seq, min(t) AS s0, max(t) AS s1, count(*) AS n_points, (max(t) - min(t)) / 60e6 AS gap_minutes,
 arg_min(latitude, t) AS lat0, arg_min(longitude, t) AS lon0, arg_max(latitude, t) AS lat1, arg_max(longitude, t) AS lon1
 FROM sess GROUP BY icao24, seq HAVING count(*) >= 2 AND max(t) > min(t)),
pts AS (SELECT s.* FROM sess s SEMI JOIN seg USING (icao24, seq)),
screen AS (SELECT s.segment_id, s.icao24, s.seq, count(*) FILTER (WHERE a.t < s.s0) AS n_before, count(*) FILTER (WHERE a.t >= s.s0 AND a.t <= s.s1) AS n_during,
 count(*) FILTER (WHERE a.t > s.s1) AS n_after, max(a.t) FILTER (WHERE a.t < s.s0) AS t_before, min(a.t) FILTER (WHERE a.t > s.s1) AS t_after
 FROM seg s LEFT JOIN adsb a ON a.icao24 = s.icao24 AND a.t >= s.s0 - {CONTEXT} AND a.t < s.s1 + {CONTEXT} GROUP BY ALL),
anc AS (SELECT s.segment_id, s.icao24, s.seq, arg_max(a.t, a.t) FILTER (WHERE a.t < s.s0) AS t0, arg_max(a.latitude, a.t) FILTER (WHERE a.t < s.s0) AS lat0, arg_max(a.longitude, a.t) FILTER (WHERE a.t < s.s0) AS lon0,
 arg_min(a.t, a.t) FILTER (WHERE a.t > s.s1) AS t1, arg_min(a.latitude, a.t) FILTER (WHERE a.t > s.s1) AS lat1, arg_min(a.longitude, a.t) FILTER (WHERE a.t > s.s1) AS lon1
 FROM seg s JOIN adsb a ON a.icao24 = s.icao24 AND a.t >= s.s0 - {CONTEXT} AND a.t < s.s1 + {CONTEXT} GROUP BY ALL HAVING t0 IS NOT NULL AND t1 IS NOT NULL)
"""


def _hav(a: str, b: str, c: str, d: str, r: str = "6371000.0") -> str:
    return f"2 * {r} * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"


def _brg(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})))) + 360"
    return f"(({x}) - 360.0 * floor(({x}) / 360.0))"


def _gc(tau: str, p: str = "") -> tuple[str, str]:
    a, b, c, d = (f"radians({p}{x})" for x in ("lat0", "lon0", "lat1", "lon1"))
    w = f"acos(least(1.0, greatest(-1.0, cos({a}) * cos({b}) * cos({c}) * cos({d}) + cos({a}) * sin({b}) * cos({c}) * sin({d}) + sin({a}) * sin({c}))))"
    ka, kb = f"sin((1 - {tau}) * {w})", f"sin({tau} * {w})"
    x, y, z = f"({ka} * cos({a}) * cos({b}) + {kb} * cos({c}) * cos({d}))", f"({ka} * cos({a}) * sin({b}) + {kb} * cos({c}) * sin({d}))", f"({ka} * sin({a}) + {kb} * sin({c}))"
    return f"CASE WHEN {w} <= 1e-12 THEN {p}lat0 ELSE degrees(atan2({z}, sqrt({x} * {x} + {y} * {y}))) END", f"CASE WHEN {w} <= 1e-12 THEN {p}lon0 ELSE degrees(atan2({y}, {x})) END"


def query(sql: str | None = None, cte: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (_CTE if cte else "") + sql
        return f

    return register


def _sess(spark, d):
    return S.sessionize(points(spark, d, "adsc"), GAP)


def _seg(spark, d):
    return S.build_segments(_sess(spark, d))


def _pts(spark, d):
    return _sess(spark, d).join(_seg(spark, d).select(*KEY), KEY, "left_semi")


def _screen(spark, d):
    return S.range_screen(_seg(spark, d), points(spark, d, "adsb"), CONTEXT)


def _anc(spark, d):
    return K.anchors(points(spark, d, "adsb"), _seg(spark, d), CONTEXT)


def r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# sessions, segments, screening


@query("SELECT event_id, icao24, seq FROM sess")
def sessionize(spark, d):
    return _sess(spark, d).select("event_id", "icao24", "seq")


@query("SELECT segment_id, icao24, seq, s0, s1, n_points, s1 - s0 AS gap_us FROM seg")
def build_segments(spark, d):
    return _seg(spark, d).select("segment_id", "icao24", "seq", "s0", "s1", "n_points", (F.col("s1") - F.col("s0")).alias("gap_us"))


@query("SELECT event_id, icao24, seq, t FROM pts")
def points_with_segment(spark, d):
    return _pts(spark, d).select("event_id", "icao24", "seq", "t")


@query("SELECT * FROM screen")
def range_join_screen(spark, d):
    return _screen(spark, d)


@query("SELECT segment_id, n_before, n_after FROM screen WHERE n_before > 0 AND n_during = 0")
def screen_survivors(spark, d):
    return _screen(spark, d).where("n_before > 0 AND n_during = 0").select("segment_id", "n_before", "n_after")


@query("SELECT count(*) FILTER (WHERE n_before = 0) AS before_missing, count(*) FILTER (WHERE n_during > 0) AS during_present, count(*) FILTER (WHERE n_after = 0) AS after_missing, count(*) FILTER (WHERE n_before = 0 AND n_after = 0) AS both_missing FROM screen")
def screen_breakdown(spark, d):
    b, u, a = F.col("n_before") == 0, F.col("n_during") > 0, F.col("n_after") == 0
    return _screen(spark, d).agg(F.count_if(b).alias("before_missing"), F.count_if(u).alias("during_present"), F.count_if(a).alias("after_missing"), F.count_if(b & a).alias("both_missing"))


@query("SELECT s.segment_id, f.flight_id FROM seg s JOIN flights f ON f.icao24 = s.icao24 AND f.f0 < s.s1 AND f.f1 > s.s0")
def overlap_join(spark, d):
    return S.overlapping(_seg(spark, d), flights(spark, d)).select("segment_id", "flight_id")


@query("SELECT s.segment_id FROM seg s JOIN flights f ON f.icao24 = s.icao24 AND f.f0 < s.s1 AND f.f1 > s.s0 GROUP BY s.segment_id, s.icao24, s.seq HAVING count(*) = 1")
def exactly_one_flight(spark, d):
    return S.exactly_one(_seg(spark, d), flights(spark, d)).select("segment_id")


@query(f"SELECT segment_id FROM seg s WHERE gap_minutes >= 600 AND {_hav('lat0', 'lon0', 'lat1', 'lon1')} >= 100000 AND EXISTS (SELECT 1 FROM sess p WHERE p.icao24 = s.icao24 AND p.seq = s.seq AND p.latitude BETWEEN {BOX[0]} AND {BOX[1]} AND p.longitude BETWEEN {BOX[2]} AND {BOX[3]})")
def prefilter_segments(spark, d):
    return S.prefilter(_seg(spark, d), _sess(spark, d), 600, 100_000, BOX).select("segment_id")


_PAIR = "lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo, lag(t) OVER w AS pt FROM pts WINDOW w AS (PARTITION BY icao24, seq ORDER BY t, event_id)"
_SPEED = f"SELECT *, {_hav('pla', 'plo', 'latitude', 'longitude')} AS step_m, CASE WHEN t > pt THEN {_hav('pla', 'plo', 'latitude', 'longitude')} / 1000 * 0.539956803 / ((t - pt) / 1e6 / 3600) END AS kt FROM (SELECT *, {_PAIR})"


@query(f"SELECT icao24, seq, round(max(kt), 6) AS max_kt, round(median(kt), 6) AS median_kt FROM ({_SPEED}) GROUP BY icao24, seq")
def segment_speed_profile(spark, d):
    return S.speeds(_pts(spark, d), KEY).groupBy(*KEY).agg(F.round(F.max("speed_kt"), 6).alias("max_kt"), F.round(F.median("speed_kt"), 6).alias("median_kt"))


@query(f"SELECT icao24, seq, round(sum(step_m), 3) AS length_m, count(*) AS n FROM ({_SPEED}) GROUP BY icao24, seq")
def track_length(spark, d):
    return S.speeds(_pts(spark, d), KEY).groupBy(*KEY).agg(F.round(F.sum("step_m"), 3).alias("length_m"), F.count("*").alias("n"))


@query(f"""SELECT segment_id, s.icao24, s.seq, concat_ws(';', CASE WHEN n_during > 0 THEN 'adsb_present_during_gap' END, CASE WHEN mk IS NULL THEN 'insufficient_adsc_points' END, CASE WHEN mk > 700 THEN 'internal_adsc_speed_unreasonable' END, CASE WHEN n_after = 0 THEN 'missing_adsb_after' END,
 CASE WHEN n_before = 0 THEN 'missing_adsb_before' END, CASE WHEN nf > 1 THEN 'multiple_overlapping_flights' END, CASE WHEN coalesce(nf, 0) = 0 THEN 'no_overlapping_flight' END) AS reasons,
 n_before > 0 AND n_during = 0 AND n_after > 0 AND coalesce(nf, 0) = 1 AND coalesce(mk <= 700, false) AS is_valid
 FROM screen s LEFT JOIN (SELECT s.icao24, s.seq, count(*) AS nf FROM seg s JOIN flights f ON f.icao24 = s.icao24 AND f.f0 < s.s1 AND f.f1 > s.s0 GROUP BY ALL) f ON f.icao24 = s.icao24 AND f.seq = s.seq
 LEFT JOIN (SELECT icao24, seq, max(kt) AS mk FROM ({_SPEED}) GROUP BY ALL) m ON m.icao24 = s.icao24 AND m.seq = s.seq""")
def validate_candidates(spark, d):
    n = S.overlapping(_seg(spark, d), flights(spark, d)).groupBy(*KEY).agg(F.count("*").alias("n_flights"))
    profile = S.speeds(_pts(spark, d), KEY).groupBy(*KEY).agg(F.max("speed_kt").alias("max_kt"))
    return S.validate(_screen(spark, d), n, profile, 700)


@query(f"SELECT icao24, min(w0) AS w0, max(w1) AS w1 FROM (SELECT *, sum(n) OVER (PARTITION BY icao24 ORDER BY w0, w1 ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN w0 <= max(w1) OVER (PARTITION BY icao24 ORDER BY w0, w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM (SELECT icao24, s0 - {CONTEXT} AS w0, s1 + {CONTEXT} AS w1 FROM seg))) GROUP BY icao24, g")
def merge_windows(spark, d):
    return S.merge_windows(_seg(spark, d).select("icao24", (F.col("s0") - CONTEXT).alias("w0"), (F.col("s1") + CONTEXT).alias("w1")))


@query(f"SELECT segment_id, unnest(generate_series(s0 // {24 * HOUR}, s1 // {24 * HOUR})) AS day_nr FROM seg")
def partition_days(spark, d):
    return _seg(spark, d).select("segment_id", F.explode(F.sequence(F.floor(F.col("s0") / (24 * HOUR)), F.floor(F.col("s1") / (24 * HOUR)))).alias("day_nr"))


@query(f"SELECT a.event_id, s.segment_id, CASE WHEN a.t < s.s0 THEN 'before' WHEN a.t <= s.s1 THEN 'during' ELSE 'after' END AS phase FROM seg s JOIN adsb a ON a.icao24 = s.icao24 AND a.t >= s.s0 - {CONTEXT} AND a.t < s.s1 + {CONTEXT}")
def phase_partition(spark, d):
    j = points_within(_seg(spark, d), points(spark, d, "adsb"), F.col("s0") - CONTEXT, F.col("s1") + CONTEXT, ["event_id", "t"])
    return j.select("event_id", "segment_id", F.when(F.col("t") < F.col("s0"), "before").when(F.col("t") <= F.col("s1"), "during").otherwise("after").alias("phase"))


@query("SELECT segment_id, n_points, s1 - s0 AS gap_us FROM seg ORDER BY n_points DESC, gap_minutes, segment_id LIMIT 50")
def topn_candidates(spark, d):
    return _seg(spark, d).orderBy(F.desc("n_points"), "gap_minutes", "segment_id").limit(50).select("segment_id", "n_points", (F.col("s1") - F.col("s0")).alias("gap_us"))


@query("SELECT CAST(floor(gap_minutes / 600) AS BIGINT) AS bin, count(*) AS n FROM seg GROUP BY ALL")
def histogram_gap(spark, d):
    return _seg(spark, d).groupBy(F.floor(F.col("gap_minutes") / 600).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT substr(segment_id, 1, 6) AS month, count(*) AS n, count(DISTINCT icao24) AS aircraft, round(avg(gap_minutes), 6) AS mean_gap, round(median(gap_minutes), 6) AS median_gap, round(count(*) / max(count(*)) OVER (), 6) AS proxy FROM seg GROUP BY 1")
def monthly_stats(spark, d):
    m = _seg(spark, d).groupBy(F.substring("segment_id", 1, 6).alias("month")).agg(F.count("*").alias("n"), F.countDistinct("icao24").alias("aircraft"), F.round(F.avg("gap_minutes"), 6).alias("mean_gap"), F.round(F.median("gap_minutes"), 6).alias("median_gap"))
    return m.crossJoin(F.broadcast(m.agg(F.max("n").alias("most")))).withColumn("proxy", F.round(F.col("n") / F.col("most"), 6)).drop("most")  # one row


@query("""SELECT icao24, CASE WHEN rn <= round_even(0.7 * n, 0) THEN 'train' WHEN rn <= round_even(0.7 * n, 0) + round_even(0.15 * n, 0) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT icao24, row_number() OVER (ORDER BY md5('42|' || icao24), icao24) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT icao24 FROM seg))""")
def split_by_aircraft(spark, d):
    """Every aircraft in one split, in an order by digest; places are counted in parts."""
    return N.split_of_keys(_seg(spark, d), "icao24")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY md5('7|' || event_id), event_id) AS BIGINT) AS place, CAST(count(*) OVER () AS BIGINT) AS total FROM events", cte=False)
def event_permutation(spark, d):
    """All events in a seeded order."""
    return N.permuted(spark.read.parquet(f"{d}/events.parquet").select("event_id"), F.col("event_id").cast("string"), 7)


@query("SELECT segment_id, n_points FROM seg ORDER BY md5('11|' || segment_id), segment_id LIMIT 250")
def segment_sample(spark, d):
    """Exactly as many segments as asked for, the same for every layout."""
    return N.sampled(_seg(spark, d).select("segment_id", "n_points"), F.col("segment_id"), 250, 11)


# reconstruction


@query("SELECT segment_id, icao24, seq, t0, t1, lat0, lon0, lat1, lon1 FROM anc")
def gap_anchors(spark, d):
    return _anc(spark, d).select("segment_id", "icao24", "seq", "t0", "t1", "lat0", "lon0", "lat1", "lon1")


_TAU = "least(1.0, greatest(0.0, (p.t - a.t0) / (a.t1 - a.t0)))"
_BASE = f"SELECT p.event_id, a.segment_id, p.latitude, p.longitude, {_TAU} AS tau, {_gc(_TAU, 'a.')[0]} AS base_lat, {_gc(_TAU, 'a.')[1]} AS base_lon FROM pts p JOIN anc a ON a.icao24 = p.icao24 AND a.seq = p.seq"
_ERR = f"SELECT *, {_hav('latitude', 'longitude', 'base_lat', 'base_lon')} AS error_m FROM ({_BASE})"


@query(f"SELECT event_id, segment_id, round(tau, 6) AS tau, round(base_lat, 6) AS base_lat, round(base_lon, 6) AS base_lon, round(error_m, 3) AS error_m FROM ({_ERR})")
def baseline_prediction(spark, d):
    return K.baseline(_pts(spark, d), _anc(spark, d)).select("event_id", "segment_id", r("tau"), r("base_lat"), r("base_lon"), r("error_m", 3))


def _metrics(spark, d):
    e = K.baseline(_pts(spark, d), _anc(spark, d)).groupBy("segment_id")
    return e.agg(F.avg("error_m").alias("mean_m"), F.median("error_m").alias("median_m"), F.sqrt(F.avg(F.pow("error_m", F.lit(2)))).alias("rmse_m"), F.max("error_m").alias("max_m"), F.percentile("error_m", F.lit(0.9)).alias("p90_m"))


_MET = f"SELECT segment_id, avg(error_m) AS mean_m, median(error_m) AS median_m, sqrt(avg(pow(error_m, 2))) AS rmse_m, max(error_m) AS max_m, quantile_cont(error_m, 0.9) AS p90_m FROM ({_ERR}) GROUP BY segment_id"


@query("SELECT segment_id, " + ", ".join(f"round({c}, 3) AS {c}" for c in ("mean_m", "median_m", "rmse_m", "max_m", "p90_m")) + f" FROM ({_MET})")
def baseline_metrics(spark, d):
    return _metrics(spark, d).select("segment_id", *[r(c, 3) for c in ("mean_m", "median_m", "rmse_m", "max_m", "p90_m")])


@query(f"SELECT count(*) AS n, round(avg(mean_m), 3) AS mean_of_means, round(median(mean_m), 3) AS median_of_means, round(avg(rmse_m), 3) AS mean_rmse FROM ({_MET})")
def baseline_summary(spark, d):
    return _metrics(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("mean_m"), 3).alias("mean_of_means"), F.round(F.median("mean_m"), 3).alias("median_of_means"), F.round(F.avg("rmse_m"), 3).alias("mean_rmse"))


_DN = f"greatest(2, (t1 - t0) // {HOUR} + 1)"


@query(f"SELECT segment_id, i, round({_gc('(i / (n - 1))')[0]}, 6) AS latitude, round({_gc('(i / (n - 1))')[1]}, 6) AS longitude FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT *, {_DN} AS n FROM anc))")
def dense_track(spark, d):
    return K.dense_track(_anc(spark, d), HOUR).select("segment_id", "i", r("latitude"), r("longitude"))


_MIN = 60_000_000


def _grid(exact: bool) -> str:
    a, b = (f"t // {HOUR} * {HOUR}", f"-(-max(t) // {HOUR}) * {HOUR}") if exact else ("t", "max(t)")
    ends = f"(SELECT icao24, seq, (min(t) // {HOUR}) * {HOUR} AS a, ((max(t) + {HOUR} - 1) // {HOUR}) * {HOUR} AS b FROM h GROUP BY ALL)" if exact else "(SELECT icao24, seq, min(t) AS a, max(t) AS b FROM h GROUP BY ALL)"
    src = f"(SELECT icao24, seq, (t // {HOUR}) * {HOUR} + CASE WHEN event_id % 3 = 0 THEN 0 ELSE t % {HOUR} END AS t, max(altitude_m) AS altitude_m FROM pts GROUP BY ALL)"
    join = "LEFT" if exact else "FULL"
    return f""", h AS {src}, g AS (SELECT icao24, seq, unnest(generate_series(a, b, {HOUR})) AS t, true AS is_on FROM {ends}),
 j AS (SELECT coalesce(g.icao24, h.icao24) AS icao24, coalesce(g.seq, h.seq) AS seq, coalesce(g.t, h.t) AS t, g.is_on, h.altitude_m AS v FROM g {join} JOIN h ON h.icao24 = g.icao24 AND h.seq = g.seq AND h.t = g.t),
 k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt, last_value(v IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER n AS nt, first_value(v IGNORE NULLS) OVER n AS nv FROM j
  WINDOW p AS (PARTITION BY icao24, seq ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY icao24, seq ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT icao24, seq, t, round(CASE WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END, 6) AS altitude_m FROM k WHERE is_on"""


def _hourly(spark, d):
    t = F.col("t") - F.when(F.col("event_id") % 3 == 0, F.col("t") % HOUR).otherwise(0)
    return _pts(spark, d).withColumn("t", t).groupBy(*KEY, "t").agg(F.max("altitude_m").alias("altitude_m"))


@query(_grid(True))
def resample_exact_grid(spark, d):
    return K.resample(_hourly(spark, d), KEY, ["altitude_m"], HOUR, True).select(*KEY, "t", r("altitude_m"))


@query(_grid(False))
def resample_union(spark, d):
    return K.resample(_hourly(spark, d), KEY, ["altitude_m"], HOUR, False).select(*KEY, "t", r("altitude_m"))


@query("SELECT icao24, seq, event_id, round((latitude - 53) / 8, 6) AS z_lat, round((longitude + 30) / 25, 6) AS z_lon, round((velocity_mps - 240) / 30, 6) AS z_vel, round(sin(radians(heading_deg)), 6) AS hsin, round(cos(radians(heading_deg)), 6) AS hcos FROM pts")
def zscore_features(spark, d):
    z = lambda c, m, s, n: F.round((F.col(c) - m) / s, 6).alias(n)
    return _pts(spark, d).select("icao24", "seq", "event_id", z("latitude", 53, 8, "z_lat"), z("longitude", -30, 25, "z_lon"), z("velocity_mps", 240, 30, "z_vel"), F.round(F.sin(F.radians("heading_deg")), 6).alias("hsin"), F.round(F.cos(F.radians("heading_deg")), 6).alias("hcos"))


_NEXT = "SELECT *, lead(latitude) OVER w AS la, lead(longitude) OVER w AS lo FROM pts WINDOW w AS (PARTITION BY icao24, seq ORDER BY t, event_id)"


def _next(spark, d):
    w = Window.partitionBy(*KEY).orderBy("t", "event_id")
    return _pts(spark, d).withColumn("la", F.lead("latitude").over(w)).withColumn("lo", F.lead("longitude").over(w)).where("la IS NOT NULL")


@query(f"SELECT event_id, round({_hav('latitude', 'longitude', 'la', 'lo')}, 3) AS metres, round({_brg('latitude', 'longitude', 'la', 'lo')}, 6) AS bearing FROM ({_NEXT}) WHERE la IS NOT NULL")
def haversine_bearing(spark, d):
    c = [F.col(x) for x in ("latitude", "longitude", "la", "lo")]
    return _next(spark, d).select("event_id", F.round(geo.haversine_m(*c), 3).alias("metres"), F.round(geo.bearing_deg(*c), 6).alias("bearing"))


@query("SELECT event_id, round((longitude * 7 + 180) - 360 * floor((longitude * 7 + 180) / 360) - 180, 6) AS lon FROM pts")
def wrap_lon(spark, d):
    return _pts(spark, d).select("event_id", F.round(geo.wrap_lon(F.col("longitude") * 7), 6).alias("lon"))


@query("SELECT event_id, round((la - latitude) * 111320, 3) AS north_m, round((lo - longitude) * 111320 * cos(radians(latitude)), 3) AS east_m FROM (" + _NEXT + ") WHERE la IS NOT NULL")
def local_residual(spark, d):
    return _next(spark, d).select("event_id", F.round((F.col("la") - F.col("latitude")) * 111320, 3).alias("north_m"), F.round((F.col("lo") - F.col("longitude")) * 111320 * F.cos(F.radians("latitude")), 3).alias("east_m"))


@query(f"""SELECT event_id, round(atan2(sin(dd) * cos(turn), cos(dd)) * 6371000.0, 3) AS along_m, round(asin(least(1.0, greatest(-1.0, sin(dd) * sin(turn)))) * 6371000.0, 3) AS cross_m FROM (
 SELECT p.event_id, {_hav('a.lat0', 'a.lon0', 'p.latitude', 'p.longitude')} / 6371000.0 AS dd, radians({_brg('a.lat0', 'a.lon0', 'p.latitude', 'p.longitude')}) - radians({_brg('a.lat0', 'a.lon0', 'a.lat1', 'a.lon1')}) AS turn FROM pts p JOIN anc a ON a.icao24 = p.icao24 AND a.seq = p.seq)""")
def along_cross(spark, d):
    j = _pts(spark, d).join(_anc(spark, d), KEY)
    a, c = geo.along_cross_m(*map(F.col, ("lat0", "lon0", "lat1", "lon1", "latitude", "longitude")))
    return j.select("event_id", F.round(a, 3).alias("along_m"), F.round(c, 3).alias("cross_m"))


_EFF = "CASE WHEN ft <= 0 THEN 1.0 WHEN ft < 37000 THEN 1 + 8 * pow((37000 - ft) / 37000, 2) ELSE 1 + 3 * (ft - 37000) / 40000 END"


@query(f"SELECT segment_id, round(km, 3) AS km, round(km * 6.0784 * least(1.20, greatest(0.85, {_EFF})), 2) AS fuel_kg, round(km * 19.2077 * least(1.20, greatest(0.85, {_EFF})), 2) AS co2_kg FROM (SELECT segment_id, {_hav('lat0', 'lon0', 'lat1', 'lon1')} / 1000 AS km, 30000.0 + (seq % 9) * 1500 AS ft FROM anc)")
def emissions(spark, d):
    a = _anc(spark, d).select("segment_id", (geo.haversine_m(*map(F.col, ("lat0", "lon0", "lat1", "lon1"))) / 1000).alias("km"), (30000.0 + (F.col("seq") % 9) * 1500).alias("ft"))
    eff = F.when(F.col("ft") <= 0, 1.0).when(F.col("ft") < 37000, 1 + 8 * F.pow((37000 - F.col("ft")) / 37000, F.lit(2))).otherwise(1 + 3 * (F.col("ft") - 37000) / 40000)
    f = F.least(F.lit(1.20), F.greatest(F.lit(0.85), eff))
    return a.select("segment_id", r("km", 3), F.round(F.col("km") * 6.0784 * f, 2).alias("fuel_kg"), F.round(F.col("km") * 19.2077 * f, 2).alias("co2_kg"))


# cleaning, deduplication, catalogues

_DUP = "(SELECT *, 0 AS copy FROM adsc UNION ALL SELECT *, 1 AS copy FROM adsc WHERE event_id % 10 = 0)"


def _dup(spark, d):
    a = points(spark, d, "adsc")
    return a.withColumn("copy", F.lit(0)).unionByName(a.where("event_id % 10 = 0").withColumn("copy", F.lit(1)))


@query(f"SELECT event_id, copy FROM (SELECT event_id, copy, row_number() OVER (PARTITION BY icao24, t ORDER BY copy DESC, event_id) AS rn FROM {_DUP}) WHERE rn = 1")
def dedup_keep_best(spark, d):
    return K.keep_first(_dup(spark, d).withColumn("rank", -F.col("copy")), ["icao24", "t"], ["rank", "event_id"]).select("event_id", "copy")


@query(f"SELECT event_id, copy, rn, n FROM (SELECT event_id, copy, row_number() OVER (PARTITION BY icao24, t ORDER BY copy, event_id) AS rn, count(*) OVER (PARTITION BY icao24, t) AS n FROM {_DUP}) WHERE n > 1")
def dedup_duplicates(spark, d):
    w = Window.partitionBy("icao24", "t")
    return _dup(spark, d).select("event_id", "copy", F.row_number().over(w.orderBy("copy", "event_id")).alias("rn"), F.count("*").over(w).alias("n")).where("n > 1")


@query(f"SELECT icao24, count(*) - count(DISTINCT event_id) AS duplicates, count(*) AS n FROM {_DUP} GROUP BY icao24")
def duplicate_audit(spark, d):
    return _dup(spark, d).groupBy("icao24").agg((F.count("*") - F.countDistinct("event_id")).alias("duplicates"), F.count("*").alias("n"))


@query(f"SELECT event_id, icao24 FROM {_DUP} WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND latitude < 57 QUALIFY row_number() OVER (PARTITION BY icao24, t ORDER BY event_id) = 1")
def clean_section(spark, d):
    return K.clean(_dup(spark, d).where("latitude < 57"), ["icao24"]).select("event_id", "icao24")


@query("SELECT event_id, icao24 FROM adsb QUALIFY t >= max(t) OVER (PARTITION BY icao24) - 86400000000")
def boundary_window(spark, d):
    return points(spark, d, "adsb").withColumn("m", F.max("t").over(Window.partitionBy("icao24"))).where("t >= m - 86400000000").select("event_id", "icao24")


@query()
def remove_spikes(spark, d):
    return K.drop_spikes(points(spark, d, "adsc"), ["icao24"], 30).select("event_id", "icao24")


@query()
def kalman_smooth(spark, d):
    return K.kalman_smooth(_pts(spark, d), KEY).select("event_id", r("smooth_lat", 4), r("smooth_lon", 4))


@query("SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS train, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS val, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS test FROM orders GROUP BY 1", cte=False)
def split_pivot(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("split"))
    return o.groupBy("status").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query("SELECT l_shipdate, month_n, CASE WHEN month_n * 10 < 3 * avg(month_n) OVER () THEN 'LOW_COVERAGE' ELSE 'OK' END AS alert FROM (SELECT date_trunc('month', l_shipdate)::DATE AS l_shipdate, count(*) AS month_n FROM lineitem GROUP BY 1)", cte=False)
def alerts_low_coverage(spark, d):
    m = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.trunc("l_shipdate", "month").alias("l_shipdate")).agg(F.count("*").alias("month_n"))
    mean = m.agg(F.avg("month_n").alias("mean"))
    return m.crossJoin(F.broadcast(mean)).select("l_shipdate", "month_n", F.when(F.col("month_n") * 10 < 3 * F.col("mean"), "LOW_COVERAGE").otherwise("OK").alias("alert"))  # one row


@query("SELECT l_orderkey, l_linenumber, side, speed FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem) ON discount, tax INTO NAME side VALUE speed) WHERE speed > 0.05", cte=False)
def boundary_unpivot(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"))
    return x.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "side", "speed").where("speed > 0.05")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", cte=False)
def audit_antijoin(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").join(spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
