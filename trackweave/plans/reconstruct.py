"""Queries over scans, reconstructed gaps, their errors and what a service or a monitor shows of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import monitor as M
from ..operators import segments as S
from ..operators import recurrent as N
from ..operators import smoother as Z
from ..operators import tracks as K
from ..operators.ranges import points_within
from ..sources import schema
from ..sources.reports import flights, points, reports
from .queries import _ERR, BOX, CONTEXT, HOUR, KEY, _anc, _brg, _gc, _hav, _pts, _seg, query, r

W0, W1 = 1_704_844_800_000_000, 1_705_276_800_000_000  # 10 to 15 January 2024
PAD = 4 * HOUR
_IN = f"latitude BETWEEN {BOX[0]} AND {BOX[1]} AND longitude BETWEEN {BOX[2]} AND {BOX[3]}"


def _gap_rows(spark, d):
    ends = _anc(spark, d)
    return Z.gap_rows(Z.context_measurements(points(spark, d, "adsb"), ends, CONTEXT), _pts(spark, d), ends)


def _base(spark, d):
    return K.baseline(_pts(spark, d), _anc(spark, d))


# scans


@query("SELECT event_id, ts AS time, user_id AS icao24, CAST(NULL AS DOUBLE) AS altitude_m FROM events", cte=False)
def resolve_schema(spark, d):
    wanted = {"event_id": ("long", ["id", "EVENT_ID"]), "time": ("timestamp_ntz", ["timestamp", "ts"]), "icao24": ("long", ["icao24", "user_id"]), "altitude_m": ("double", ["geoaltitude", "altitude"])}
    return schema.resolve(spark.read.parquet(f"{d}/events.parquet"), wanted, ["altitude_m"])


@query("SELECT event_id FROM (SELECT *, try_cast(CASE WHEN event_id % 7 = 0 THEN 'none' ELSE CAST(latitude AS VARCHAR) END AS DOUBLE) AS la FROM proj) WHERE la BETWEEN 52 AND 58 AND longitude BETWEEN -50 AND -10")
def bbox_filter(spark, d):
    la = F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("latitude").cast("string")).try_cast("double")
    return reports(spark, d).where(la.between(52, 58) & F.col("longitude").between(-50, -10)).select("event_id")


@query("SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS x FROM events", cte=False)
def coerce_numeric(spark, d):
    x = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("user_id").cast("string")).try_cast("double")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", x.alias("x"))


@query(f"SELECT event_id, icao24, t FROM adsc WHERE t >= {W0 - PAD} AND t < {W1 + PAD} AND {_IN}")
def scan_adsc_window(spark, d):
    stamp = lambda us: F.timestamp_micros(F.lit(us)).cast("timestamp_ntz")  # noqa: E731  a bound on the column as it is stored goes down to the scan
    p = points(spark, d, "adsc").where((F.col("ts") >= stamp(W0 - PAD)) & (F.col("ts") < stamp(W1 + PAD)))
    return p.where(F.col("latitude").between(*BOX[:2]) & F.col("longitude").between(*BOX[2:])).select("event_id", "icao24", "t")


@query(f"SELECT DISTINCT icao24, flight_id, f0, f1 FROM flights f WHERE f1 >= {W0} AND f0 < {W1} AND EXISTS (SELECT 1 FROM seg s WHERE s.icao24 = f.icao24)")
def scan_flights_overlap(spark, d):
    return flights(spark, d).where((F.col("f1") >= W0) & (F.col("f0") < W1)).join(_seg(spark, d).select("icao24").distinct(), "icao24", "left_semi").dropDuplicates()


@query(f"SELECT event_id FROM adsb a WHERE {_IN} AND EXISTS (SELECT 1 FROM seg s WHERE s.icao24 = a.icao24 AND a.t >= s.s0 - {CONTEXT} AND a.t < s.s1 + {CONTEXT})")
def scan_adsb_detail(spark, d):
    w = S.merge_windows(_seg(spark, d).select("icao24", (F.col("s0") - CONTEXT).alias("w0"), (F.col("s1") + CONTEXT).alias("w1")))
    dense = points(spark, d, "adsb").where(F.col("latitude").between(*BOX[:2]) & F.col("longitude").between(*BOX[2:]))
    return points_within(w, dense, F.col("w0"), F.col("w1"), ["event_id", "t"]).select("event_id")  # merged windows are disjoint


@query(f"SELECT s.segment_id, a.event_id, CASE WHEN a.t < s.s0 THEN 'before' WHEN a.t <= s.s1 THEN 'during' ELSE 'after' END AS phase FROM (SELECT * FROM seg ORDER BY segment_id LIMIT 1) s JOIN adsb a ON a.icao24 = s.icao24 AND a.t >= s.s0 - {CONTEXT} AND a.t < s.s1 + {CONTEXT}")
def probe_segment(spark, d):
    hit = points_within(_seg(spark, d).orderBy("segment_id").limit(1), points(spark, d, "adsb"), F.col("s0") - CONTEXT, F.col("s1") + CONTEXT, ["event_id", "t"])
    return hit.select("segment_id", "event_id", F.when(F.col("t") < F.col("s0"), "before").when(F.col("t") <= F.col("s1"), "during").otherwise("after").alias("phase"))


@query("SELECT segment_id, icao24 || '|' || coalesce(CASE WHEN seq % 4 <> 3 THEN strftime(make_timestamp(s0), '%Y-%m-%dT%H:%M:%S') END, 'None') || '|' || strftime(make_timestamp(s1), '%Y-%m-%dT%H:%M:%S') AS dedup_key FROM seg")
def dedup_key(spark, d):
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss")
    return _seg(spark, d).select("segment_id", F.concat_ws("|", "icao24", F.coalesce(F.when(F.col("seq") % 4 != 3, iso("s0")), F.lit("None")), iso("s1")).alias("dedup_key"))


@query("SELECT segment_id, CAST(to_json({'icao24': icao24, 'n_points': n_points, 'note': CASE WHEN seq % 2 = 1 THEN 'odd' END}) AS VARCHAR) AS meta FROM seg")
def json_metadata(spark, d):
    s = F.struct("icao24", "n_points", F.when(F.col("seq") % 2 == 1, "odd").alias("note"))
    return _seg(spark, d).select("segment_id", F.to_json(s, {"ignoreNullFields": "false"}).alias("meta"))


@query("SELECT event_id, CASE substr(upper(trim(event_type)), 1, 3) WHEN 'VIE' THEN 'Viewline' WHEN 'CLI' THEN 'Click Air' END AS airline FROM events", cte=False)
def airline_lookup(spark, d):
    names = F.create_map(*map(F.lit, ("VIE", "Viewline", "CLI", "Click Air")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.try_element_at(names, F.substring(F.upper(F.trim("event_type")), 1, 3)).alias("airline"))


@query("SELECT DISTINCT event_type, icao24 FROM (SELECT p.*, event_type FROM proj p JOIN events USING (event_id) UNION ALL SELECT p.*, event_type FROM proj p JOIN events USING (event_id))")
def distinct_rows(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type").join(reports(spark, d).select("event_id", "icao24"), "event_id").drop("event_id")
    return e.unionByName(e).dropDuplicates()


# order and quality


@query("SELECT icao24, coalesce(bool_or(t < p), false) AS was_unsorted FROM (SELECT icao24, t, lag(t) OVER (PARTITION BY icao24 ORDER BY event_id) AS p FROM adsc) GROUP BY 1")
def was_unsorted(spark, d):
    p = F.lag("t").over(Window.partitionBy("icao24").orderBy("event_id"))
    return points(spark, d, "adsc").withColumn("p", p).groupBy("icao24").agg(F.coalesce(F.bool_or(F.col("t") < F.col("p")), F.lit(False)).alias("was_unsorted"))


@query("SELECT icao24, bool_or(latitude > 58) AS any_outside, bool_or(velocity_mps > 270) AS any_fast, count(*) < 8 AS sparse FROM adsc GROUP BY 1")
def quality_flags(spark, d):
    return points(spark, d, "adsc").groupBy("icao24").agg(F.bool_or(F.col("latitude") > 58).alias("any_outside"), F.bool_or(F.col("velocity_mps") > 270).alias("any_fast"), (F.count("*") < 8).alias("sparse"))


@query("SELECT kind, sum(altitude_m * m) / greatest(sum(m), 1) AS masked_mean FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1.0e0 ELSE 0.0e0 END AS m FROM proj) GROUP BY 1")
def masked_mean(spark, d):
    m = F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0)
    return reports(spark, d).groupBy("kind").agg((F.sum(F.col("altitude_m") * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("masked_mean"))


@query(f"SELECT segment_id, round({_hav('lat0', 'lon0', 'lat1', 'lon1')} / 1000 * 0.539956803 / ((t1 - t0) / 1e6 / 3600), 6) AS anchor_kt FROM anc")
def anchor_speed(spark, d):
    return _anc(spark, d).select("segment_id", F.round(geo.speed_kt(geo.haversine_m(*map(F.col, Z.ENDS)), (F.col("t1") - F.col("t0")) / 1e6), 6).alias("anchor_kt"))


@query("SELECT s.segment_id, CASE WHEN n_before = 0 AND n_after = 0 THEN 'no_context' WHEN n_before = 0 THEN 'missing_before' ELSE 'missing_after' END AS issue FROM screen s WHERE n_before = 0 OR n_after = 0")
def baseline_issues(spark, d):
    s = S.range_screen(_seg(spark, d), points(spark, d, "adsb"), CONTEXT).where("n_before = 0 OR n_after = 0")
    none = F.col("n_before") == 0
    return s.select("segment_id", F.when(none & (F.col("n_after") == 0), "no_context").when(none, "missing_before").otherwise("missing_after").alias("issue"))


# counts and errors


@query("SELECT substr(segment_id, 1, 8) AS day, count(*) AS n FROM seg GROUP BY 1")
def daily_counts(spark, d):
    return _seg(spark, d).groupBy(F.substring("segment_id", 1, 8).alias("day")).agg(F.count("*").alias("n"))


@query("SELECT seq % 3 AS run, count(*) AS flights, count(*) FILTER (WHERE gap_minutes >= 1440) AS kept, count(*) FILTER (WHERE gap_minutes < 1440) AS dropped, round(avg(CASE WHEN gap_minutes >= 1440 THEN 1.0 ELSE 0.0 END), 6) AS keep_rate FROM seg GROUP BY 1")
def keep_rate_by_run(spark, d):
    kept = F.col("gap_minutes") >= 1440
    return _seg(spark, d).groupBy((F.col("seq") % 3).alias("run")).agg(F.count("*").alias("flights"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.round(F.avg(kept.cast("double")), 6).alias("keep_rate"))


_DAYS = f"SELECT substr(segment_id, 1, 8) AS day, segment_id, avg(error_m) / 1000 AS km FROM ({_ERR}) GROUP BY ALL"


@query(f"SELECT day, count(*) AS n_flights, round(avg(km), 6) AS mean_km, round(median(km), 6) AS median_km FROM ({_DAYS}) GROUP BY 1")
def period_errors(spark, d):
    e = _base(spark, d).groupBy("segment_id").agg((F.avg("error_m") / 1000).alias("km"))
    return e.groupBy(F.substring("segment_id", 1, 8).alias("day")).agg(F.count("*").alias("n_flights"), F.round(F.avg("km"), 6).alias("mean_km"), F.round(F.median("km"), 6).alias("median_km"))


@query(f"SELECT count(*) AS periods, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS spread FROM (SELECT day, avg(km) AS m FROM ({_DAYS}) GROUP BY 1)")
def period_spread(spark, d):
    e = _base(spark, d).groupBy("segment_id").agg((F.avg("error_m") / 1000).alias("km")).groupBy(F.substring("segment_id", 1, 8).alias("day")).agg(F.avg("km").alias("m"))
    return e.agg(F.count("*").alias("periods"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("spread"))


_EE = f"SELECT * FROM ({_ERR}) JOIN (SELECT segment_id, lat0, lon0, lat1, lon1 FROM anc) USING (segment_id)"
_TWO = f"SELECT *, CASE WHEN hold_km < base_km THEN 'hold' ELSE 'baseline' END AS best FROM (SELECT segment_id, avg(error_m) / 1000 AS base_km, avg({_hav('latitude', 'longitude', 'lat0', 'lon0')}) / 1000 AS hold_km FROM ({_EE}) GROUP BY 1)"


@query(f"SELECT segment_id, round(base_km, 6) AS base_km, round(hold_km, 6) AS hold_km, best FROM ({_TWO})")
def compare_methods(spark, d):
    return M.two_methods(_base(spark, d)).select("segment_id", r("base_km"), r("hold_km"), "best")


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN best = 'baseline' THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM ({_TWO})")
def win_rate(spark, d):
    return M.two_methods(_base(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg((F.col("best") == "baseline").cast("double")), 6).alias("win_rate"))


@query(f"SELECT * FROM (SELECT segment_id, round(base_km, 6) AS base_km, 'best' AS side FROM ({_TWO}) ORDER BY round(base_km, 6), segment_id LIMIT 10) UNION ALL SELECT * FROM (SELECT segment_id, round(base_km, 6), 'worst' FROM ({_TWO}) ORDER BY round(base_km, 6) DESC, segment_id LIMIT 10)")
def best_worst(spark, d):
    e = M.two_methods(_base(spark, d)).select("segment_id", r("base_km"))
    return e.orderBy("base_km", "segment_id").limit(10).withColumn("side", F.lit("best")).unionByName(e.orderBy(F.desc("base_km"), "segment_id").limit(10).withColumn("side", F.lit("worst")))


@query(f"SELECT segment_id, round({_hav('lat0', 'lon0', 'lat1', 'lon1')} / 1000, 3) AS anchor_km, round(km, 3) AS path_km, n FROM anc JOIN (SELECT icao24, seq, count(*) AS n, coalesce(sum({_hav('latitude', 'longitude', 'la', 'lo')}), 0) / 1000 AS km FROM (SELECT *, lead(latitude) OVER w AS la, lead(longitude) OVER w AS lo FROM pts WINDOW w AS (PARTITION BY icao24, seq ORDER BY t, event_id)) GROUP BY ALL) USING (icao24, seq)")
def flight_analytics(spark, d):
    path = S.speeds(_pts(spark, d), KEY).groupBy(*KEY).agg(F.count("*").alias("n"), (F.coalesce(F.sum("step_m"), F.lit(0.0)) / 1000).alias("km"))
    return _anc(spark, d).join(path, KEY).select("segment_id", F.round(geo.haversine_m(*map(F.col, Z.ENDS)) / 1000, 3).alias("anchor_km"), F.round("km", 3).alias("path_km"), "n")


_C2 = f"SELECT segment_id, {_hav('lat0', 'lon0', 'lat1', 'lon1')} / 1000 * {M.CO2_A_KM!r} AS b, {_hav('lat0', 'lon0', 'lat1', 'lon1')} / 1000 * {M.CO2_A_KM!r} * (0.95 + seq % 11 / 100.0) AS g FROM anc"


@query(f"""SELECT segment_id, round(g - b, 2) AS co2_diff_kg, round((g - b) / greatest(b, 0.01) * 100, 2) AS pct_diff,
 printf('GRU reconstruction implies %.0f kg CO2 %s than baseline (%.1f%% %s).', abs(g - b), CASE WHEN g - b > 0 THEN 'more' ELSE 'less' END, abs((g - b) / greatest(b, 0.01) * 100), CASE WHEN g - b > 0 THEN 'higher' ELSE 'lower' END) AS interpretation FROM ({_C2})""")
def emissions_compare(spark, d):
    b = geo.haversine_m(*map(F.col, Z.ENDS)) / 1000 * M.CO2_A_KM
    e = _anc(spark, d).select("segment_id", b.alias("b"), (b * (0.95 + F.col("seq") % 11 / 100.0)).alias("g"))
    return e.select("segment_id", *M.compare_emissions(F.col("g"), F.col("b")))


# a day stands for a month, as the reports span one
_ST = "SELECT substr(segment_id, 1, 8) AS month, count(*) AS n_segments, avg(gap_minutes) AS mean_gap_min FROM seg GROUP BY 1"
_IMP = f"SELECT substr(segment_id, 1, 8) AS month, count(*) AS n_flights, avg((hold_km - base_km) / greatest(hold_km, 0.01) * 100) AS improvement FROM ({_TWO}) GROUP BY 1"
_HALF = f"SELECT max(n) AS n, avg(v) FILTER (WHERE rn <= n // 2) AS f, avg(v) FILTER (WHERE rn > n - n // 2) AS l FROM (SELECT mean_gap_min AS v, row_number() OVER (ORDER BY month) AS rn, count(*) OVER () AS n FROM ({_ST}))"


@query(f"""SELECT 'LOW_COVERAGE' AS type, month, printf('Only %d segments (mean=%.0f). Possible ADS-C coverage gap.', n_segments, m) AS message, 'WARNING' AS severity FROM (SELECT *, avg(n_segments) OVER () AS m FROM ({_ST})) WHERE n_segments < m * 0.3
 UNION ALL SELECT 'MODEL_DRIFT', month, printf('GRU improvement only %.1f%% (threshold=5.0%%). Possible model drift.', improvement), 'WARNING' FROM ({_IMP}) WHERE n_flights >= 5 AND improvement < 5
 UNION ALL SELECT 'GAP_DURATION_TREND', 'overall', printf('Average gap duration increased from %.0fmin to %.0fmin. Possible ADS-C reporting change.', f, l), 'INFO' FROM ({_HALF}) WHERE n >= 4 AND l > 1.3 * f""")
def alerts(spark, d):
    day = F.substring("segment_id", 1, 8).alias("month")
    stats = _seg(spark, d).groupBy(day).agg(F.count("*").alias("n_segments"), F.avg("gap_minutes").alias("mean_gap_min"))
    gain = (F.col("hold_km") - F.col("base_km")) / F.greatest(F.col("hold_km"), F.lit(0.01)) * 100
    errors = M.two_methods(_base(spark, d)).groupBy(day).agg(F.count("*").alias("n_flights"), F.avg(gain).alias("improvement"))
    return M.alerts(stats, errors)


@query(f"SELECT count(*) AS months, CAST(sum(n_segments) AS BIGINT) AS total, min(month) AS first_month, max(month) AS last_month, round(avg(mean_gap_min), 6) AS mean_of_means FROM ({_ST})")
def monitoring_summary(spark, d):
    s = _seg(spark, d).groupBy(F.substring("segment_id", 1, 8).alias("month")).agg(F.count("*").alias("n"), F.avg("gap_minutes").alias("g"))
    return s.agg(F.count("*").alias("months"), F.sum("n").alias("total"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.round(F.avg("g"), 6).alias("mean_of_means"))


@query("SELECT segment_id, split FROM (SELECT segment_id, CASE seq % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM seg) WHERE split = 'train' ORDER BY segment_id LIMIT 50")
def list_flights(spark, d):
    s = _seg(spark, d).select("segment_id", F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("seq") % 3 + 1).cast("int")).alias("split"))
    return M.list_flights(s, "train")


# gaps


@query(f"SELECT event_id, segment_id, round(tau, 6) AS tau, round(base_lat, 6) AS base_lat, round(base_lon, 6) AS base_lon, round({_brg('lat0', 'lon0', 'lat1', 'lon1')}, 6) AS bearing, round({_hav('lat0', 'lon0', 'lat1', 'lon1')}, 3) AS metres, round((latitude - base_lat) * 111320, 3) AS north_m, round((longitude - base_lon) * 111320 * cos(radians(base_lat)), 3) AS east_m FROM ({_EE})")
def ml_points(spark, d):
    ends = [F.col(c) for c in Z.ENDS]
    east = (F.col("longitude") - F.col("base_lon")) * 111320 * F.cos(F.radians("base_lat"))
    return _base(spark, d).select("event_id", "segment_id", r("tau"), r("base_lat"), r("base_lon"), F.round(geo.bearing_deg(*ends), 6).alias("bearing"), F.round(geo.haversine_m(*ends), 3).alias("metres"), F.round((F.col("latitude") - F.col("base_lat")) * 111320, 3).alias("north_m"), F.round(east, 3).alias("east_m"))


def _ctx(side: str, order: str, n: int) -> str:
    return f"SELECT s.segment_id, a.*, row_number() OVER (PARTITION BY s.segment_id ORDER BY a.t {order}, a.event_id {order}) AS rn FROM anc s JOIN adsb a ON a.icao24 = s.icao24 AND a.t >= s.t0 - {CONTEXT} AND a.t < s.t1 + {CONTEXT} AND {side} QUALIFY rn <= {n}"


_X = "round((latitude - 53) / 8, 6) AS z_lat, round((velocity_mps - 240) / 30, 6) AS z_vel, round((altitude_m - 10500) / 1000, 6) AS z_alt"


@query(f"SELECT segment_id, 'before' AS side, 64 - rn AS position, {_X} FROM ({_ctx('a.t <= s.t0', 'DESC', 64)}) UNION ALL SELECT segment_id, 'after', rn - 1, {_X} FROM ({_ctx('a.t >= s.t1', 'ASC', 32)})")
def ml_sequences_long(spark, d):
    p = N.padded(points(spark, d, "adsb"), _anc(spark, d), CONTEXT)

    def side(name):
        x = p.select("segment_id", F.posexplode(F.arrays_zip(F.col(f"{name}_seq").alias("x"), F.col(f"{name}_mask").alias("m"))).alias("position", "v")).where("v.m = 1")
        return x.select("segment_id", F.lit(name).alias("side"), F.col("position").cast("long").alias("position"), *[F.round(F.col("v.x")[i], 6).alias(n) for i, n in ((0, "z_lat"), (2, "z_vel"), (5, "z_alt"))])

    return side("before").unionByName(side("after"))


@query(f"SELECT segment_id, round(altitude_m * 3.28084, 3) AS altitude_ft FROM ({_ctx('a.t <= s.t0', 'DESC', 1)}) WHERE abs((altitude_m - 10500) / 1000) < 5")
def alt_target(spark, d):
    last = F.element_at(F.element_at("before_seq", -1), 6)
    return N.padded(points(spark, d, "adsb"), _anc(spark, d), CONTEXT).where(F.abs(last) < 5).select("segment_id", F.round((last * 1000 + 10500) * 3.28084, 3).alias("altitude_ft"))


@query(f"SELECT DISTINCT segment_id, t FROM (SELECT segment_id, t FROM ({_ctx('a.t <= s.t0', 'DESC', 64)}) UNION ALL SELECT segment_id, t FROM ({_ctx('a.t >= s.t1', 'ASC', 32)}) UNION ALL SELECT a.segment_id, p.t FROM pts p JOIN anc a USING (icao24, seq))")
def timeline_union(spark, d):
    return _gap_rows(spark, d).select("segment_id", "t").distinct()


@query("SELECT CAST(row_number() OVER (ORDER BY m, a, c) - 1 AS INTEGER) AS param_id, m, a, c FROM (SELECT unnest([250.0e0, 500.0e0, 1000.0e0]) AS m) CROSS JOIN (SELECT unnest([0.005e0, 0.01e0, 0.02e0, 0.05e0]) AS a) CROSS JOIN (SELECT unnest([0.001e0, 0.003e0, 0.006e0, 0.01e0]) AS c)", cte=False)
def param_grid(spark, d):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(Z.parameter_grid("compact"))], "param_id int, m double, a double, c double")


_TR = f"""SELECT segment_id, t, source, round(la, 6) AS latitude, round(lo, 6) AS longitude FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, t ORDER BY n, la, lo) AS rn FROM (
 SELECT segment_id, t, 0 AS n, 'before' AS source, latitude AS la, longitude AS lo FROM ({_ctx('a.t <= s.t0', 'DESC', 64)})
 UNION ALL SELECT segment_id, t0 + CAST(floor((t1 - t0) * i / (n - 1)) AS BIGINT), 1, 'gap', {_gc('(i / (n - 1))')[0]}, {_gc('(i / (n - 1))')[1]} FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT *, greatest(2, (t1 - t0) // {HOUR} + 1) AS n FROM anc))
 UNION ALL SELECT segment_id, t, 2, 'after', latitude, longitude FROM ({_ctx('a.t >= s.t1', 'ASC', 32)}))) WHERE rn = 1"""


@query(_TR)
def serve_track(spark, d):
    ends = _anc(spark, d)
    near = Z.context_points(points(spark, d, "adsb"), ends, CONTEXT)
    gap = K.dense_track(ends, HOUR).withColumn("t", F.col("t0") + F.floor((F.col("t1") - F.col("t0")) * F.col("i") / (F.col("n") - 1)))
    full = M.full_track(near.where("t <= t0"), gap, near.where("t >= t1"))
    return full.select("segment_id", "t", "source", r("latitude"), r("longitude"))
