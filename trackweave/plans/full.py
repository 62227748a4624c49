"""Queries of whole reports: times of every type, metrics, emissions by type, analytics and point rows with all their columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import monitor as M
from ..operators import numbering as N
from ..operators import sections as P
from ..operators import segments as S
from ..operators import smoother as Z
from ..operators import times as X
from ..operators import tracks as K
from ..sources.reports import points, reports
from ..sources.tables import shared_folder, stage
from ..streaming import tables as Y
from .queries import _CTE, _ERR, CONTEXT, HOUR, KEY, ORACLE, _anc, _brg, _gc, _hav, _pts, _seg, _sess, query, r
from .reconstruct import _HALF, _ST, W0, W1, _gap_rows
from .sections import _OFF, _resampled, _sections, baseline_channels
from .sections import _ST as _SECTIONS_SQL
from .smoothing import _SPLITS, DEFAULT, _smoothed_sql

# times


def _typed(spark, d):
    """One time in four types: number, text of epoch seconds, text in several forms, timestamp."""
    e, k = reports(spark, d), F.col("event_id") % 5
    text = F.when(k == 0, F.floor(F.col("t") / 1_000_000).cast("string")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).when(k == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no time")
    return e.select("event_id", "kind", "t", "ts", (F.col("t") / 1e6).alias("number"), F.when(k == 4, "none").otherwise((F.col("t") / 1e6).cast("string")).alias("time"), text.alias("text"))


@query("SELECT event_id, t // 1000000 AS number, CASE WHEN event_id % 5 <> 4 THEN t // 1000000 END AS time, CASE WHEN event_id % 5 <> 4 THEN t // 1000000 END AS text, t // 1000000 AS ts FROM proj")
def time_by_type(spark, d):
    """A column is read as a time by its type and name."""
    rows = _typed(spark, d)
    return rows.select("event_id", *[F.unix_seconds(X.as_time(rows, c)).alias(c) for c in ("number", "time", "text", "ts")])


@query(f"SELECT c AS column_name, count(*) AS n FROM proj, (SELECT unnest(['number', 'time', 'text', 'ts']) AS c) WHERE (c IN ('number', 'ts') OR event_id % 5 <> 4) AND t // 1000000 * 1000000 >= {W0} AND t // 1000000 * 1000000 < {W1} GROUP BY c")
def window_by_type(spark, d):
    """Rows of a half-open window, over columns of four types."""
    rows, out = _typed(spark, d), None
    for c in ("number", "time", "text", "ts"):
        n = X.within(rows, c, W0, W1).agg(F.count("*").alias("n")).select(F.lit(c).alias("column_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT event_id, t // 1000000 AS number, CASE event_id % 4 WHEN 3 THEN NULL ELSE t // 1000000 END AS text FROM proj")
def epoch_applied(spark, d):
    """Numbers in the unit of their kind; texts of which some are times, some milliseconds and some neither."""
    k, t, e = F.col("kind"), F.col("t").cast("double"), F.col("event_id") % 4
    number = F.when(k == "adsc", t / 1e6).when(k == "adsb", t / 1e3).when(k == "flight", t).otherwise(t * 1e3)
    text = F.when(e == 3, "neither").when(e == 0, F.floor(F.col("t") / 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = reports(spark, d).select("event_id", "kind", number.alias("number"), text.alias("text"))
    one = X.coerced(rows, "number", "kind").withColumnRenamed("coerced", "a")
    return X.coerced(one, "text", "kind").select("event_id", F.unix_seconds("a").alias("number"), F.unix_seconds("coerced").alias("text"))


@query("SELECT segment_id, nullif(trim(cs), '') AS callsign FROM seg JOIN (SELECT icao24, seq, arg_min(CASE event_id % 4 WHEN 1 THEN '  ' ELSE ' CS' || event_id || ' ' END, (t, event_id)) FILTER (WHERE event_id % 4 <> 0) AS cs FROM sess GROUP BY ALL) USING (icao24, seq)")
def segment_callsign(spark, d):
    """The first known callsign of each segment, without white space; a blank one is none."""
    e = F.col("event_id") % 4
    sign = _sess(spark, d).withColumn("cs", F.when(e == 1, "  ").when(e != 0, F.concat(F.lit(" CS"), F.col("event_id"), F.lit(" "))))
    return _seg(spark, d).select("segment_id", *KEY).join(S.first_callsign(sign, KEY, "cs"), KEY, "left").select("segment_id", "callsign")


# errors


_NAMES = ("mean_m", "median_m", "rmse_m", "max_m", "min_m", "p90_m", "p95_m")


@query(f"SELECT segment_id, count(*) AS n, round(avg(error_m), 3) AS mean_m, round(median(error_m), 3) AS median_m, round(sqrt(avg(pow(error_m, 2))), 3) AS rmse_m, round(max(error_m), 3) AS max_m, round(min(error_m), 3) AS min_m, round(quantile_cont(error_m, 0.9), 3) AS p90_m, round(quantile_cont(error_m, 0.95), 3) AS p95_m FROM ({_ERR}) GROUP BY segment_id")
def error_metrics(spark, d):
    """All figures of a flight's errors."""
    m = M.error_metrics(K.baseline(_pts(spark, d), _anc(spark, d)), ["segment_id"], "error_m")
    return m.select("segment_id", "n", *[r(c, 3) for c in _NAMES])


@query(f"SELECT count(*) AS n_flights, round(avg(m), 4) AS mean_km, round(median(m), 4) AS median_km, round(quantile_cont(m, 0.9), 4) AS p90_km, (SELECT round(sqrt(avg(pow((pred_altitude_m - true_altitude_m) * 3.28084, 2))), 3) FROM ({ORACLE['baseline_channels'][ORACLE['baseline_channels'].rindex('SELECT event_id, segment_id, round('):]})) AS altitude_rmse_ft FROM (SELECT segment_id, avg(error_m) / 1000 AS m FROM ({_ERR}) GROUP BY 1)")
def method_summary(spark, d):
    """Mean, median and 90th percentile of flights' mean errors, and the root mean square error of the height."""
    means = K.baseline(_pts(spark, d), _anc(spark, d)).groupBy("segment_id").agg((F.avg("error_m") / 1000).alias("m"))
    s = means.agg(F.count("*").alias("n_flights"), F.round(F.avg("m"), 4).alias("mean_km"), F.round(F.median("m"), 4).alias("median_km"), F.round(F.percentile("m", F.lit(0.9)), 4).alias("p90_km"))
    off = (F.col("pred_altitude_m") - F.col("true_altitude_m")) * 3.28084
    return s.crossJoin(F.broadcast(baseline_channels(spark, d).agg(F.round(F.sqrt(F.avg(off * off)), 3).alias("altitude_rmse_ft"))))  # one row each


@query("SELECT count(*) AS months, CAST(sum(n) AS BIGINT) AS total, min(day) AS first_month, max(day) AS last_month, round(avg(a), 6) AS mean_of_means, round(median(m), 6) AS median_of_medians FROM (SELECT substr(segment_id, 1, 8) AS day, count(*) AS n, avg(gap_minutes) AS a, median(gap_minutes) AS m FROM seg GROUP BY 1)")
def monitoring_report(spark, d):
    """Totals over periods: days here, as the reports span one month."""
    s = _seg(spark, d).groupBy(F.substring("segment_id", 1, 8).alias("day")).agg(F.count("*").alias("n"), F.avg("gap_minutes").alias("a"), F.median("gap_minutes").alias("m"))
    return s.agg(F.count("*").alias("months"), F.sum("n").alias("total"), F.min("day").alias("first_month"), F.max("day").alias("last_month"), F.round(F.avg("a"), 6).alias("mean_of_means"), F.round(F.median("m"), 6).alias("median_of_medians"))


@query(f"""SELECT param_id, segment_id FROM (SELECT CAST(row_number() OVER (ORDER BY m, a, c) - 1 AS INTEGER) AS param_id FROM (SELECT unnest({Z.GRIDS['compact'][0]}) AS m), (SELECT unnest({Z.GRIDS['compact'][1]}) AS a), (SELECT unnest({Z.GRIDS['compact'][2]}) AS c)), (WITH {_SPLITS} SELECT segment_id FROM splits JOIN anc USING (segment_id) WHERE split = 'val')""")
def params_by_flight(spark, d):
    """Each parameter set with each flight of the validation split; the grid has at most 210 rows."""
    seg = _seg(spark, d)
    val = _anc(spark, d).join(N.split_of_keys(seg, "icao24").where("split = 'val'"), "icao24").select("segment_id")
    return val.crossJoin(F.broadcast(spark.range(len(Z.parameter_grid("compact"))).select(F.col("id").cast("int").alias("param_id")))).select("param_id", "segment_id")


# emissions and analytics

_EFF = "CASE WHEN ft <= 0 THEN 1.0 ELSE least(1.20, greatest(0.85, CASE WHEN ft < 37000 THEN 1 + 8 * pow((ft - 37000) / 37000, 2) ELSE 1 + 3 * (ft - 37000) / 40000 END)) END"
_TYPES = ["a330", "B777", "b787", "A350", "B767", "C172", None]
_FUEL = " ".join(f"WHEN '{k}' THEN {v[0]!r}" for k, v in M.AIRCRAFT.items())


@query(f"""SELECT segment_id, round(co2, 2) AS co2_kg, round(fuel, 2) AS fuel_kg, CASE WHEN km > 0 THEN round(co2 / km, 3) ELSE 0.0 END AS co2_per_km, round(ft, 0) AS mean_altitude_ft, round(eff, 4) AS efficiency_factor, CASE WHEN km > 0 AND code IN ({', '.join(f"'{k}'" for k in M.AIRCRAFT)}) THEN code ELSE 'fleet_average' END AS aircraft_type, round(km, 2) AS distance_km
 FROM (SELECT *, fuel * 3.16 AS co2 FROM (SELECT *, CASE code {_FUEL} ELSE {M.FLEET_FUEL!r} END * km * eff AS fuel FROM (SELECT *, CASE WHEN km > 0 THEN {_EFF} ELSE 1.0 END AS eff FROM (SELECT a.segment_id, CASE WHEN a.seq % 10 = 0 THEN 0.0 ELSE {_hav('a.lat0', 'a.lon0', 'a.lat1', 'a.lon1')} / 1000 END AS km, CASE WHEN a.seq % 10 = 0 THEN 35000.0 ELSE coalesce(ft, 35000.0) END AS ft, upper(([{', '.join('NULL' if t is None else f"'{t}'" for t in _TYPES)}])[a.seq % 7 + 1]) AS code
 FROM anc a LEFT JOIN (SELECT icao24, seq, avg(altitude_m * 3.28084) FILTER (WHERE altitude_m * 3.28084 > 33000) AS ft FROM pts GROUP BY ALL) h ON h.icao24 = a.icao24 AND h.seq = a.seq))))""")
def emissions_by_type(spark, d):
    """Fuel and CO2 of each gap by type of aircraft and mean height; some have no length, some types are not known."""
    feet = F.col("altitude_m") * 3.28084
    high = _pts(spark, d).groupBy(*KEY).agg(F.avg(F.when(feet > 33000, feet)).alias("ft"))
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("seq") % 7 + 1).cast("int"))
    km = F.when(F.col("seq") % 10 == 0, 0.0).otherwise(geo.haversine_m(*map(F.col, Z.ENDS)) / 1000)
    rows = _anc(spark, d).join(high, KEY, "left").select("segment_id", km.alias("km"), "ft", kind.alias("kind"))
    return M.emissions(rows, "km", "ft", "kind").drop("km", "ft", "kind")


def _length_sql(rows: str, name: str) -> str:
    return f"SELECT segment_id, sum({_hav('a', 'b', 'la', 'lo')}) / 1000 AS {name} FROM (SELECT *, lag(la) OVER w AS a, lag(lo) OVER w AS b FROM ({rows}) WINDOW w AS (PARTITION BY segment_id ORDER BY o, t, e)) GROUP BY 1"


_ENDS_SQL = "SELECT segment_id, 0 AS o, t0 AS t, 0 AS e, lat0 AS la, lon0 AS lo FROM anc UNION ALL SELECT segment_id, 2, t1, 0, lat1, lon1 FROM anc"
_KG = M.FLEET_FUEL * 3.16 * (1 + 8 * (2000 / 37000) ** 2)


@query(f"""{_smoothed_sql(DEFAULT)}, at_ AS (SELECT p.*, s.t FROM placed p JOIN asked s USING (segment_id, event_id)), own AS ({_length_sql(f'{_ENDS_SQL} UNION ALL SELECT segment_id, 1, t, event_id, smooth_lat, smooth_lon FROM at_', 'rk')}),
 real AS ({_length_sql('SELECT segment_id, 1 AS o, t, event_id AS e, latitude AS la, longitude AS lo FROM at_', 'ak')}), off AS (SELECT segment_id, count(*) AS n, avg(x) AS mx, max(x) AS xx FROM (SELECT segment_id, abs(asin(least(1.0, greatest(-1.0, sin(dd) * sin(tn)))) * 6371.0) AS x FROM (SELECT a.segment_id, {_hav('lat0', 'lon0', 'smooth_lat', 'smooth_lon')} / 6371000.0 AS dd, radians({_brg('lat0', 'lon0', 'smooth_lat', 'smooth_lon')}) - radians({_brg('lat0', 'lon0', 'lat1', 'lon1')}) AS tn FROM at_ a JOIN anc USING (segment_id))) GROUP BY 1)
 SELECT segment_id, round((t1 - t0) / 60e6, 4) AS gap_duration_minutes, n AS n_waypoints, round(km, 4) AS anchor_dist_km, round(rk, 4) AS smooth_dist_km, round(ak, 4) AS true_dist_km, round(rk - km, 4) AS dist_diff_km, round(rk * {_KG!r}, 2) AS smooth_co2_kg, round(km * {_KG!r}, 2) AS baseline_co2_kg, round((rk - km) * {_KG!r}, 2) AS co2_diff_kg, round(mx, 4) AS mean_xt_km, round(xx, 4) AS max_xt_km
 FROM (SELECT *, {_hav('lat0', 'lon0', 'lat1', 'lon1')} / 1000 AS km FROM anc) JOIN own USING (segment_id) JOIN real USING (segment_id) JOIN off USING (segment_id)""", cte=False)
def flight_report(spark, d):
    """Of each gap: lengths by both ways and of the true reports, CO2, distances across, differences."""
    ends = _anc(spark, d)
    placed = Z.positions(Z.smooth_gaps(_gap_rows(spark, d), [DEFAULT]), ends).join(_pts(spark, d).select("event_id", "t", "latitude", "longitude"), "event_id")
    out = M.flight_report(placed, ends, 35000.0)
    digits = {"smooth_co2_kg": 2, "baseline_co2_kg": 2, "co2_diff_kg": 2}
    return out.select("segment_id", "n_waypoints", *[r(c, digits.get(c, 4)) for c in out.columns if c not in ("segment_id", "n_waypoints")])


# point rows

_SIDE = [("velocity_mps", "velocity_mps"), ("heading_deg", "heading_deg"), ("altitude_m", "geoaltitude_m")]


@query(f""", {_SPLITS}, side AS (SELECT s.segment_id, {', '.join(f'arg_max(a.{c}, (a.t, a.event_id)) FILTER (WHERE a.t < s.s0) AS before_anchor_{n}, arg_min(a.{c}, (a.t, a.event_id)) FILTER (WHERE a.t > s.s1) AS after_anchor_{n}' for c, n in _SIDE)} FROM seg s JOIN adsb a ON a.icao24 = s.icao24 AND a.t >= s.s0 - {CONTEXT} AND a.t < s.s1 + {CONTEXT} GROUP BY 1)
 SELECT e.segment_id, 'step1_raw_' || (g.seq % 3) AS source_run, substr(e.segment_id, 1, 8) AS processing_day, g.icao24, CAST(row_number() OVER (PARTITION BY e.segment_id ORDER BY p.t, p.event_id) - 1 AS INTEGER) AS adsc_point_index, g.n_points AS adsc_point_count_clean, p.t AS timestamp_us, split, round(e.tau, 6) AS tau, round((p.t - a.t0) / (a.t1 - a.t0), 6) AS tau_raw, round((p.t - a.t0) / 1e6, 3) AS elapsed_sec_from_before_anchor,
 round((a.t1 - a.t0) / 1e6, 3) AS gap_duration_sec, round((a.t1 - a.t0) / 60e6, 5) AS gap_duration_minutes, round(a.lat0, 6) AS before_anchor_lat, round(a.lon0, 6) AS before_anchor_lon, round(a.lat1, 6) AS after_anchor_lat, round(a.lon1, 6) AS after_anchor_lon, {', '.join(f'{s}_anchor_{n}' for _, n in _SIDE for s in ('before', 'after'))}, round({_hav('a.lat0', 'a.lon0', 'a.lat1', 'a.lon1')}, 3) AS anchor_distance_m, round({_brg('a.lat0', 'a.lon0', 'a.lat1', 'a.lon1')}, 6) AS anchor_bearing_deg,
 round(e.base_lat, 6) AS baseline_lat, round(e.base_lon, 6) AS baseline_lon, round(e.latitude, 6) AS target_lat, round(e.longitude, 6) AS target_lon, round(e.error_m, 3) AS baseline_error_m, round((e.longitude - e.base_lon) * 111320 * cos(radians(e.base_lat)), 3) AS target_residual_east_m, round((e.latitude - e.base_lat) * 111320, 3) AS target_residual_north_m
 FROM ({_ERR}) e JOIN pts p ON p.event_id = e.event_id JOIN anc a ON a.segment_id = e.segment_id JOIN seg g ON g.segment_id = e.segment_id JOIN splits ON splits.segment_id = e.segment_id JOIN side ON side.segment_id = e.segment_id""")
def point_rows(spark, d):
    """One row a sparse report with all columns of the pointwise dataset."""
    seg = _seg(spark, d)
    about = seg.select("segment_id", "n_points", (F.col("seq") % 3).alias("run")).join(seg.join(N.split_of_keys(seg, "icao24"), "icao24").select("segment_id", "split"), "segment_id")
    sides = K.anchor_values(points(spark, d, "adsb"), seg, CONTEXT, dict(_SIDE))
    rows = K.baseline(_pts(spark, d), _anc(spark, d)).join(about, "segment_id").join(sides, "segment_id")
    nr = F.row_number().over(Window.partitionBy("segment_id").orderBy("t", "event_id")) - 1
    gap, since, ends = (F.col("t1") - F.col("t0")), (F.col("t") - F.col("t0")), [F.col(c) for c in Z.ENDS]
    east = (F.col("longitude") - F.col("base_lon")) * 111320 * F.cos(F.radians("base_lat"))
    shaped = {
        "source_run": F.concat(F.lit("step1_raw_"), "run"), "processing_day": F.substring("segment_id", 1, 8), "icao24": F.col("icao24"), "adsc_point_index": nr, "adsc_point_count_clean": F.col("n_points"), "timestamp_us": F.col("t"), "split": F.col("split"),
        "tau": F.round("tau", 6), "tau_raw": F.round(since / gap, 6), "elapsed_sec_from_before_anchor": F.round(since / 1e6, 3), "gap_duration_sec": F.round(gap / 1e6, 3), "gap_duration_minutes": F.round(gap / 60e6, 5),
        **{f"{s}_anchor_{c}": F.round(f"{c}{i}", 6) for i, s in enumerate(("before", "after")) for c in ("lat", "lon")}, **{f"{s}_anchor_{n}": F.col(f"{s}_anchor_{n}") for _, n in _SIDE for s in ("before", "after")},
        "anchor_distance_m": F.round(geo.haversine_m(*ends), 3), "anchor_bearing_deg": F.round(geo.bearing_deg(*ends), 6), "baseline_lat": F.round("base_lat", 6), "baseline_lon": F.round("base_lon", 6), "target_lat": F.round("latitude", 6), "target_lon": F.round("longitude", 6),
        "baseline_error_m": F.round("error_m", 3), "target_residual_east_m": F.round(east, 3), "target_residual_north_m": F.round((F.col("latitude") - F.col("base_lat")) * 111320, 3),
    }
    return rows.select("segment_id", *[c.alias(n) for n, c in shaped.items()])


# service and monitor

_LEAST = 10  # measured points of context that the smoother needs


@query(f"""{_smoothed_sql(DEFAULT)}, enough AS (SELECT segment_id, count(*) >= {_LEAST} AS ok FROM ctx GROUP BY 1),
parts AS (SELECT segment_id, t, CASE WHEN early THEN 0 ELSE 2 END AS n, latitude AS la, longitude AS lo FROM ctx1 UNION ALL SELECT segment_id, s.t, 1, smooth_lat, smooth_lon FROM placed JOIN asked s USING (segment_id, event_id) JOIN enough USING (segment_id) WHERE ok
 UNION ALL SELECT segment_id, t0 + CAST(floor((t1 - t0) * i / (n - 1)) AS BIGINT), 1, {_gc('(i / (n - 1))')[0]}, {_gc('(i / (n - 1))')[1]} FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT *, greatest(2, (t1 - t0) // {HOUR} + 1) AS n FROM anc JOIN enough USING (segment_id) WHERE NOT ok))),
track AS (SELECT *, {_hav('pa', 'po', 'la', 'lo')} / 1000 AS km FROM (SELECT *, lag(la) OVER w AS pa, lag(lo) OVER w AS po, lag(n) OVER w AS pn FROM (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY segment_id, t ORDER BY n, la, lo) = 1) WINDOW w AS (PARTITION BY segment_id ORDER BY t)))
SELECT segment_id, count(*) FILTER (WHERE n = 0) AS n_before, count(*) FILTER (WHERE n = 1) AS n_gap, count(*) FILTER (WHERE n = 2) AS n_after, round(sum(km), 4) AS total_km, round(coalesce(sum(km) FILTER (WHERE n = 1 OR pn = 1), 0), 4) AS gap_km, min(t) AS first_t, max(t) AS last_t, CASE WHEN ok THEN 'kalman' ELSE 'baseline' END AS method FROM track JOIN enough USING (segment_id) GROUP BY segment_id, ok""", cte=False)
def reconstruct_report(spark, d):
    """Each flight as a service gives it: smoothed where there is context enough, else along the great circle; points, lengths, times."""
    ends, dense = _anc(spark, d), points(spark, d, "adsb")
    near = stage(Z.context_points(dense, ends, CONTEXT))
    enough = near.groupBy("segment_id").agg((F.countDistinct("t") >= _LEAST).alias("ok"))
    method = enough.select("segment_id", F.when(F.col("ok"), "kalman").otherwise("baseline").alias("method"))
    placed = Z.positions(Z.smooth_gaps(_gap_rows(spark, d), [DEFAULT]), ends).join(_pts(spark, d).select("event_id", "t"), "event_id")
    smooth = placed.join(enough.where("ok"), "segment_id", "left_semi").select("segment_id", "t", F.col("smooth_lat").alias("latitude"), F.col("smooth_lon").alias("longitude"))
    plain = K.dense_track(ends.join(enough.where("NOT ok"), "segment_id", "left_semi"), HOUR).withColumn("t", F.col("t0") + F.floor((F.col("t1") - F.col("t0")) * F.col("i") / (F.col("n") - 1)))
    gap = smooth.unionByName(plain.select("segment_id", "t", "latitude", "longitude"))
    full = M.full_track(near.where("t <= t0"), gap, near.where("t >= t1"))
    return M.reconstruction_report(full, method).select("segment_id", "n_before", "n_gap", "n_after", r("total_km", 4), r("gap_km", 4), "first_t", "last_t", "method")


@query(f"""SELECT 'LOW_COVERAGE' AS type, month, printf('Only %d segments (mean=%.0f). Possible ADS-C coverage gap.', n_segments, m) AS message, 'WARNING' AS severity FROM (SELECT *, avg(n_segments) OVER () AS m FROM ({_ST})) WHERE n_segments < m * 0.3
 UNION ALL SELECT 'GAP_DURATION_TREND', 'overall', printf('Average gap duration increased from %.0fmin to %.0fmin. Possible ADS-C reporting change.', f, l), 'INFO' FROM ({_HALF}) WHERE n >= 4 AND l > 1.3 * f""")
def stream_alerts(spark, d):
    """Statistics by period and the alerts they give, kept up to date as segments come in two runs."""
    out = shared_folder(spark)
    seg = stage(_seg(spark, d).select("segment_id", "gap_minutes", "seq"))
    for run in (F.col("seq") % 2 == 1, F.col("seq") % 2 == 0):
        seg.where(run).write.mode("append").parquet(f"{out}/segments")
        rows = spark.readStream.schema(seg.schema).parquet(f"{out}/segments")
        stats = rows.groupBy(F.substring("segment_id", 1, 8).alias("month")).agg(F.count("*").alias("n_segments"), F.avg("gap_minutes").alias("mean_gap_min"))
        none = spark.createDataFrame([], "month string, n_flights long, improvement double")
        got = Y.stream_alerts(stats, ["month"], lambda latest: M.alerts(latest, none), f"{out}/told", f"{out}/state")  # noqa: B023
    return got


# resampling by section

_SEVEN = ["latitude", "longitude", "altitude_m", "geoaltitude_m", "baroaltitude_m", "velocity_mps", "heading_deg"]
_KEYED = "FROM (SELECT * REPLACE (segment_id || '/' || source_section AS segment_id), altitude_m + 15 AS geoaltitude_m, CASE WHEN event_id % 5 <> 0 THEN altitude_m - 20 END AS baroaltitude_m FROM st)"
_SIGN = "CASE WHEN event_id % 4 <> 0 THEN 'CS' || event_id END"


@query(f"""SELECT split_part(x.segment_id, '/', 1) AS segment_id, split_part(x.segment_id, '/', 2) AS source_section, x.t, {', '.join('x.' + v for v in _SEVEN)}, callsign FROM ({_CTE}{_resampled(_SEVEN, True).replace('FROM st)', _KEYED + ')')}) x
 JOIN ({_CTE}, {_SECTIONS_SQL} SELECT segment_id || '/' || source_section AS k, arg_min({_SIGN}, (t - CASE WHEN event_id % 3 = 0 THEN t % {HOUR} ELSE 0 END, event_id)) FILTER (WHERE event_id % 4 <> 0) AS callsign FROM st GROUP BY 1) l ON l.k = x.segment_id""", cte=False)
def resample_by_section(spark, d):
    """Each section of a flight on its own grid: seven columns, the first known callsign; short sections stay as they are."""
    e = F.col("event_id")
    rows = _sections(spark, d).withColumns({"t": F.col("t") - F.when(e % 3 == 0, F.col("t") % HOUR).otherwise(0), "geoaltitude_m": F.col("altitude_m") + 15, "baroaltitude_m": F.when(e % 5 != 0, F.col("altitude_m") - 20), "callsign": F.when(e % 4 != 0, F.concat(F.lit("CS"), e))})
    x = P.resample_sections(rows, ["segment_id", "source_section"], _SEVEN, HOUR, ["callsign"], ["t", "event_id"])
    return x.select("segment_id", "source_section", "t", *[F.round(F.col(v) + _OFF, 6).alias(v) for v in _SEVEN], "callsign")
