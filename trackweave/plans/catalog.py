"""Queries over catalogues of segments, registered with those over tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import catalog as C
from ..operators import segments as S
from ..operators import tracks as K
from ..operators.ranges import points_within
from ..sources.reports import points, reports
from .queries import _ERR, _SPEED, CONTEXT, HOUR, KEY, _anc, _dup, _DUP, _gc, _pts, _screen, _seg, query, r


@query("SELECT event_id, nullif(trim(lower(x)), '') AS v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '   ' ELSE '  ' || upper(event_type) || ' ' END AS x FROM events)", cte=False)
def normalize_strings(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("x"))
    return e.select("event_id", F.nullif(F.trim(F.lower("x")), F.lit("")).alias("v"))


@query("""SELECT event_id, coalesce(CAST(floor(try_cast(x AS DOUBLE)) AS BIGINT), CAST(epoch(try_strptime(replace(translate(x, 'T/', ' -'), 'Z', ''), '%Y-%m-%d %H:%M:%S')) AS BIGINT)) AS seconds FROM (
 SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(t // 1000000 AS VARCHAR) WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'no time' END AS x FROM proj)""")
def parse_time_variants(spark, d):
    e, k = reports(spark, d), F.col("event_id") % 5
    x = F.when(k == 0, F.floor(F.col("t") / 1_000_000).cast("string")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).when(k == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no time")
    return e.select("event_id", x.alias("x")).select("event_id", C.parse_time(F.col("x")).alias("seconds"))


@query("SELECT kind, CASE WHEN m >= 1e17 THEN 'ns' WHEN m >= 1e14 THEN 'us' WHEN m >= 1e11 THEN 'ms' ELSE 's' END AS unit FROM (SELECT kind, median(abs(CASE kind WHEN 'adsc' THEN t / 1e6 WHEN 'adsb' THEN t / 1e3 WHEN 'flight' THEN t ELSE t * 1e3 END)) AS m FROM proj GROUP BY kind)")
def infer_epoch_unit(spark, d):
    k, t = F.col("kind"), F.col("t").cast("double")
    x = F.when(k == "adsc", t / 1e6).when(k == "adsb", t / 1e3).when(k == "flight", t).otherwise(t * 1e3)
    return reports(spark, d).groupBy("kind").agg(C.epoch_unit(F.median(F.abs(x))).alias("unit"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN t % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso FROM proj")
def iso_ts(spark, d):
    tail = F.when(F.col("t") % 1_000_000 == 0, "").otherwise(F.date_format("ts", ".SSSSSS"))
    return reports(spark, d).select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), tail).alias("iso"))


@query("SELECT segment_id, strftime(try_strptime(substr(CASE WHEN seq % 5 = 4 THEN 'bad' || segment_id ELSE segment_id END, 1, 8), '%Y%m%d'), '%Y-%m') AS month FROM seg")
def parse_month(spark, d):
    x = F.when(F.col("seq") % 5 == 4, F.concat(F.lit("bad"), "segment_id")).otherwise(F.col("segment_id"))
    return _seg(spark, d).select("segment_id", F.date_format(F.try_to_timestamp(F.substring(x, 1, 8), F.lit("yyyyMMdd")), "yyyy-MM").alias("month"))


@query(f"SELECT segment_id, unnest(generate_series(s0 // {HOUR}, s1 // {HOUR})) AS hour_nr FROM seg")
def partition_hours(spark, d):
    return _seg(spark, d).select("segment_id", F.explode(F.sequence(F.floor(F.col("s0") / HOUR), F.floor(F.col("s1") / HOUR))).alias("hour_nr"))


@query("SELECT kind, count(*) FILTER (WHERE heading_deg BETWEEN 200 AND 310) AS west, count(*) FILTER (WHERE heading_deg BETWEEN 40 AND 130) AS east, count(*) AS n FROM proj GROUP BY kind")
def direction_bins(spark, d):
    h = F.col("heading_deg")
    return reports(spark, d).groupBy("kind").agg(F.count_if(h.between(200, 310)).alias("west"), F.count_if(h.between(40, 130)).alias("east"), F.count("*").alias("n"))


@query("SELECT event_id, CAST(round(altitude_m * 3.28084e0) AS BIGINT) AS altitude_ft FROM proj WHERE altitude_m >= 10000 AND velocity_mps >= 230")
def live_filter(spark, d):
    return reports(spark, d).where("altitude_m >= 10000 AND velocity_mps >= 230").select("event_id", F.round(F.col("altitude_m") * 3.28084).cast("long").alias("altitude_ft"))


@query("SELECT seq % 3 AS run, count(*) AS n, count(*) FILTER (WHERE n_before > 0 AND n_during = 0 AND n_after > 0) AS n_valid FROM screen GROUP BY 1")
def run_totals(spark, d):
    return _screen(spark, d).groupBy((F.col("seq") % 3).alias("run")).agg(F.count("*").alias("n"), F.count_if(F.expr("n_before > 0 AND n_during = 0 AND n_after > 0")).alias("n_valid"))


@query("SELECT segment_id, icao24, row_number() OVER (PARTITION BY icao24 ORDER BY n_before + n_during + n_after DESC, segment_id) AS rn FROM screen")
def dedup_ranked(spark, d):
    return C.rank_runs(_screen(spark, d), ["icao24"], ["n_before", "n_during", "n_after"], "segment_id").select("segment_id", "icao24", "rn")


@query("""SELECT * FROM (SELECT segment_id, unnest([CASE WHEN listed IS NULL THEN 'saved_folder_missing_from_summary' END, CASE WHEN saved IS NULL THEN 'summary_row_missing_saved_folder' END, CASE WHEN n_before = 0 THEN 'empty_adsb_before_file' END, CASE WHEN n_after = 0 THEN 'empty_adsb_after_file' END]) AS issue
 FROM (SELECT segment_id, true AS listed FROM seg WHERE seq % 4 <> 1) FULL JOIN (SELECT segment_id, n_before, n_after, true AS saved FROM screen WHERE seq % 5 <> 2) USING (segment_id)) WHERE issue IS NOT NULL""")
def integrity_issues(spark, d):
    return C.integrity_issues(_seg(spark, d).where("seq % 4 <> 1"), _screen(spark, d).where("seq % 5 <> 2"))


@query(f"""SELECT * FROM (UNPIVOT (SELECT icao24, count(*) - count(DISTINCT t) AS duplicate_timestamps, count(*) FILTER (WHERE latitude > 58) AS outside, CAST(count(*) < 8 AS BIGINT) AS sparse FROM {_DUP} GROUP BY icao24) ON duplicate_timestamps, outside, sparse INTO NAME issue_type VALUE issue_count) WHERE issue_count > 0""")
def quality_issues(spark, d):
    counted = _dup(spark, d).groupBy("icao24").agg((F.count("*") - F.countDistinct("t")).alias("duplicate_timestamps"), F.count_if(F.col("latitude") > 58).alias("outside"), (F.count("*") < 8).cast("long").alias("sparse"))
    return C.quality_issues(counted, "icao24", ["duplicate_timestamps", "outside", "sparse"])


@query(f"SELECT icao24, seq, nullif(concat_ws(';', CASE WHEN max(kt) > 40 THEN 'implausible_section_speed_after_clean' END, CASE WHEN count(*) < 3 THEN 'section_too_short_after_clean' END), '') AS drop_reason FROM ({_SPEED}) GROUP BY icao24, seq")
def keep_drop(spark, d):
    g = S.speeds(_pts(spark, d), KEY).groupBy(*KEY).agg(F.max("speed_kt").alias("kt"), F.count("*").alias("n"))
    why = F.concat_ws(";", F.when(F.col("kt") > 40, "implausible_section_speed_after_clean"), F.when(F.col("n") < 3, "section_too_short_after_clean"))
    return g.select(*KEY, F.nullif(why, F.lit("")).alias("drop_reason"))


@query("""SELECT n, round(f, 6) AS first_half, round(l, 6) AS last_half, coalesce(n >= 4 AND l > 1.3 * f, false) AS rises FROM (SELECT max(n) AS n, avg(v) FILTER (WHERE rn <= n // 2) AS f, avg(v) FILTER (WHERE rn > n - n // 2) AS l
 FROM (SELECT v, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM (SELECT substr(segment_id, 1, 8) AS day, avg(gap_minutes) AS v FROM seg GROUP BY 1)))""")
def halves_trend(spark, d):
    days = _seg(spark, d).groupBy(F.substring("segment_id", 1, 8).alias("day")).agg(F.avg("gap_minutes").alias("v"))
    return C.halves_trend(days, "day", "v").select("n", r("first_half"), r("last_half"), "rises")


@query(f"SELECT segment_id, event_id, 8 - rn AS position FROM (SELECT s.segment_id, a.event_id, row_number() OVER (PARTITION BY s.segment_id ORDER BY a.t DESC, a.event_id DESC) AS rn FROM seg s JOIN adsb a ON a.icao24 = s.icao24 AND a.t >= s.s0 - {CONTEXT} AND a.t < s.s0) WHERE rn <= 8")
def pad_sequence(spark, d):
    return C.last_before(points(spark, d, "adsb"), _seg(spark, d), CONTEXT, 8).select("segment_id", "event_id", "position")


_ARC = "SELECT *, greatest(1, (t1 - t) // {h}) AS n FROM (SELECT event_id, t, latitude AS lat0, longitude AS lon0, row_number() OVER w AS rn, lead(t) OVER w AS t1, lead(latitude) OVER w AS lat1, lead(longitude) OVER w AS lon1 FROM pts WINDOW w AS (PARTITION BY icao24, seq ORDER BY t, event_id)) WHERE t1 > t AND (lat1 <> lat0 OR lon1 <> lon0)".format(h=HOUR)


@query(f"SELECT event_id AS arc, i, round({_gc('(i / n)')[0]}, 6) AS latitude, round({_gc('(i / n)')[1]}, 6) AS longitude FROM (SELECT *, unnest(generate_series(CASE WHEN rn = 1 THEN 0 ELSE 1 END, n)) AS i FROM ({_ARC}))")
def densify_waypoints(spark, d):
    return C.densify(_pts(spark, d), KEY, HOUR).select("arc", "i", r("latitude"), r("longitude"))


@query(f"SELECT count(*) AS flights, round(avg(m), 3) AS mean_of_means, round(median(m), 3) AS median_of_means, (SELECT round(quantile_cont(error_m, 0.9), 3) FROM ({_ERR})) AS p90_points FROM (SELECT segment_id, avg(error_m) AS m FROM ({_ERR}) GROUP BY 1)")
def two_level_error_summary(spark, d):
    e = K.baseline(_pts(spark, d), _anc(spark, d)).select("segment_id", "error_m")
    means = e.groupBy("segment_id").agg(F.avg("error_m").alias("m")).agg(F.count("*").alias("flights"), F.round(F.avg("m"), 3).alias("mean_of_means"), F.round(F.median("m"), 3).alias("median_of_means"))
    return means.crossJoin(F.broadcast(e.agg(F.round(F.percentile("error_m", F.lit(0.9)), 3).alias("p90_points"))))  # one row each


@query("SELECT segment_id, event_id, 'adsc' AS source FROM seg JOIN pts USING (icao24, seq) UNION ALL " + f"SELECT s.segment_id, a.event_id, CASE WHEN a.t < s.s0 THEN 'before' ELSE 'after' END FROM seg s JOIN adsb a ON a.icao24 = s.icao24 AND a.t >= s.s0 - {CONTEXT} AND a.t < s.s1 + {CONTEXT} AND (a.t < s.s0 OR a.t > s.s1)")
def stitch_track(spark, d):
    s = _seg(spark, d).select("segment_id", *KEY, "s0", "s1")
    inner = _pts(spark, d).join(s, KEY).select("segment_id", "event_id", F.lit("adsc").alias("source"))
    t = F.col("t")
    outer = points_within(s, points(spark, d, "adsb"), F.col("s0") - CONTEXT, F.col("s1") + CONTEXT, ["event_id", "t"]).where((t < F.col("s0")) | (t > F.col("s1")))
    return inner.unionByName(outer.select("segment_id", "event_id", F.when(t < F.col("s0"), "before").otherwise("after").alias("source")))


_DEST = "asin(sin(radians(latitude)) * cos(0.01) + cos(radians(latitude)) * sin(0.01) * cos(radians(heading_deg)))"


@query(f"SELECT event_id, round(degrees({_DEST}), 6) AS latitude, round(x - 360 * floor(x / 360) - 180, 6) AS longitude FROM (SELECT *, degrees(radians(longitude) + atan2(sin(radians(heading_deg)) * sin(0.01) * cos(radians(latitude)), cos(0.01) - sin(radians(latitude)) * sin({_DEST}))) + 180 AS x FROM pts)")
def destination_point(spark, d):
    lat, lon = geo.destination(F.col("latitude"), F.col("longitude"), F.col("heading_deg"), F.lit(0.01 * geo.RADIUS_M))
    return _pts(spark, d).select("event_id", F.round(lat, 6).alias("latitude"), F.round(lon, 6).alias("longitude"))
