"""Queries over results of the reconstruction: descriptions, probes, extremes, zips, steps and channels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from .queries import _BASE, _ERR, _MET, HOUR, _anc, _brg, _hav, _metrics, _pts, _screen, _seg, points, query, r
from ..operators import tracks as K

_METRICS = ("mean_m", "median_m", "rmse_m", "max_m")
_SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95}


@query(
    "SELECT metric, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 3) AS low, "
    + ", ".join(f"round(quantile_cont(v, {q}), 3) AS {name}" for name, q in _SHARES.items())
    + f", round(max(v), 3) AS high FROM (UNPIVOT (SELECT {', '.join(_METRICS)} FROM ({_MET})) ON {', '.join(_METRICS)} INTO NAME metric VALUE v) GROUP BY metric"
)
def describe_metrics(spark, d):
    """Count, mean, deviation, least, exact percentiles and greatest of every metric of the baseline."""
    rows = _metrics(spark, d).select(F.explode(F.create_map(*[x for c in _METRICS for x in (F.lit(c), F.col(c))])).alias("metric", "v"))
    shares = [F.round(F.percentile("v", F.lit(q)), 3).alias(name) for name, q in _SHARES.items()]
    return rows.groupBy("metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 3).alias("mean"), F.round(F.stddev_samp("v"), 3).alias("std"), F.round(F.min("v"), 3).alias("low"), *shares, F.round(F.max("v"), 3).alias("high"))


_D13 = _hav("a.lat0", "a.lon0", "p.latitude", "p.longitude", "1.0")
_TURN = f"radians({_brg('a.lat0', 'a.lon0', 'p.latitude', 'p.longitude')}) - radians({_brg('a.lat0', 'a.lon0', 'a.lat1', 'a.lon1')})"
_XT = f"SELECT p.event_id, a.segment_id, abs(asin(sin({_D13}) * sin({_TURN})) * 6371.0) AS xt_km FROM pts p JOIN anc a ON a.icao24 = p.icao24 AND a.seq = p.seq"


def _cross(spark, d):
    """Distance of each sparse point from the great circle between its gap's anchors, the sine not clipped."""
    ends = _anc(spark, d).select("segment_id", "icao24", "seq", "lat0", "lon0", "lat1", "lon1")
    p = _pts(spark, d).select("icao24", "seq", "event_id", "latitude", "longitude").join(ends, ["icao24", "seq"])

    def polar(x):
        way = geo.haversine_m(x["lat0"], x["lon0"], x["lat"], x["lon"], 1.0)
        turn = F.radians(geo.bearing_deg(x["lat0"], x["lon0"], x["lat"], x["lon"])) - F.radians(geo.bearing_deg(x["lat0"], x["lon0"], x["lat1"], x["lon1"]))
        return F.abs(F.asin(F.sin(way) * F.sin(turn)) * 6371.0)

    xt = geo.let(polar, lat0=F.col("lat0"), lon0=F.col("lon0"), lat1=F.col("lat1"), lon1=F.col("lon1"), lat=F.col("latitude"), lon=F.col("longitude"))
    return p.select("event_id", "segment_id", xt.alias("xt_km"))


@query(f"SELECT segment_id, count(*) AS n, round(avg(xt_km), 5) AS mean_xt_km, round(max(xt_km), 5) AS max_xt_km FROM ({_XT}) GROUP BY segment_id")
def cross_track(spark, d):
    return _cross(spark, d).groupBy("segment_id").agg(F.count("*").alias("n"), F.round(F.avg("xt_km"), 5).alias("mean_xt_km"), F.round(F.max("xt_km"), 5).alias("max_xt_km"))


@query(f"SELECT segment_id, event_id, round(xt_km, 4) AS xt_km FROM ({_XT}) QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY round(xt_km, 4) DESC, event_id) <= 4")
def nlargest_xt(spark, d):
    """The four points of each gap that lie farthest from its path."""
    w = Window.partitionBy("segment_id").orderBy(F.desc("xt_km"), "event_id")
    far = _cross(spark, d).select("segment_id", "event_id", F.round("xt_km", 4).alias("xt_km"))
    return far.withColumn("k", F.row_number().over(w)).where("k <= 4").drop("k")


@query("SELECT segment_id, n_during, n_before, n_after FROM screen WHERE NOT (n_before > 0 AND n_during = 0 AND n_after > 0) ORDER BY n_during, n_before DESC, n_after DESC, segment_id LIMIT 3")
def topn_probe(spark, d):
    """The three segments that failed the screening but came nearest to passing it."""
    failed = _screen(spark, d).where(~((F.col("n_before") > 0) & (F.col("n_during") == 0) & (F.col("n_after") > 0)))
    return failed.orderBy("n_during", F.desc("n_before"), F.desc("n_after"), "segment_id").limit(3).select("segment_id", "n_during", "n_before", "n_after")


@query(
    f"""SELECT p.segment_id, p.i, round({_hav('p.latitude', 'p.longitude', 't.latitude', 't.longitude')}, 2) AS error_m FROM
 (SELECT s.segment_id, p.latitude, p.longitude, row_number() OVER (PARTITION BY s.segment_id ORDER BY p.t, p.event_id) AS i FROM pts p JOIN seg s USING (icao24, seq)) p JOIN
 (SELECT segment_id, base_lat AS latitude, base_lon AS longitude, row_number() OVER (PARTITION BY segment_id ORDER BY tau, event_id) AS i FROM ({_BASE})) t ON t.segment_id = p.segment_id AND t.i = p.i"""
)
def positional_zip(spark, d):
    """Truth and prediction of a gap joined by their position in it, as far as the shorter one goes."""
    nr = lambda *by: F.row_number().over(Window.partitionBy("segment_id").orderBy(*by))
    truth = _pts(spark, d).join(_seg(spark, d).select("icao24", "seq", "segment_id"), ["icao24", "seq"])
    truth = truth.select("segment_id", "latitude", "longitude", nr("t", "event_id").alias("i"))
    guess = K.baseline(_pts(spark, d), _anc(spark, d)).select("segment_id", "base_lat", "base_lon", nr("tau", "event_id").alias("i"))
    error = geo.haversine_m(*map(F.col, ("latitude", "longitude", "base_lat", "base_lon")))
    return truth.join(guess, ["segment_id", "i"]).select("segment_id", "i", F.round(error, 2).alias("error_m"))


@query(f"SELECT segment_id, array_agg(DISTINCT step ORDER BY step) AS steps FROM (SELECT s.segment_id, t // {HOUR} - lag(t // {HOUR}) OVER (PARTITION BY p.icao24, p.seq ORDER BY t, event_id) AS step FROM pts p JOIN seg s USING (icao24, seq)) WHERE step IS NOT NULL GROUP BY segment_id")
def grid_step_check(spark, d):
    """The distinct steps, in whole hours of the clock, from one report of a segment to the next."""
    hour = F.floor(F.col("t") / HOUR)
    step = hour - F.lag(hour).over(Window.partitionBy("icao24", "seq").orderBy("t", "event_id"))
    rows = _pts(spark, d).select("icao24", "seq", step.alias("step")).where("step IS NOT NULL").distinct()
    rows = rows.join(_seg(spark, d).select("icao24", "seq", "segment_id"), ["icao24", "seq"])
    return rows.groupBy("segment_id").agg(F.array_sort(F.collect_list("step")).alias("steps"))


@query(
    f"""SELECT count(*) AS flights, round(avg(m.mean_m) / 1000, 5) AS mean_km, round(avg(CASE WHEN m.rmse_m > m.mean_m * 1.1 THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_uneven, round(avg(x.mean_xt), 5) AS mean_xt_km
 FROM ({_MET}) m LEFT JOIN (SELECT segment_id, avg(xt_km) AS mean_xt FROM ({_XT}) GROUP BY segment_id) x USING (segment_id)"""
)
def analytics_summary(spark, d):
    """Means that skip nulls, and a share in per cent of all rows, over the gaps' metrics and distances across."""
    xt = _cross(spark, d).groupBy("segment_id").agg(F.avg("xt_km").alias("mean_xt"))
    uneven = F.avg(F.when(F.col("rmse_m") > F.col("mean_m") * 1.1, 1.0).otherwise(0.0)) * 100
    return _metrics(spark, d).join(xt, "segment_id", "left").agg(F.count("*").alias("flights"), F.round(F.avg("mean_m") / 1000, 5).alias("mean_km"), F.round(uneven, 4).alias("pct_uneven"), F.round(F.avg("mean_xt"), 5).alias("mean_xt_km"))


@query("SELECT segment_id, substr(segment_id, 1, 6) AS month, coalesce(n_points, 0) AS n_points FROM seg WHERE coalesce(n_points, 0) >= 3 AND substr(segment_id, 1, 4) IN ('2023', '2024')")
def catalog_kept(spark, d):
    """Segments of at least three reports (null: none) whose id starts with one of the periods."""
    n = F.coalesce("n_points", F.lit(0))
    return _seg(spark, d).where((n >= 3) & F.substring("segment_id", 1, 4).isin("2023", "2024")).select("segment_id", F.substring("segment_id", 1, 6).alias("month"), n.alias("n_points"))
