"""Gap segments, their screening against dense reports, and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .ranges import points_within

HOUR = 3_600_000_000


def sessionize(points: DataFrame, gap: int, key: str = "icao24", day: int = 24 * HOUR) -> DataFrame:
    """``seq``: number of the session within the key; a delta over ``gap`` starts a new one.

    Sessions are first numbered within a day of a key. The days' first and last times and numbers, a row each, then
    tell by how much a day's numbers rise and whether its first session goes on from an earlier day: no task sees more
    of a key than one day and one row for each day. Rows without a time come first, in the key's first session.
    """
    name, cell = F.coalesce(key, F.lit("\u0000")).alias("__key"), F.coalesce(F.floor(F.col("t") / day), F.lit(-(1 << 62))).alias("__day")
    dealt = points.select("*", name, cell)
    w = Window.partitionBy("__key", "__day").orderBy("t", "event_id")
    new = F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)
    dealt = dealt.withColumn("__new", new).withColumn("__own", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = dealt.groupBy("__key", "__day").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("__new").alias("new"))
    by = Window.partitionBy("__key").orderBy("__day")
    starts = F.when(F.col("first") - F.lag("last").over(by) > gap, 1).otherwise(0)
    base = days.withColumn("starts", starts).select("__key", "__day", (F.sum(F.col("new") + F.col("starts")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("new")).alias("__base"))
    return dealt.join(base, ["__key", "__day"]).withColumn("seq", (F.col("__base") + F.col("__own")).cast("long")).drop("__key", "__day", "__new", "__own", "__base")


def build_segments(sessions: DataFrame, least: int = 2) -> DataFrame:
    """Sessions of at least ``least`` points with some duration, with first and last position."""
    first, last = F.min_by(F.struct("ts", "latitude", "longitude"), F.struct("t", "event_id")), F.max_by(F.struct("ts", "latitude", "longitude"), F.struct("t", "event_id"))
    s = sessions.groupBy("icao24", "seq").agg(F.min("t").alias("s0"), F.max("t").alias("s1"), F.count("*").alias("n_points"), first.alias("a"), last.alias("b"))
    s = s.where((F.col("n_points") >= least) & (F.col("s1") > F.col("s0")))
    name = F.concat_ws("_", F.date_format("a.ts", "yyyyMMdd"), "icao24", F.date_format("a.ts", "HHmmss"), F.date_format("b.ts", "HHmmss"))
    return s.select(
        name.alias("segment_id"), "icao24", "seq", "s0", "s1", "n_points", ((F.col("s1") - F.col("s0")) / 60e6).alias("gap_minutes"),
        F.col("a.latitude").alias("lat0"), F.col("a.longitude").alias("lon0"), F.col("b.latitude").alias("lat1"), F.col("b.longitude").alias("lon1"),
    )


def first_callsign(points: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, callsign): the first known one in order of time, without white space around it; a blank one is none."""
    first = points.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.min_by(name, F.struct("t", "event_id")).alias("callsign"))
    return first.withColumn("callsign", F.nullif(F.trim("callsign"), F.lit("")))


def range_screen(segments: DataFrame, dense: DataFrame, context: int, bucket: int = 24 * HOUR) -> DataFrame:
    """Counts of dense points before, during and after each segment, and the times next to it.

    Windows are dealt into time buckets, so that the join has an equality on key and bucket and no key
    has to be gathered whole; the exact bounds are the join's residual.
    """
    w0, w1 = F.col("s0") - context, F.col("s1") + context
    cells = F.sequence(F.floor(w0 / bucket), F.floor(w1 / bucket))
    left = segments.select("segment_id", "icao24", "seq", "s0", "s1", w0.alias("w0"), w1.alias("w1"), F.explode(cells).alias("cell"))
    right = dense.select(F.col("icao24").alias("k"), "t", F.floor(F.col("t") / bucket).alias("c"))
    hit = left.join(right, (F.col("icao24") == F.col("k")) & (F.col("cell") == F.col("c")) & (F.col("t") >= F.col("w0")) & (F.col("t") < F.col("w1")), "left")
    before, after = F.col("t") < F.col("s0"), F.col("t") > F.col("s1")
    return hit.groupBy("segment_id", "icao24", "seq").agg(
        F.count_if(before).alias("n_before"), F.count_if((F.col("t") >= F.col("s0")) & (F.col("t") <= F.col("s1"))).alias("n_during"), F.count_if(after).alias("n_after"),
        F.max(F.when(before, F.col("t"))).alias("t_before"), F.min(F.when(after, F.col("t"))).alias("t_after"),
    )


def overlapping(segments: DataFrame, flights: DataFrame) -> DataFrame:
    """Segments and flights of one key whose intervals overlap; both bounds are strict.

    Both are dealt into the days that they touch, and a pair is kept in its first common day only: no key
    is gathered whole, and intervals far apart never meet.
    """
    day = lambda c: F.floor(F.col(c) / (24 * HOUR))
    left = segments.withColumn("__cell", F.explode(F.sequence(day("s0"), day("s1"))))
    right = flights.withColumn("__cell", F.explode(F.sequence(day("f0"), day("f1"))))
    both = left.join(right, ["icao24", "__cell"]).where((F.col("f0") < F.col("s1")) & (F.col("f1") > F.col("s0")))
    return both.where(F.col("__cell") == F.greatest(day("s0"), day("f0"))).drop("__cell")


def exactly_one(segments: DataFrame, flights: DataFrame) -> DataFrame:
    one = overlapping(segments, flights).groupBy("icao24", "seq").count().where("count = 1")
    return segments.join(one, ["icao24", "seq"], "left_semi")


def prefilter(segments: DataFrame, points: DataFrame, minutes: float, metres: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Long enough in time and distance, with a point in the box (inclusive)."""
    far = segments.where(F.col("gap_minutes") >= minutes).where(geo.haversine_m(*map(F.col, ("lat0", "lon0", "lat1", "lon1"))) >= metres)
    inside = points.where(F.col("latitude").between(*box[:2]) & F.col("longitude").between(*box[2:])).select("icao24", "seq").distinct()
    return far.join(inside, ["icao24", "seq"], "left_semi")


def speeds(points: DataFrame, keys: list[str], radius: float = geo.RADIUS_M) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    p = F.lag(F.struct("latitude", "longitude", "t")).over(w)
    d = geo.haversine_m(p["latitude"], p["longitude"], F.col("latitude"), F.col("longitude"), radius)
    return points.withColumn("step_m", d).withColumn("speed_kt", geo.speed_kt(d, (F.col("t") - p["t"]) / 1e6))


def boundary_speeds(segments: DataFrame, dense: DataFrame, context: int, radius: float = geo.RADIUS_M) -> DataFrame:
    """Speeds from the last dense point before a segment to its first, and from its last to the first dense point after it."""
    hit = points_within(segments.select("segment_id", "icao24", "s0", "s1", "lat0", "lon0", "lat1", "lon1"), dense, F.col("s0") - context, F.col("s1") + context, ["event_id", "t", "latitude", "longitude"])
    p = F.struct("t", "event_id", "latitude", "longitude")
    e = hit.groupBy("segment_id", "s0", "s1", "lat0", "lon0", "lat1", "lon1").agg(F.max(F.when(F.col("t") < F.col("s0"), p)).alias("a"), F.min(F.when(F.col("t") > F.col("s1"), p)).alias("b"))
    to = geo.speed_kt(geo.haversine_m(F.col("a.latitude"), F.col("a.longitude"), F.col("lat0"), F.col("lon0"), radius), (F.col("s0") - F.col("a.t")) / 1e6)
    off = geo.speed_kt(geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("b.latitude"), F.col("b.longitude"), radius), (F.col("b.t") - F.col("s1")) / 1e6)
    return e.select("segment_id", to.alias("before_kt"), off.alias("after_kt"))


def validate(screened: DataFrame, n_flights: DataFrame, profile: DataFrame, cap_kt: float, edges: DataFrame | None = None, edge_cap_kt: float = 750.0) -> DataFrame:
    """Sorted reasons against each segment; none: valid.

    With ``edges`` (segment_id, before_kt, after_kt) the speeds at the boundaries count too, where there are dense points
    and an unknown one is unreasonable; with ``flight_icao24`` in ``n_flights`` the code of the first flight must be the
    segment's, in any case of letters.
    """
    j = screened.join(n_flights, ["icao24", "seq"], "left").join(profile, ["icao24", "seq"], "left").fillna(0, ["n_flights"])
    why = [
        (F.col("n_flights") == 0, "no_overlapping_flight"), (F.col("n_flights") > 1, "multiple_overlapping_flights"), (F.col("n_before") == 0, "missing_adsb_before"),
        (F.col("n_during") > 0, "adsb_present_during_gap"), (F.col("n_after") == 0, "missing_adsb_after"), (F.col("max_kt").isNull(), "insufficient_adsc_points"), (F.col("max_kt") > cap_kt, "internal_adsc_speed_unreasonable"),
    ]
    extra = []
    if "flight_icao24" in n_flights.columns:
        why.append(((F.col("n_flights") > 0) & (F.lower("flight_icao24") != F.lower("icao24")), "icao24_mismatch"))
    if edges is not None:
        j, extra = j.join(edges, "segment_id", "left"), ["before_kt", "after_kt", *[c for c in ("max_kt", "median_kt") if c in profile.columns]]
        why += [((F.col(f"n_{s}") > 0) & (F.col(f"{s}_kt").isNull() | (F.col(f"{s}_kt") > edge_cap_kt)), f"boundary_speed_{s}_unreasonable") for s in ("before", "after")]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in why])))
    return j.select("segment_id", "icao24", "seq", F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) == 0).alias("is_valid"), *extra)


def merge_windows(windows: DataFrame, key: str = "icao24") -> DataFrame:
    """Union of intervals (w0, w1) of a key that touch or overlap."""
    w = Window.partitionBy(key).orderBy("w0", "w1")
    reach = F.max("w1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return windows.withColumn("n", F.when(F.col("w0") <= reach, 0).otherwise(1)).withColumn("g", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "g").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1")).drop("g")
