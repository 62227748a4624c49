"""Monthly statistics, alerts, emissions and the views that a service gives of reconstructed gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .catalog import halves_trend

# Fuel in kg/km, kg of CO2 a kg of fuel, share of the fleet.
FLEET = [(5.98, 3.16, 0.28), (7.20, 3.16, 0.22), (5.50, 3.16, 0.20), (5.30, 3.16, 0.15), (6.80, 3.16, 0.10), (4.90, 3.16, 0.05)]
CO2_A_KM = sum(f * c * s for f, c, s in FLEET) / sum(s for _, _, s in FLEET)


# Fuel in kg/km and kg of CO2 a kg of fuel by type of aircraft.
AIRCRAFT = {"A330": (5.98, 3.16), "B777": (7.20, 3.16), "B787": (5.50, 3.16), "A350": (5.30, 3.16), "B767": (6.80, 3.16)}
FLEET_FUEL = sum(f * s for f, _, s in FLEET) / sum(s for _, _, s in FLEET)


def efficiency(feet: Column) -> Column:
    """Fuel burnt at a height over that at the best one; unknown heights count as the best."""
    below, above = 1 + 8 * F.pow((feet - 37000) / 37000, F.lit(2)), 1 + 3 * (feet - 37000) / 40000
    return F.when(feet <= 0, 1.0).otherwise(F.least(F.lit(1.20), F.greatest(F.lit(0.85), F.when(feet < 37000, below).otherwise(above))))


def emissions(rows: DataFrame, km: str, feet: str, aircraft: str) -> DataFrame:
    """``rows`` with co2_kg, fuel_kg, co2_per_km, mean_altitude_ft, efficiency_factor, aircraft_type and distance_km, rounded.

    Unknown types count as the fleet's mean, unknown heights as 35000 ft. Without a distance nothing is burnt.
    """
    known = F.upper(aircraft).isin(*AIRCRAFT)
    of = lambda i: F.element_at(F.create_map(*[x for name, v in AIRCRAFT.items() for x in (F.lit(name), F.lit(v[i]))]), F.upper(aircraft))
    x = rows.withColumn("__some", F.coalesce(F.col(km) > 0, F.lit(False))).withColumn("__ft", F.when(F.col("__some"), F.coalesce(F.col(feet), F.lit(35000.0))).otherwise(35000.0))
    x = x.withColumn("__eff", F.when(F.col("__some"), efficiency(F.col("__ft"))).otherwise(1.0)).withColumn("__fuel", F.when(known, of(0)).otherwise(FLEET_FUEL) * F.col(km) * F.col("__eff"))
    x = x.withColumn("__co2", F.col("__fuel") * F.when(known, of(1)).otherwise(3.16))
    some = lambda c, digits: F.when(F.col("__some"), F.round(c, digits)).otherwise(0.0)
    return x.select(
        *rows.columns, some(F.col("__co2"), 2).alias("co2_kg"), some(F.col("__fuel"), 2).alias("fuel_kg"), some(F.col("__co2") / F.col(km), 3).alias("co2_per_km"), F.round("__ft", 0).alias("mean_altitude_ft"),
        F.round("__eff", 4).alias("efficiency_factor"), F.when(F.col("__some") & known, F.upper(aircraft)).otherwise("fleet_average").alias("aircraft_type"), some(F.col(km), 2).alias("distance_km"),
    )


def alerts(stats: DataFrame, errors: DataFrame) -> DataFrame:
    """(type, month, message, severity) from one row a month: (month, n_segments, mean_gap_min) and (month, n_flights, improvement).

    Months under three tenths of the mean count, months of at least five flights with under 5 % of improvement,
    and a last half whose mean gap is over 1.3 times that of the first, of at least four months.
    """
    mean = stats.agg(F.avg("n_segments").alias("mean_n"))  # one row
    low = stats.crossJoin(F.broadcast(mean)).where(F.col("n_segments") < F.col("mean_n") * 0.3)
    low = low.select(F.lit("LOW_COVERAGE").alias("type"), "month", F.format_string("Only %d segments (mean=%.0f). Possible ADS-C coverage gap.", "n_segments", "mean_n").alias("message"), F.lit("WARNING").alias("severity"))
    drift = errors.where("n_flights >= 5 AND improvement < 5")
    drift = drift.select(F.lit("MODEL_DRIFT").alias("type"), "month", F.format_string("GRU improvement only %.1f%% (threshold=5.0%%). Possible model drift.", "improvement").alias("message"), F.lit("WARNING").alias("severity"))
    trend = halves_trend(stats, "month", "mean_gap_min").where("rises")
    trend = trend.select(F.lit("GAP_DURATION_TREND").alias("type"), F.lit("overall").alias("month"), F.format_string("Average gap duration increased from %.0fmin to %.0fmin. Possible ADS-C reporting change.", "first_half", "last_half").alias("message"), F.lit("INFO").alias("severity"))
    return low.unionByName(drift).unionByName(trend)


def compare_emissions(co2: Column, base_co2: Column) -> list[Column]:
    """Difference in kg, in percent of the baseline (at least 0.01 kg), and both in words."""
    diff = co2 - base_co2
    pct = diff / F.greatest(base_co2, F.lit(0.01)) * 100
    words = F.format_string("GRU reconstruction implies %.0f kg CO2 %s than baseline (%.1f%% %s).", F.abs(diff), F.when(diff > 0, "more").otherwise("less"), F.abs(pct), F.when(diff > 0, "higher").otherwise("lower"))
    return [F.round(diff, 2).alias("co2_diff_kg"), F.round(pct, 2).alias("pct_diff"), words.alias("interpretation")]


def list_flights(segments: DataFrame, split: str | None = None, limit: int = 50) -> DataFrame:
    """The first ``limit`` segments by id, of one split if named."""
    return (segments if split is None else segments.where(F.col("split") == split)).orderBy("segment_id").limit(limit)


def full_track(before: DataFrame, gap: DataFrame, after: DataFrame) -> DataFrame:
    """Points (segment_id, t, latitude, longitude) of all three; of one time the first of before, gap, after stays."""
    parts = [p.select("segment_id", "t", F.lit(i).alias("n"), F.lit(s).alias("source"), "latitude", "longitude") for i, (s, p) in enumerate((("before", before), ("gap", gap), ("after", after)))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = F.min(F.struct("n", "latitude", "longitude", "source"))
    return every.groupBy("segment_id", "t").agg(first.alias("p")).select("segment_id", "t", "p.source", "p.latitude", "p.longitude")


def two_methods(points: DataFrame) -> DataFrame:
    """Mean error in km of each segment by the baseline and by holding its start, and the better one (the baseline if equal)."""
    hold = geo.haversine_m(*map(F.col, ("latitude", "longitude", "lat0", "lon0")))
    e = points.groupBy("segment_id").agg((F.avg("error_m") / 1000).alias("base_km"), (F.avg(hold) / 1000).alias("hold_km"))
    return e.withColumn("best", F.when(F.col("hold_km") < F.col("base_km"), "hold").otherwise("baseline"))


def monthly_errors(flights: DataFrame, error: str, base: str) -> DataFrame:
    """By ``month``: mean and median of both errors and of the gain in per cent; a null month is left out."""
    gain = (1 - F.col(error) / F.greatest(F.col(base), F.lit(0.01))) * 100
    both = lambda c, n: [F.avg(c).alias(f"{n}mean_km"), F.median(c).alias(f"{n}median_km")]
    x = flights.where("month IS NOT NULL").withColumn("__gain", gain)
    return x.groupBy("month").agg(F.count("segment_id").alias("n_flights"), *both(error, ""), *both(base, "bl_"), F.avg("__gain").alias("improvement_mean"), F.median("__gain").alias("improvement_median"))


def error_metrics(rows: DataFrame, keys: list[str], error: str) -> DataFrame:
    """By key: number, mean, median, root mean square, largest, least, 90th and 95th percentile (linear) of a column of metres."""
    part = lambda p: F.percentile(error, F.lit(p))
    return rows.groupBy(*keys).agg(
        F.count(error).alias("n"), F.avg(error).alias("mean_m"), F.median(error).alias("median_m"), F.sqrt(F.avg(F.pow(error, F.lit(2)))).alias("rmse_m"),
        F.max(error).alias("max_m"), F.min(error).alias("min_m"), part(0.9).alias("p90_m"), part(0.95).alias("p95_m"),
    )


def _length_km(track: DataFrame, lat: str, lon: str) -> DataFrame:
    """(segment_id, km) along the points in order of o, t and event_id; zero for a single one."""
    w = Window.partitionBy("segment_id").orderBy("o", "t", "event_id")
    step = geo.haversine_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    return track.withColumn("__step", step).groupBy("segment_id").agg((F.sum("__step") / 1000).alias("km"))


def flight_report(placed: DataFrame, ends: DataFrame, feet: float) -> DataFrame:
    """A row a gap: lengths of the smoothed track with its ends, of the great circle and of the true reports; CO2, distances across.

    ``placed``: segment_id, event_id, t, smooth_lat, smooth_lon, latitude, longitude. The great circle is as long as the distance of the ends.
    """
    side = [ends.select("segment_id", F.lit(o).alias("o"), F.col(f"t{i}").alias("t"), F.lit(0).cast("long").alias("event_id"), F.col(f"lat{i}").alias("la"), F.col(f"lon{i}").alias("lo")) for i, o in ((0, 0), (1, 2))]
    own = placed.select("segment_id", F.lit(1).alias("o"), "t", "event_id", F.col("smooth_lat").alias("la"), F.col("smooth_lon").alias("lo"))
    smooth = _length_km(own.unionByName(side[0]).unionByName(side[1]), "la", "lo").withColumnRenamed("km", "smooth_dist_km")
    true = _length_km(placed.select("segment_id", F.lit(1).alias("o"), "t", "event_id", "latitude", "longitude"), "latitude", "longitude").withColumnRenamed("km", "true_dist_km")
    line = [F.col(c) for c in ("lat0", "lon0", "lat1", "lon1")]
    across = placed.select("segment_id", "smooth_lat", "smooth_lon").join(ends.select("segment_id", *line), "segment_id")
    across = across.withColumn("x", F.abs(geo.along_cross_m(*line, F.col("smooth_lat"), F.col("smooth_lon"))[1]) / 1000).groupBy("segment_id").agg(F.count("*").alias("n_waypoints"), F.avg("x").alias("mean_xt_km"), F.max("x").alias("max_xt_km"))
    base = ends.select("segment_id", ((F.col("t1") - F.col("t0")) / 60e6).alias("gap_duration_minutes"), (geo.haversine_m(*line) / 1000).alias("anchor_dist_km"))
    rows = base.join(smooth, "segment_id").join(true, "segment_id").join(across, "segment_id")
    kg = FLEET_FUEL * 3.16 * efficiency(F.lit(feet))
    return rows.select(
        "segment_id", "gap_duration_minutes", "n_waypoints", "anchor_dist_km", "smooth_dist_km", "true_dist_km", (F.col("smooth_dist_km") - F.col("anchor_dist_km")).alias("dist_diff_km"), (F.col("smooth_dist_km") * kg).alias("smooth_co2_kg"),
        (F.col("anchor_dist_km") * kg).alias("baseline_co2_kg"), ((F.col("smooth_dist_km") - F.col("anchor_dist_km")) * kg).alias("co2_diff_kg"), "mean_xt_km", "max_xt_km",
    )


def reconstruction_report(track: DataFrame, method: DataFrame) -> DataFrame:
    """Of each reconstructed flight (segment_id, t, source, latitude, longitude): points by source, lengths, first and last time, method.

    The length of the gap is that of the steps that end or begin in it. ``method``: segment_id, method.
    """
    w = Window.partitionBy("segment_id").orderBy("t")
    step = geo.haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")) / 1000
    inside = (F.col("source") == "gap") | (F.lag("source").over(w) == "gap")
    rows = track.withColumn("__step", step).withColumn("__in", F.coalesce(inside, F.lit(False)))
    count = [F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("before", "gap", "after")]
    lengths = [F.sum("__step").alias("total_km"), F.sum(F.when(F.col("__in"), F.col("__step")).otherwise(0.0)).alias("gap_km")]
    return rows.groupBy("segment_id").agg(*count, *lengths, F.min("t").alias("first_t"), F.max("t").alias("last_t")).join(method, "segment_id")
