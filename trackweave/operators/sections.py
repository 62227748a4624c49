"""Sections of a flight (before, adsc, after): standard columns, audit, cleaning, keep or drop, issues.

A row has ``segment_id``, ``source_section``, ``t`` in microseconds, a position and ``ord``, its place in the input.
Nulls in time or position are counted and dropped; ties in time keep the first in the input; a section without rows
has no row in the audit and counts as empty; tables may be empty. Columns that are not named here are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import stage
from .tracks import drop_spikes, resample

# Fixed values.
CAPS_KT = {"before": 620.0, "adsc": 700.0, "after": 620.0, "stitched": 620.0}
LEAST_ROWS = {"before": 1, "adsc": 2, "after": 1, "stitched": 1}
PHASES = {"before": "ADS-B before", "adsc": "ADS-C gap", "after": "ADS-B after", "stitched": "stitched"}
SOURCES = {"before": "adsb", "adsc": "adsc", "after": "adsb", "stitched": "fused"}
NUMBERS = ["latitude", "longitude", "altitude_m", "geoaltitude_m", "baroaltitude_m", "velocity_mps", "heading_deg"]
TEXTS = ["icao24", "callsign", "phase", "source"]
RADIUS_NM = 3440.065
RADIUS_KM = 6371.0088
QUARTER = 15 * 60_000_000
COUNTERS = ["timestamp_null_count", "invalid_coord_count", "missing_key_value_count", "duplicate_exact_count", "duplicate_timestamp_count", "isolated_spike_removed_count"]

KEY = ["segment_id", "source_section"]


def by_section(values: dict, section: str = "source_section") -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(section)]


def standard_section(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The standard columns in their order: given ones in their types, others from ``defaults``, the labels, or null.

    Texts are trimmed, empty ones null; numbers that are none become null.
    """
    fill = {"phase": by_section(PHASES), "source": by_section(SOURCES)} | defaults

    def column(name, kind):
        c = F.col(name) if name in rows.columns else fill.get(name, F.lit(None))
        return F.nullif(F.trim(c.cast("string")), F.lit("")) if kind == "text" else c.try_cast(kind)

    kinds = {"segment_id": "string", "source_section": "string", "t": "long", "icao24": "text", **dict.fromkeys(NUMBERS, "double"), "callsign": "text", "phase": "text", "source": "text"}
    return rows.select(*[column(n, k).alias(n) for n, k in kinds.items()])


def audit(raw: DataFrame) -> DataFrame:
    """Counts on the rows as they came: null times, coordinates out of range (each of the two), incomplete rows, disorder."""
    lag = F.lag("t").over(Window.partitionBy(*KEY).orderBy("ord"))
    out = lambda c, most: F.count_if(~F.col(c).between(-most, most))  # noqa: E731  null is not out of range
    return raw.withColumn("__back", F.col("t").isNull() | F.coalesce(F.col("t") < lag, F.lit(False))).groupBy(*KEY).agg(
        F.count("*").alias("rows_raw"), F.count_if(F.col("t").isNull()).alias("timestamp_null_count"), (out("latitude", 90) + out("longitude", 180)).alias("invalid_coord_count"),
        F.count_if(F.col("t").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull()).alias("missing_key_value_count"), F.bool_or("__back").alias("was_unsorted"),
    )


def first_rows(raw: DataFrame, values: list[str]) -> DataFrame:
    """One row a section and time, the first of the input, with the numbers of rows that were equal and that shared the time."""
    ok = raw.dropna(subset=["t", "latitude", "longitude"]).where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    same = ok.groupBy(*KEY, "t", *values).agg(F.min("ord").alias("ord"), (F.count("*") - 1).alias("__equal"))
    one = same.groupBy(*KEY, "t").agg(F.min_by(F.struct("ord", *values), "ord").alias("v"), F.sum("__equal").alias("n_equal"), (F.count("*") - 1).alias("n_tied"))
    return one.select(*KEY, "t", "v.*", "n_equal", "n_tied")


def max_speed(rows: DataFrame, name: str) -> DataFrame:
    """Greatest speed between neighbours of a section; null where no two have time between them."""
    p = F.lag(F.struct("t", "latitude", "longitude")).over(Window.partitionBy(*KEY).orderBy("t"))
    miles = geo.haversine_m(p["latitude"], p["longitude"], F.col("latitude"), F.col("longitude"), RADIUS_NM)
    return rows.select(*KEY, F.when(F.col("t") > p["t"], miles / ((F.col("t") - p["t"]) / 3.6e9)).alias("__kt")).groupBy(*KEY).agg(F.max("__kt").alias(name))


def spikes(rows: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Of each section with a cap, the rows that are too fast to reach and to leave while their own neighbours fit each other: their number."""
    w, here = Window.partitionBy(*KEY).orderBy("t"), F.struct("t", "latitude", "longitude")
    legs = rows.where(F.col("source_section").isin(*caps)).select(*KEY, by_section(caps).alias("cap"), F.lag(here).over(w).alias("a"), here.alias("p"), F.lead(here).over(w).alias("b"))
    a, p, b = (F.col(c) for c in "apb")
    spike = (implied_kt(a, p) > F.col("cap")) & (implied_kt(p, b) > F.col("cap")) & (implied_kt(a, b) <= F.col("cap"))
    return legs.groupBy(*KEY).agg(F.count_if(spike).alias("isolated_spike_removed_count"))


def clean(raw: DataFrame, values: list[str], caps: dict[str, float] = CAPS_KT, remove: bool = True) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows, and one row of audit a section. Isolated spikes go from the adsc and stitched sections only.

    They go until none is left. Without ``remove`` the rows keep them, and only those that are spikes between their own
    neighbours are counted and taken off the number of clean rows.
    """
    raw, capped = stage(raw), {s: caps[s] for s in ("adsc", "stitched") if s in caps}
    first = stage(first_rows(raw, values))
    counts = first.groupBy(*KEY).agg(F.sum("n_equal").alias("duplicate_exact_count"), F.sum("n_tied").alias("duplicate_timestamp_count"), F.count("*").alias("__n"))
    rows = first.drop("n_equal", "n_tied")
    kept = stage(drop_spikes(rows, KEY, capped, tie="ord", radius=RADIUS_KM * 1000)) if remove else rows
    lost = kept.groupBy(*KEY).agg(F.count("*").alias("rows_clean")) if remove else spikes(rows, capped)
    m = audit(raw).join(counts, KEY, "left").join(lost, KEY, "left").join(max_speed(kept, "speed_after_kt"), KEY, "left")
    m = m.join(max_speed(rows, "speed_before_kt"), KEY, "left") if remove else m.withColumn("speed_before_kt", F.col("speed_after_kt"))
    m = m.fillna(0, ["duplicate_exact_count", "duplicate_timestamp_count", *lost.columns[len(KEY) :], "__n"])
    given, other = ("rows_clean", "isolated_spike_removed_count") if remove else ("isolated_spike_removed_count", "rows_clean")
    m = m.withColumn(other, F.col("__n") - F.col(given)).drop("__n")
    valid = F.coalesce(F.col("speed_after_kt") <= by_section(caps), F.lit(True))
    return kept, stage(m.withColumn("speed_valid", valid).withColumn("has_minimum_rows", F.col("rows_clean") >= by_section(LEAST_ROWS)))


def implied_kt(a: Column, b: Column) -> Column:
    """Speed from one position to a later one, null unless it is later."""
    km = geo.haversine_m(a["latitude"], a["longitude"], b["latitude"], b["longitude"], RADIUS_KM)
    return F.when(b["t"] > a["t"], km * geo.KM_TO_NM / ((b["t"] - a["t"]) / 3.6e9))


def boundaries(kept: DataFrame, window: int = QUARTER) -> DataFrame:
    """One row a segment: rows within ``window`` of the gap on each side, and the speeds from and to the sparse reports."""
    place, side = F.struct("t", "latitude", "longitude"), F.col("source_section")
    ends = kept.groupBy(*KEY).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min_by(place, "t").alias("first"), F.max_by(place, "t").alias("last"))
    near = kept.join(ends.select(*KEY, "a", "b"), KEY).where(((side == "before") & (F.col("t") >= F.col("b") - window)) | ((side == "after") & (F.col("t") <= F.col("a") + window)))
    near = near.groupBy("segment_id").agg(F.count_if(side == "before").alias("before_boundary_rows"), F.count_if(side == "after").alias("after_boundary_rows"))
    pick = lambda s, c: F.max(F.when(side == s, F.col(c))).alias(f"{s}_{c}")  # noqa: E731  one row a section
    e = ends.groupBy("segment_id").agg(pick("before", "last"), pick("adsc", "first"), pick("adsc", "last"), pick("after", "first"))
    e = e.select("segment_id", implied_kt(F.col("before_last"), F.col("adsc_first")).alias("before_anchor_kt"), implied_kt(F.col("adsc_last"), F.col("after_first")).alias("after_anchor_kt"))
    return e.join(near, "segment_id", "left").fillna(0, ["before_boundary_rows", "after_boundary_rows"])


def keep_drop(files: DataFrame, metrics: DataFrame, bounds: DataFrame, caps: dict[str, float] = CAPS_KT) -> DataFrame:
    """``step2_keep`` and the sorted reasons against each segment of ``files`` (segment_id, required, readable, columns_ok).

    The times of cleaned sections are in order by construction, so that the reason for disorder cannot come up.
    """
    here = lambda s, c: F.bool_or(F.when(F.col("source_section") == s, F.col(c)))
    m = metrics.groupBy("segment_id").agg(
        *[F.coalesce(here(s, "has_minimum_rows"), F.lit(False)).alias(f"enough_{s}") for s in ("before", "adsc", "after")],
        F.sum("invalid_coord_count").alias("n_invalid"), F.coalesce(here("adsc", "speed_valid"), F.lit(True)).alias("speed_ok"),
    )
    j = files.join(m, "segment_id", "left").join(bounds, "segment_id", "left")
    enough = reduce(lambda a, b: a & b, [F.coalesce(f"enough_{s}", F.lit(False)) for s in ("before", "adsc", "after")])
    why = [
        (~F.col("required"), "missing_required_file"), (~F.col("readable"), "unreadable_input"), (~F.col("columns_ok"), "schema_issue"), (~enough, "section_too_short_after_clean"),
        (F.col("n_invalid") > 0, "invalid_coordinate_values"), (~F.col("speed_ok"), "implausible_section_speed_after_clean"),
        ((F.col("before_anchor_kt") > caps["before"]) | (F.col("after_anchor_kt") > caps["after"]), "implausible_anchor_speed_after_clean"),
    ]
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in why])))
    return j.select("segment_id", (F.size(reasons) == 0).alias("step2_keep"), F.nullif(F.array_join(reasons, ";"), F.lit("")).alias("drop_reason"))


def section_issues(metrics: DataFrame, bounds: DataFrame, verdict: DataFrame, caps: dict[str, float] = CAPS_KT) -> DataFrame:
    """One row for each counter above zero and each flag that is up, with the flight's verdict."""
    side = F.col("source_section")
    of = lambda what: F.when(side == "before", F.col(f"before_{what}")).when(side == "after", F.col(f"after_{what}"))
    m = metrics.join(bounds, "segment_id", "left").withColumn("__cap", by_section(caps))
    row = lambda up, name, n, kt: F.when(up, F.struct(F.lit(name).alias("issue_type"), n.cast("long").alias("issue_count"), kt.cast("double").alias("issue_value_kts")))
    one, none = F.lit(1), F.lit(None)
    rows = [row(F.col(c) > 0, c, F.col(c), none) for c in COUNTERS] + [
        row(F.col("was_unsorted"), "rows_were_unsorted", one, none), row(~F.col("speed_valid"), "implausible_section_speed_after_clean", one, F.col("speed_after_kt")),
        row(of("anchor_kt") > F.col("__cap"), "implausible_anchor_speed_after_clean", one, of("anchor_kt")), row(of("boundary_rows") < 2, "boundary_too_sparse", one, none),
    ]
    return m.select(*KEY, F.explode(F.array_compact(F.array(*rows))).alias("i")).select(*KEY, "i.*").join(verdict, "segment_id", "left")


def resample_track(rows: DataFrame, keys: list[str], values: list[str], step: int, labels: dict[str, Column], drop: bool = True) -> DataFrame:
    """Rows on the grid that spans a track outward, numbers in time between known ones; ``drop``: only where there is a place.

    Tracks of one row, or whose grid has one place, stay as they are. ``rows`` has one row a key and time.
    """
    m = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("t").alias("__a"), F.max("t").alias("__b"))
    wide = (F.col("__n") >= 2) & (F.floor(F.col("__a") / step) < F.ceil(F.col("__b") / step))
    long = rows.join(m.where(wide).select(*keys), keys, "left_semi")
    same = rows.join(m.where(~wide).select(*keys), keys, "left_semi").select(*keys, "t", *values)
    grid = resample(long, keys, values, step, True)
    if drop:
        grid = grid.dropna(subset=["latitude", "longitude"])
    return grid.select(*keys, "t", *values).unionByName(same).withColumns(labels)


def resample_sections(rows: DataFrame, keys: list[str], values: list[str], step: int, labels: list[str], order: list[str]) -> DataFrame:
    """`resample_track` for each section, with the first known value of each of ``labels`` in its order; a section without one has none."""
    first = rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in labels])
    one = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "t").orderBy(*[c for c in order if c != "t"]))).where("__r = 1")
    return resample_track(one.select(*keys, "t", *values), keys, values, step, {}).join(first, keys)
