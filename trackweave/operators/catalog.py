"""Catalogues of segments: audits, ranking of runs, issues, trends, padding and densifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .ranges import points_within


def parse_time(text: Column) -> Column:
    """Epoch seconds of a text: a number, or a date and time with '-' or '/', ' ' or 'T', with or without 'Z'; else null."""
    plain = F.regexp_replace(F.translate(text, "T/", " -"), "Z", "")
    stamp = F.unix_seconds(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(F.floor(text.try_cast("double")), stamp)


def epoch_unit(median: Column) -> Column:
    """The unit that a column of epochs is in, by its median magnitude."""
    return F.when(median >= 1e17, "ns").when(median >= 1e14, "us").when(median >= 1e11, "ms").otherwise("s")


def rank_runs(rows: DataFrame, key: list[str], counts: list[str], tie: str) -> DataFrame:
    """``rn``: place of a row among those of one key, most points first (null counts are zero)."""
    size = sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(size.desc(), tie)))


def stored_rows() -> Column:
    """Rows of all parts of a saved segment; null counts are zero."""
    return sum((F.coalesce(f"{c}_rows", F.lit(0)) for c in COUNTED), F.lit(0))


def rank_master(rows: DataFrame) -> DataFrame:
    """``duplicate_rank`` within a dedup_key (1: master), and whether the key has several rows.

    Listed in the summary first, then with metadata, then by run, then most rows, then by segment (null counts are zero).
    """
    w = Window.partitionBy("dedup_key")
    order = [F.desc("summary_present"), F.desc("metadata_present"), F.asc_nulls_last("source_run"), stored_rows().desc(), F.asc("segment_id")]
    return rows.withColumn("duplicate_rank", F.row_number().over(w.orderBy(*order))).withColumn("is_master_record", F.col("duplicate_rank") == 1).withColumn("is_duplicate", F.count("*").over(w) > 1)


# Fixed values.
REQUIRED_FILES = ["adsc.parquet", "adsb_before.parquet", "adsb_after.parquet", "stitched_minimal.parquet", "metadata.json"]
COUNTED = ["adsc", "adsb_before", "adsb_after", "stitched"]


def run_audit(runs: DataFrame, saved: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved segments of all runs with what is known of them, and the issues of runs and segments.

    ``runs`` (source_run, has_flights); ``saved`` (source_run, segment_id, files, metadata_segment_id, metadata_error,
    metadata_is_valid and the four ``*_rows``, null where unread); ``summary`` (source_run, segment_id). A segment
    counts as valid if all files are there, the metadata is read and valid, and no part is empty.
    """
    key = ["source_run", "segment_id"]
    listed = summary.where("segment_id IS NOT NULL").select(*key).distinct()
    lost = F.array_except(F.array(*map(F.lit, REQUIRED_FILES)), F.coalesce("files", F.array().cast("array<string>")))
    a = saved.join(listed.withColumn("summary_present", F.lit(True)), key, "left").fillna(False, ["summary_present"])
    a = a.withColumn("metadata_present", F.col("metadata_error").isNull()).withColumn("missing_required_files", F.array_join(lost, ", "))
    full = F.lit(True)
    for c in COUNTED:
        full = full & F.coalesce(F.col(f"{c}_rows") > 0, F.lit(False))
    a = a.withColumn("valid_saved_folder", (F.col("missing_required_files") == "") & F.col("metadata_present") & F.coalesce("metadata_is_valid", F.lit(False)) & full)
    found = [
        (~F.col("summary_present"), "saved_folder_missing_from_summary", F.col("segment_id")), (F.col("missing_required_files") != "", "missing_required_files", F.col("missing_required_files")),
        (~F.col("metadata_present"), "metadata_read_error", F.col("metadata_error")),
        (F.col("metadata_present") & ~F.col("metadata_segment_id").eqNullSafe(F.col("segment_id")), "metadata_segment_id_mismatch", F.concat(F.lit("metadata_segment_id="), F.coalesce("metadata_segment_id", F.lit("None")))),
    ] + [(F.col(f"{c}_rows") <= 0, f"empty_{c}_file", F.concat(F.lit(f"{c}_rows="), F.col(f"{c}_rows"))) for c in COUNTED]
    rows = F.array(*[F.when(up, F.struct(F.lit(name).alias("issue_type"), text.alias("details"))) for up, name, text in found])
    issues = a.select(*key, F.explode(F.array_compact(rows)).alias("i")).select(*key, "i.*")
    gone = listed.join(saved.select(*key), key, "left_anti").select(*key, F.lit("summary_row_missing_saved_folder").alias("issue_type"), F.col("source_run").alias("details"))
    bare = runs.where(~F.col("has_flights")).select("source_run", F.lit(None).cast("string").alias("segment_id"), F.lit("missing_flights_directory").alias("issue_type"), F.col("source_run").alias("details"))
    return a, issues.unionByName(gone).unionByName(bare)


def integrity_issues(summary: DataFrame, saved: DataFrame) -> DataFrame:
    """(segment_id, issue) where a summary and the saved segments differ, or a saved part is empty."""
    j = summary.select("segment_id", F.lit(True).alias("listed")).join(saved.select("segment_id", "n_before", "n_after", F.lit(True).alias("saved")), "segment_id", "full")
    issues = [
        (F.col("listed").isNull(), "saved_folder_missing_from_summary"), (F.col("saved").isNull(), "summary_row_missing_saved_folder"),
        (F.col("n_before") == 0, "empty_adsb_before_file"), (F.col("n_after") == 0, "empty_adsb_after_file"),
    ]
    return j.select("segment_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in issues]))).alias("issue"))


def quality_issues(counted: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """One row for each counter above zero."""
    return counted.unpivot([key], counters, "issue_type", "issue_count").where("issue_count > 0")


def halves_trend(periods: DataFrame, period: str, value: str, factor: float = 1.3, least: int = 4) -> DataFrame:
    """Means of the first and the last half of the periods (a middle one counts in neither), and whether they rise.

    ``periods`` has one row a period and so is small: it is numbered in one task.
    """
    w = Window.orderBy(period)
    x = periods.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    half = F.floor(F.col("n") / 2)
    m = x.agg(F.max("n").alias("n"), F.avg(F.when(F.col("rn") <= half, F.col(value))).alias("first_half"), F.avg(F.when(F.col("rn") > F.col("n") - half, F.col(value))).alias("last_half"))
    return m.withColumn("rises", F.coalesce((F.col("n") >= least) & (F.col("last_half") > factor * F.col("first_half")), F.lit(False)))


def last_before(dense: DataFrame, segments: DataFrame, context: int, length: int) -> DataFrame:
    """The last ``length`` dense points before each segment, padded on the left: the latest is at ``length`` - 1."""
    j = points_within(segments.select("segment_id", "icao24", "s0"), dense, F.col("s0") - context, F.col("s0"), ["event_id", "t"])
    rn = F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("t"), F.desc("event_id")))
    return j.withColumn("rn", rn).where(F.col("rn") <= length).withColumn("position", length - F.col("rn"))


def densify(points: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Points about one a ``step`` along the great circles between neighbours; ``arc`` is the event it starts at.

    Arcs without time or length are left out; only the first arc of a track has its own start.
    """
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    n = F.lead(F.struct("t", "latitude", "longitude")).over(w)
    a = points.select(*keys, "event_id", "t", F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"), F.row_number().over(w).alias("rn"), n["t"].alias("t1"), n["latitude"].alias("lat1"), n["longitude"].alias("lon1"))
    a = a.where("t1 > t AND (lat1 <> lat0 OR lon1 <> lon0)").withColumn("n", F.greatest(F.lit(1), F.floor((F.col("t1") - F.col("t")) / step)))
    a = a.withColumn("i", F.explode(F.sequence(F.when(F.col("rn") == 1, 0).otherwise(1).cast("long"), F.col("n").cast("long"))))
    lat, lon = geo.great_circle(*map(F.col, ("lat0", "lon0", "lat1", "lon1")), F.col("i") / F.col("n"))
    return a.select(*keys, F.col("event_id").alias("arc"), "i", lat.alias("latitude"), lon.alias("longitude"))
