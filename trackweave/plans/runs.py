"""Queries over saved runs: written, found again by listing, built into a master, resumed after a break."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranges import points_within
from ..sources import runs as R
from ..sources.reports import points, reports
from ..sources.tables import shared_folder, stage
from ..sources.windows import Windows
from .queries import CONTEXT, HOUR, KEY, _pts, _screen, _seg, query

_ROW = "segment_id string, event_id long, t long, day string, section string"  # the run of a row is told by its folder


def _saved(spark, d) -> str:
    """Three runs with planted faults, and a fourth that has a summary only; some segments are in two runs."""
    root = shared_folder(spark)
    seg = stage(_screen(spark, d).join(_seg(spark, d).select("segment_id", "n_points", "s0", "s1"), "segment_id").withColumn("day", F.substring("segment_id", 1, 8)))
    seq = F.col("seq")
    saved = seg.where(seq % 5 != 2)
    near = points_within(saved.select("segment_id", "icao24", "s0", "s1"), points(spark, d, "adsb"), F.col("s0") - CONTEXT, F.col("s1") + CONTEXT, ["event_id", "t"]).where("t < s0 OR t > s1")
    near = near.select("segment_id", "event_id", "t", F.when(F.col("t") < F.col("s0"), "adsb_before").otherwise("adsb_after").alias("section"))
    own = _pts(spark, d).join(saved.select("segment_id", *KEY), KEY).select("segment_id", "event_id", "t", F.lit("adsc").alias("section"))
    parts = own.unionByName(near)
    parts = stage(parts.unionByName(parts.withColumn("section", F.lit("stitched"))).join(saved.select("segment_id", "seq", "day"), "segment_id").where((F.col("section") != "adsb_after") | (seq % 6 != 5)))
    files = F.map_filter(F.create_map(F.lit("adsc"), F.col("n_points"), F.lit("adsb_before"), F.col("n_before"), F.lit("adsb_after"), F.when(seq % 6 != 5, F.col("n_after")), F.lit("stitched"), F.col("n_points") + F.col("n_before") + F.col("n_after")), lambda k, v: v.isNotNull())
    meta = saved.where(seq % 7 != 3).select("seq", F.concat("segment_id", F.when(seq % 4 == 3, "x").otherwise("")).alias("segment_id"), "day", "icao24", "s0", "s1", (seq % 5 != 4).alias("is_valid"), files.alias("files"))
    listed = seg.where(seq % 4 != 1)
    for run in range(3):
        here = (seq % 3 == run) | (F.lit(run == 1) & (seq % 6 == 0))
        R.write_run(root, f"step1_raw_{run}", parts.where(here).drop("seq"), meta.where(here), listed.where(seq % 3 == run).select("segment_id", "n_points"))
    listed.where("false").select("segment_id", "n_points").write.parquet(f"{root}/summary/source_run=step1_raw_9")
    return root


_FAULTS = """, own AS (SELECT *, seq % 3 AS run FROM screen JOIN seg USING (segment_id, icao24, seq) WHERE seq % 5 <> 2), both_ AS (SELECT * FROM own UNION ALL SELECT * REPLACE (1 AS run) FROM own WHERE seq % 6 = 0),
saved AS (SELECT 'step1_raw_' || run AS source_run, segment_id, seq, icao24, s0, s1, substr(segment_id, 1, 8) AS day, seq % 7 = 3 AS torn, seq % 5 <> 4 AS ok, n_points AS adsc_rows, CASE WHEN n_before > 0 OR seq % 7 <> 3 THEN n_before END AS adsb_before_rows,
 CASE WHEN seq % 6 <> 5 AND (n_after > 0 OR seq % 7 <> 3) THEN n_after END AS adsb_after_rows, n_points + n_before + n_after AS stitched_rows FROM both_),
listed AS (SELECT 'step1_raw_' || (seq % 3) AS source_run, segment_id FROM seg WHERE seq % 4 <> 1),
aud AS (SELECT s.*, l.segment_id IS NOT NULL AS summary_present, concat_ws(', ', CASE WHEN adsb_before_rows IS NULL THEN 'adsb_before.parquet' END, CASE WHEN adsb_after_rows IS NULL THEN 'adsb_after.parquet' END, CASE WHEN torn THEN 'metadata.json' END) AS missing FROM saved s LEFT JOIN listed l ON l.source_run = s.source_run AND l.segment_id = s.segment_id),
good AS (SELECT *, icao24 || '|' || s0 || '|' || s1 AS dedup_key FROM aud WHERE missing = '' AND NOT torn AND ok AND adsc_rows > 0 AND adsb_before_rows > 0 AND adsb_after_rows > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY summary_present DESC, source_run, adsc_rows + adsb_before_rows + adsb_after_rows + stitched_rows DESC, segment_id) AS rank, count(*) OVER (PARTITION BY dedup_key) AS n FROM good),
bad AS (SELECT source_run, segment_id, unnest([CASE WHEN NOT summary_present THEN 'saved_folder_missing_from_summary' END, CASE WHEN missing <> '' THEN 'missing_required_files' END, CASE WHEN torn THEN 'metadata_read_error' END, CASE WHEN NOT torn AND seq % 4 = 3 THEN 'metadata_segment_id_mismatch' END,
 CASE WHEN adsb_before_rows = 0 THEN 'empty_adsb_before_file' END, CASE WHEN adsb_after_rows = 0 THEN 'empty_adsb_after_file' END]) AS issue FROM aud
 UNION ALL SELECT source_run, segment_id, 'summary_row_missing_saved_folder' FROM listed l WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.source_run = l.source_run AND s.segment_id = l.segment_id) UNION ALL SELECT 'step1_raw_9', NULL, 'missing_flights_directory'),
issues AS (SELECT * FROM bad WHERE issue IS NOT NULL)
"""


@query(_FAULTS + """SELECT source_run, section, count(DISTINCT day) AS days FROM (SELECT source_run, day, unnest(['adsc', 'stitched', CASE WHEN adsb_before_rows > 0 THEN 'adsb_before' END, CASE WHEN adsb_after_rows > 0 THEN 'adsb_after' END]) AS section FROM saved) WHERE section IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'step1_raw_9', NULL, 0""")
def run_discovery(spark, d):
    """What a listing finds of each run: days by section; a run without flights has none."""
    root = _saved(spark, d)
    found = R.discover(spark, root).where("part = 'flights'").groupBy("source_run", "section").agg(F.countDistinct("day").alias("days"))
    return R.runs_found(spark, root).select("source_run").join(found, "source_run", "left").fillna(0, ["days"])


_T = "CAST(NULL AS VARCHAR) AS source_run"


@query(_FAULTS + f"""SELECT 'all_saved_flight_folders' AS catalogue, source_run, segment_id, missing AS detail FROM aud UNION ALL SELECT 'valid_saved_flights', source_run, segment_id, CAST(rank AS VARCHAR) FROM ranked
 UNION ALL SELECT 'duplicates', source_run, segment_id, CAST(rank AS VARCHAR) FROM ranked WHERE n > 1 UNION ALL SELECT 'master_flights_catalog', source_run, segment_id, dedup_key FROM ranked WHERE rank = 1
 UNION ALL SELECT 'integrity_issues', source_run, segment_id, issue FROM issues UNION ALL SELECT 'raw_summary_merged', source_run, segment_id, NULL FROM listed
 UNION ALL SELECT 'audit_summary', NULL, k, CAST(v AS VARCHAR) FROM (SELECT 'raw_saved_flight_folders_found' AS k, (SELECT count(*) FROM aud) AS v UNION ALL SELECT 'valid_saved_flights_found', (SELECT count(*) FROM good) UNION ALL SELECT 'duplicate_records_found', (SELECT count(*) FROM ranked WHERE rank > 1)
 UNION ALL SELECT 'duplicate_groups_found', (SELECT count(*) FROM ranked WHERE rank = 1 AND n > 1) UNION ALL SELECT 'final_unique_master_flights', (SELECT count(*) FROM ranked WHERE rank = 1) UNION ALL SELECT 'integrity_issue_records', (SELECT count(*) FROM issues))""")
def master_build(spark, d):
    """The six catalogues and the totals of a master build over all runs, as its readers find them."""
    root, out = _saved(spark, d), shared_folder(spark)
    version = R.build_master(spark, root, out, _ROW)
    detail = {"all_saved_flight_folders": "missing_required_files", "valid_saved_flights": "duplicate_rank", "duplicates": "duplicate_rank", "master_flights_catalog": "dedup_key", "integrity_issues": "issue_type"}
    rows = None
    for name in R.CATALOGUES:
        t = R.catalogue(spark, out, name).select(F.lit(name).alias("catalogue"), "source_run", "segment_id", (F.col(detail[name]).cast("string") if name in detail else F.lit(None).cast("string")).alias("detail"))
        rows = t if rows is None else rows.unionByName(t)
    pairs = F.explode(F.from_json("value", "map<string, string>")).alias("segment_id", "detail")
    told = spark.read.text(f"{version}/audit_summary").select(F.lit("audit_summary").alias("catalogue"), F.lit(None).cast("string").alias("source_run"), pairs).where("segment_id <> 'source_runs'")
    return rows.unionByName(told)


@query(_FAULTS + "SELECT segment_id, unnest(['adsc', 'adsb_before', 'adsb_after', 'stitched']) AS section, unnest([adsc_rows, adsb_before_rows, adsb_after_rows, stitched_rows]) AS n FROM ranked WHERE rank = 1")
def master_published(spark, d):
    """Sections of the winners as published; a later build that broke before its manifest row is not seen, and a catalogue that is not there falls back to one that is."""
    root, out = _saved(spark, d), shared_folder(spark)
    R.build_master(spark, root, out, _ROW)
    spark.createDataFrame([("broken",)], "segment_id string").write.parquet(f"{out}/versions/broken/catalog/master_flights_catalog")
    rows = spark.read.schema(_ROW).parquet(f"{R.published(spark, out)}/flights")
    return rows.join(R.catalogue(spark, out, "validated_flights", "master_flights_catalog").select("segment_id"), "segment_id", "left_semi").groupBy("segment_id", "section").agg(F.count("*").alias("n"))


_WIN = 240 * HOUR


@query(f"SELECT event_id, t // {_WIN} AS window_nr FROM adsc")
def windows_resumed(spark, d):
    """Reports by windows of ten days: one finished, one broken off half way, the rest and the broken one done on resuming."""
    store = Windows(spark, shared_folder(spark))
    rows = points(spark, d, "adsc").select("event_id", F.floor(F.col("t") / _WIN).cast("string").alias("window"))
    names = [r["window"] for r in rows.agg(F.array_sort(F.collect_set("window")).alias("w")).select(F.explode(F.slice("w", 1, 2)).alias("window")).collect()]
    if names:
        store.write(rows.where(F.col("window") == names[0]))
        store.write(rows.where((F.col("window") == names[-1]) & (F.col("event_id") % 2 == 0)), finish=False)
    store.write(store.todo(rows))
    return store.read(rows).select("event_id", F.col("window").cast("long").alias("window_nr"))


@query("SELECT segment_id FROM seg WHERE CAST(substr(segment_id, 8, 1) AS INTEGER) % 4 <> 3")
def resume_antijoin(spark, d):
    """Segments of the days that an earlier run has not finished, as its manifest tells."""
    store = Windows(spark, shared_folder(spark))
    rows = _seg(spark, d).select("segment_id", F.substring("segment_id", 1, 8).alias("window"))
    store.write(rows.where(F.substring("window", 8, 1).cast("int") % 4 == 3))
    return store.todo(rows).select("segment_id")


@query("SELECT kind, count(*) AS n FROM proj GROUP BY kind")
def cached_result(spark, d):
    """A result that is computed once: the second reader finds it."""
    store = Windows(spark, shared_folder(spark))

    def make():
        return reports(spark, d).groupBy("kind").agg(F.count("*").alias("n"))

    def never():
        raise AssertionError("the result was there")

    first = store.cached("kinds", make, "kind string, n long")
    return first if first.isEmpty() else store.cached("kinds", never, "kind string, n long")

