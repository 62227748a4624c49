"""Saved runs: sections of segments and their metadata in folders, found again by listing, and the master build over all runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from .windows import read_if_there

SECTIONS = ("adsc", "adsb_before", "adsb_after", "stitched")
_FILE = {"adsc": "adsc.parquet", "adsb_before": "adsb_before.parquet", "adsb_after": "adsb_after.parquet", "stitched": "stitched_minimal.parquet"}
_META = "segment_id string, icao24 string, s0 long, s1 long, is_valid boolean, files map<string, long>"
#: Names of the catalogues of a master build (fixed values).
CATALOGUES = ("all_saved_flight_folders", "valid_saved_flights", "duplicates", "master_flights_catalog", "integrity_issues", "raw_summary_merged")


def write_run(root: str, run: str, sections: DataFrame, metadata: DataFrame, summary: DataFrame | None) -> None:
    """One run below ``root``, in folders flights, metadata and summary: ``sections`` (segment_id, day, section, columns) in a folder a day and section, metadata as JSON lines by day.

    A day's segments lie together, sorted, and not in a folder each: at many segments small files would be what a read costs.
    ``metadata``: segment_id, day, icao24, s0, s1, is_valid, files (rows by section).
    """
    sections.repartition("day", "section").sortWithinPartitions("segment_id").write.partitionBy("day", "section").parquet(f"{root}/flights/source_run={run}")
    line = F.to_json(F.struct("segment_id", "icao24", "s0", "s1", "is_valid", "files"))
    metadata.select("day", line.alias("value")).repartition("day").write.partitionBy("day").text(f"{root}/metadata/source_run={run}")
    if summary is not None:
        summary.write.parquet(f"{root}/summary/source_run={run}")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(source_run, part, day, section, files, bytes) of all that lies below ``root``, by listing; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    found = lambda p: F.nullif(F.regexp_extract("path", p, 1), F.lit(""))
    named = files.select(found("/source_run=([^/]*)/").alias("source_run"), found("/([^/]*)/source_run=").alias("part"), found("/day=([^/]*)/").alias("day"), found("/section=([^/]*)/").alias("section"), "size")
    return named.groupBy("source_run", "part", "day", "section").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def runs_found(spark: SparkSession, root: str) -> DataFrame:
    """(source_run, has_flights), in order of names."""
    return discover(spark, root).groupBy("source_run").agg(F.bool_or(F.col("part") == "flights").alias("has_flights")).orderBy("source_run")


def _of_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The tables of all runs below ``path``, with the run of each row; empty if no run has one."""
    return read_if_there(spark, path, f"{schema}, source_run string")


def saved_segments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What the listing and the tables tell of every saved segment, as `run_audit` takes it.

    A section counts as there if it has rows or the metadata tells of it; where the metadata is gone, only by its rows.
    """
    counts = _of_runs(spark, f"{root}/flights", schema).groupBy("source_run", "segment_id").pivot("section", list(SECTIONS)).count()
    lines = spark.read.text(f"{root}/metadata")
    meta = lines.select("source_run", F.from_json("value", _META).alias("m")).select("source_run", F.col("m.segment_id").alias("metadata_segment_id"), "m.icao24", "m.s0", "m.s1", F.col("m.is_valid").alias("metadata_is_valid"), F.col("m.files").alias("told"))
    # the segment that a line belongs to is the one whose name its own begins with; a wrong name differs in what follows
    keyed = meta.withColumn("segment_id", F.regexp_extract("metadata_segment_id", r"^(\d{8}_[^_]*_\d{6}_\d{6})", 1))
    j = counts.join(keyed, ["source_run", "segment_id"], "left")
    rows = {s: F.coalesce(F.col(s), F.element_at("told", F.lit(s)) * 0) for s in SECTIONS}
    there = F.array(*[F.when(rows[s].isNotNull(), _FILE[s]) for s in SECTIONS], F.when(F.col("told").isNotNull(), "metadata.json"))
    return j.select(
        "source_run", "segment_id", "icao24", "s0", "s1", F.array_compact(there).alias("files"), "metadata_segment_id", "metadata_is_valid",
        F.when(F.col("told").isNull(), "metadata.json missing").alias("metadata_error"), *[rows[s].alias(f"{s}_rows") for s in SECTIONS],
    )


def build_master(spark: SparkSession, root: str, out: str, schema: str) -> str:
    """All six catalogues, the winners' sections and the totals as a new version below ``out``; readers see it all at once.

    The version is written whole, then one row of the manifest names it: `published` gives the newest that is named.
    """
    saved = saved_segments(spark, root, schema)
    summary = _of_runs(spark, f"{root}/summary", "segment_id string, n_points long")
    audit, issues = C.run_audit(runs_found(spark, root), saved, summary)
    version = f"{out}/versions/{uuid.uuid4().hex}"
    path = lambda name: f"{version}/catalog/{name}"
    audit.write.parquet(path("all_saved_flight_folders"))
    audit = spark.read.parquet(path("all_saved_flight_folders"))
    ranked = C.rank_master(audit.where("valid_saved_folder").withColumn("dedup_key", F.concat_ws("|", "icao24", "s0", "s1")))
    ranked.write.parquet(path("valid_saved_flights"))
    ranked = spark.read.parquet(path("valid_saved_flights"))
    ranked.where("is_duplicate").write.parquet(path("duplicates"))
    ranked.where("is_master_record").write.parquet(path("master_flights_catalog"))
    issues.write.parquet(path("integrity_issues"))
    summary.write.parquet(path("raw_summary_merged"))
    master = spark.read.parquet(path("master_flights_catalog")).select("source_run", "segment_id")
    won = _of_runs(spark, f"{root}/flights", schema).join(master, ["source_run", "segment_id"], "left_semi")
    won.repartition("day", "section").sortWithinPartitions("segment_id").write.partitionBy("day", "section").parquet(f"{version}/flights")
    totals(spark, version).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{version}/audit_summary")
    manifest = spark.createDataFrame([(version,)], "version string").withColumn("published_at", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{out}/manifest")
    return version


def totals(spark: SparkSession, version: str) -> DataFrame:
    """One row: what a build has found, and by run."""
    t = {name: spark.read.parquet(f"{version}/catalog/{name}") for name in CATALOGUES}
    audit, valid = t["all_saved_flight_folders"], t["valid_saved_flights"]
    runs = audit.groupBy("source_run").agg(F.count("*").alias("raw_saved_flight_folders"), F.count_if("valid_saved_folder").alias("valid_saved_flights"))
    parts = [
        audit.agg(F.count("*").alias("raw_saved_flight_folders_found")), valid.agg(F.count("*").alias("valid_saved_flights_found"), F.count_if(F.col("duplicate_rank") > 1).alias("duplicate_records_found"), F.count_if(F.col("is_duplicate") & F.col("is_master_record")).alias("duplicate_groups_found"), F.count_if("is_master_record").alias("final_unique_master_flights")),
        t["integrity_issues"].agg(F.count("*").alias("integrity_issue_records")), runs.agg(F.array_sort(F.collect_list(F.struct("source_run", "raw_saved_flight_folders", "valid_saved_flights"))).alias("source_runs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def published(spark: SparkSession, out: str) -> str | None:
    """The version that readers take: the newest that the manifest names."""
    rows = read_if_there(spark, f"{out}/manifest", "version string, published_at timestamp")
    r = rows.orderBy(F.desc("published_at"), "version").first()
    return r["version"] if r else None


def catalogue(spark: SparkSession, out: str, *names: str) -> DataFrame:
    """The first of the catalogues ``names`` that the published version has: a validated one, else the one it falls back to."""
    version = published(spark, out)
    if version is not None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{version}/catalog").select(F.regexp_extract(F.col("_metadata.file_path"), "/catalog/([^/]*)/", 1).alias("name")).distinct()
        there = {r["name"] for r in listed.where(F.col("name").isin(*names)).collect()}  # at most the names asked for
        for name in names:
            if name in there:
                return spark.read.parquet(f"{version}/catalog/{name}")
    raise FileNotFoundError(f"no published catalogue of {json.dumps(names)}")
