"""Queries that write tables or read streams, and give what can be read afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources import tables as T
from ..sources.reports import points, reports
from ..streaming import live as L
from ..streaming import stateful as W
from ..streaming import tables as Y
from .queries import _ERR, GAP, HOUR, _pts, _seg, query
from .reconstruct import _base
from .sections import _SAVED, _runs

_SEG = "segment_id, icao24, seq, s0, s1, n_points"


@query(f"SELECT {_SEG}, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN '' ELSE 'a,\"b\"' END AS note, format FROM seg, (SELECT unnest(['parquet', 'csv']) AS format)")
def sink_roundtrip(spark, d):
    """Segments written in both formats and read again, with nulls, empty texts and quotes."""
    note = F.when(F.col("seq") % 3 == 1, "").when(F.col("seq") % 3 == 2, 'a,"b"')
    rows = _seg(spark, d).select(*_SEG.split(", "), note.alias("note"))
    parquet, csv = T.write_twins(rows, T.shared_folder(spark))
    return parquet.withColumn("format", F.lit("parquet")).unionByName(csv.withColumn("format", F.lit("csv")))


@query("SELECT event_id, CASE seq % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM pts WHERE seq % 3 < 2")
def ml_points_by_split(spark, d):
    """Rows written by split; a read of two of them reads no others."""
    path = T.shared_folder(spark)
    split = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("seq") % 3 + 1).cast("int"))
    T.overwrite_parts(_pts(spark, d).select("event_id", split.alias("split")), path, ["split"])
    return spark.read.schema("event_id long, split string").parquet(path).where(F.col("split").isin("train", "val"))


@query("SELECT substr(segment_id, 1, 8) AS day, segment_id, CASE WHEN substr(segment_id, 8, 1) = '5' THEN 2 ELSE 1 END AS version FROM seg")
def day_overwrite(spark, d):
    """All days written, some written again, twice: their rows are replaced, the others stay."""
    path = T.shared_folder(spark)
    rows = _seg(spark, d).select(F.substring("segment_id", 1, 8).alias("day"), "segment_id")
    T.overwrite_parts(rows.withColumn("version", F.lit(1)), path, ["day"])
    again = rows.where(F.substring("day", 8, 1) == "5").withColumn("version", F.lit(2))
    T.overwrite_parts(again, path, ["day"])
    return T.overwrite_parts(again, path, ["day"])


@query("SELECT segment_id FROM seg WHERE seq % 4 <> 1")
def validated_catalog(spark, d):
    """Segments that are not on a list of outliers, read as CSV."""
    path = T.shared_folder(spark)
    _seg(spark, d).where("seq % 4 = 1").select("segment_id", F.lit("far off").alias("reason")).write.option("header", True).csv(path)
    listed = spark.read.schema("segment_id string, reason string").option("header", True).csv(path)
    return _seg(spark, d).select("segment_id").join(listed.where("segment_id IS NOT NULL"), "segment_id", "left_anti")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 10000", cte=False)
def scan_limit(spark, d):
    """The first rows by id, as many as were asked for."""
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id").orderBy("event_id").limit(10_000)


@query("SELECT column_name FROM (DESCRIBE events)", cte=False)
def describe_source(spark, d):
    """Names of the columns of a table."""
    return spark.createDataFrame([(f.name,) for f in spark.read.parquet(f"{d}/events.parquet").schema], "column_name string")


@query(f"SELECT s.segment_id, CASE WHEN s.seq % 3 = 2 THEN 'test' ELSE 'other' END AS split, count(*) AS n, round(avg(error_m) / 1000, 5) AS mean_km FROM ({_ERR}) e JOIN seg s USING (segment_id) GROUP BY s.segment_id, s.seq")
def baseline_by_split(spark, d):
    """Error of each flight, with its split."""
    e = _base(spark, d).groupBy("segment_id", "seq").agg(F.count("*").alias("n"), F.round(F.avg("error_m") / 1000, 5).alias("mean_km"))
    return e.select("segment_id", F.when(F.col("seq") % 3 == 2, "test").otherwise("other").alias("split"), "n", "mean_km")


# streams


def _stream(spark, d):
    path = f"{d}/events.parquet"  # a file or a folder: a pattern lets a stream take both
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").withColumn("time", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "time")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1", cte=False)
def stream_days(spark, d):
    """Events taken day by day from a stream."""
    out = T.shared_folder(spark)
    rows = Y.stream_by_day(_stream(spark, d), F.date_format("time", "yyyyMMdd"), f"{out}/rows", f"{out}/state")
    return rows.groupBy(F.date_format("time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events", cte=False)
def stream_dedup(spark, d):
    """Events of a stream that brings some of them twice."""
    out, e = T.shared_folder(spark), _stream(spark, d)
    return Y.stream_first(e.unionByName(e.where("event_id % 10 = 0")), ["event_id"], "time", f"{out}/rows", f"{out}/state").select("event_id")


@query("SELECT epoch_us(ts) // 90000000 AS window_nr, count(*) AS n FROM events GROUP BY 1", cte=False)
def stream_polls(spark, d):
    """Counts in windows of 90 seconds."""
    out = T.shared_folder(spark)
    counts = _stream(spark, d).groupBy(F.window("time", "90 seconds").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
    return Y.stream_latest(counts, ["start"], f"{out}/rows", f"{out}/state").select(F.floor(F.unix_seconds("start") / 90).alias("window_nr"), "n")


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL", cte=False)
def stream_months(spark, d):
    """Counts by month and kind, updated as the stream goes on."""
    out = T.shared_folder(spark)
    counts = _stream(spark, d).groupBy(F.date_format("time", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))
    return Y.stream_latest(counts, ["month", "event_type"], f"{out}/rows", f"{out}/state")


_LATE = 4 * HOUR


@query(f"SELECT icao24, s0, s1, n_points, lat0, lon0, lat1, lon1 FROM seg WHERE s1 + {GAP} < (SELECT max(t) // 1000 * 1000 FROM adsc) - {_LATE}")
def stream_segments(spark, d):
    """Segments as a stream in two runs; sessions over the midnight between them are given once, by the second."""
    out = T.shared_folder(spark)
    rows = points(spark, d, "adsc").select("icao24", "event_id", "t", "latitude", "longitude", F.col("ts").cast("timestamp").alias("time"))
    ends = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    midnight = ((ends.a or 0) + (ends.b or 0)) // 2 // (24 * HOUR) * 24 * HOUR
    for run in (F.col("t") < midnight, F.col("t") >= midnight):
        rows.where(run).write.mode("append").parquet(f"{out}/reports")
        got = W.stream_segments(spark.readStream.schema(rows.schema).parquet(f"{out}/reports"), GAP, f"{out}/segments", f"{out}/state")
    return got


@query(_SAVED + f"SELECT dedup_key, segment_id, source_run, summary_present, metadata_present FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY summary_present DESC, metadata_present DESC, source_run, adsc_rows + adsb_before_rows + coalesce(adsb_after_rows, 0) + stitched_rows DESC, segment_id) AS rank FROM (SELECT *, icao24 || '|' || (s0 // {240 * HOUR}) AS dedup_key FROM aud)) WHERE rank = 1")
def stream_master(spark, d):
    """The best saved segment of each key, of segments that come run by run."""
    out = T.shared_folder(spark)
    saved = _runs(spark, d)[0].withColumn("dedup_key", F.concat_ws("|", "icao24", F.floor(F.col("s0") / (240 * HOUR)))).select("dedup_key", "segment_id", "source_run", "summary_present", "metadata_present", C.stored_rows().alias("size"))
    saved = T.stage(saved)
    order = [~F.col("summary_present"), ~F.col("metadata_present"), F.col("source_run").isNull(), F.col("source_run"), -F.col("size"), F.col("segment_id")]
    for run in ("2", "0", "1"):  # the best does not come first
        saved.where(F.col("source_run").endswith(run)).write.mode("append").parquet(f"{out}/saved")
        best = W.stream_best(spark.readStream.schema(saved.schema).parquet(f"{out}/saved"), "dedup_key", order, f"{out}/best", f"{out}/state")
    return best.drop("size")


_POLLS = f"""seen AS (SELECT p.*, t // 90000000 + 1 + k AS poll FROM proj p, (SELECT unnest([0, 1]) AS k)),
newest AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY poll, icao24 ORDER BY t DESC, event_id DESC) = 1)"""


@query(f""", {_POLLS} SELECT poll, icao24, CAST(round(altitude_m * 3.28084e0) AS BIGINT) AS alt_ft, CAST(round(velocity_mps * 1.94384e0) AS BIGINT) AS vel_kts FROM (SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN altitude_m - 50 ELSE altitude_m END AS altitude_m) FROM newest)
 WHERE poll % 50 <> 0 AND event_id % 11 <> 0 AND event_id % 17 <> 0 AND latitude BETWEEN 51 AND 57 AND longitude BETWEEN -60 AND -20 AND altitude_m >= 9500 AND velocity_mps >= 210 AND poll * 90 - t // 1000000 <= 90""")
def stream_live(spark, d):
    """Live positions polled from a source that fails at times, keeps old ones and knows some places or heights not."""
    out, e = T.shared_folder(spark), F.col("event_id")
    rows = reports(spark, d).withColumns({"callsign": F.concat(F.lit("FL "), e.cast("string"), F.lit(" ")), "on_ground": e % 11 == 0, "baro_m": F.col("altitude_m") - 50, "altitude_m": F.when(e % 13 != 0, F.col("altitude_m")), "latitude": F.when(e % 17 != 0, F.col("latitude"))})
    L.write_snapshots(rows, f"{out}/polls")
    first, last = L.poll_range(rows)
    spark.dataSource.register(L.LiveStates)
    states = spark.readStream.format("live_states").options(path=f"{out}/polls", first=first, last=last, box="51,57,-60,-20", failing=50).load()
    up = L.airborne(states, 9500, 210).select("poll", "icao24", "alt_ft", "vel_kts")
    Y.finish(up.writeStream.format("parquet").option("path", f"{out}/up").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start())
    return spark.read.schema(up.schema).parquet(f"{out}/up")
