"""Sessions of position reports as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import finish


def stream_sessions(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, gap: str = "24 hours", late: str = "48 hours") -> DataFrame:
    """Read reports under ``folder`` as a stream, write closed sessions as Parquet, return what is written.

    A session closes once the watermark has passed its end; what was still open stays in the state.
    """
    reports = spark.readStream.schema(schema).parquet(folder)
    s = reports.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    s = s.groupBy("user_id", F.session_window("time", gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    q = s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "total").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").queryName(f"s{uuid.uuid4().hex}").trigger(availableNow=True).start()
    finish(q)
    return spark.read.schema("user_id long, start timestamp, end timestamp, n_events long, total double").parquet(out)
