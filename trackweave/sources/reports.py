"""Position reports: the flight-shaped projection of an events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same text for Spark and for other engines; times are in microseconds.
PROJECTION = """SELECT event_id, 'u' || lpad(CAST(user_id AS STRING), 6, '0') AS icao24, ts,
 50.0e0 + 0.9e0 * (day(ts) % 10) + (event_id % 97) / 100.0e0 AS latitude,
 -60.0e0 + 1.5e0 * day(ts) + value / 50.0e0 AS longitude,
 9000.0e0 + (event_id % 31) * 100.0e0 AS altitude_m, CAST(event_id % 360 AS DOUBLE) AS heading_deg,
 CAST(200 + (event_id % 80) AS DOUBLE) AS velocity_mps,
 CASE WHEN event_type IN ('view','signup') THEN 'adsc' WHEN event_type = 'click' THEN 'adsb' WHEN event_type = 'purchase' THEN 'flight' ELSE 'other' END AS kind
FROM {events}"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value", "event_type")
    return spark.sql(PROJECTION.format(events="{events}"), events=events).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))


def points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return reports(spark, sf_dir).where(F.col("kind") == kind).drop("kind")


def flights(spark: SparkSession, sf_dir: str, hours: int = 20) -> DataFrame:
    half = hours * 3_600_000_000
    return points(spark, sf_dir, "flight").select("icao24", F.col("event_id").alias("flight_id"), (F.col("t") - half).alias("f0"), (F.col("t") + half).alias("f1"))
