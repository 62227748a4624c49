"""Streams into tables: rows by day, first of each key, and counts that are updated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import overwrite_parts


def finish(query: StreamingQuery, seconds: int = 3600) -> None:
    """Wait for a stream that ends by itself; one that does not is stopped with an error."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end within {seconds} seconds")


def written(rows: DataFrame, out: str) -> DataFrame:
    """What batches have written to ``out``, in the columns of ``rows``; nothing, if no batch had a row."""
    spark = rows.sparkSession
    try:
        return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], rows.schema)


def stream_by_day(rows: DataFrame, day: Column, out: str, checkpoint: str) -> DataFrame:
    """Append the stream ``rows`` to ``out`` in partitions of day and batch: a batch that is repeated replaces its own only.

    What the checkpoint knows to be done is not read again. A null day is a partition of its own.
    """

    def one(batch: DataFrame, number: int) -> None:
        overwrite_parts(batch.withColumn("day", day).withColumn("batch", F.lit(number).cast("long")), out, ["day", "batch"])

    finish(rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return written(rows.withColumn("day", day).withColumn("batch", F.lit(0).cast("long")), out)


def stream_first(rows: DataFrame, keys: list[str], time: str, out: str, checkpoint: str, late: str = "48 hours") -> DataFrame:
    """One row of each key among those that come within ``late`` of it; which of equal ones is open."""
    first = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    finish(first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def stream_latest(counts: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """An aggregate of a stream as of its last update: updates are kept by batch, the newest of a key counts."""

    def one(batch: DataFrame, number: int) -> None:
        overwrite_parts(batch.withColumn("batch", F.lit(number).cast("long")), out, ["batch"])

    finish(counts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start())
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return written(counts.withColumn("batch", F.lit(0).cast("long")), out).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "batch")


def stream_alerts(stats: DataFrame, keys: list[str], alerts: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Alerts over an aggregate of a stream, told anew with every batch from the newest row of each key; those of the last batch.

    A batch that is repeated replaces its own updates and alerts only.
    """
    spark = stats.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        overwrite_parts(batch.withColumn("batch", F.lit(number).cast("long")), f"{out}/updates", ["batch"])
        newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        updates = written(stats.withColumn("batch", F.lit(0).cast("long")), f"{out}/updates").where(F.col("batch") <= number)
        latest = updates.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r", "batch")
        alerts(latest).write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")

    finish(stats.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start())
    told = written(spark.createDataFrame([], "type string, month string, message string, severity string, batch long"), f"{out}/alerts")
    last = told.agg(F.max("batch").alias("batch"))  # one row
    return told.join(F.broadcast(last), "batch", "left_semi").drop("batch")
