"""Results kept by window: what is finished is told by a manifest that is written after the rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str, base: str | None = None) -> DataFrame:
    """The table at ``path``, or an empty one if nothing has been written there."""
    try:
        return (spark.read.option("basePath", base) if base else spark.read).schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Windows:
    """Rows by window below ``path``. A write is an attempt with a folder of its own; its windows are finished once the
    manifest names them, so that a write that breaks leaves nothing that is read, and its windows are done again.
    Of two attempts at one window the first that finished counts.
    """

    MANIFEST = "window string, attempt string, n long, finished_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def finished(self, least: int = 0) -> DataFrame:
        """(window, attempt, n) of finished windows of at least ``least`` rows."""
        rows = read_if_there(self.spark, f"{self.path}/manifest", self.MANIFEST)
        first = rows.where(F.col("n") >= least).groupBy("window").agg(F.min(F.struct("finished_at", "attempt", "n")).alias("m"))
        return first.select("window", "m.attempt", "m.n")

    def todo(self, rows: DataFrame, window: str = "window", least: int = 0) -> DataFrame:
        """``rows`` of windows that are not finished."""
        return rows.join(self.finished(least).select(F.col("window").alias(window)), window, "left_anti")

    def write(self, rows: DataFrame, windows: DataFrame | None = None, finish: bool = True) -> str:
        """Write ``rows`` as a new attempt, then name its windows in the manifest: those of ``windows``, also without a row, or those there are."""
        attempt = uuid.uuid4().hex
        out = f"{self.path}/rows/attempt={attempt}"
        rows.write.partitionBy("window").parquet(out)
        if finish:
            found = read_if_there(self.spark, out, self._schema(rows)).groupBy("window").agg(F.count("*").alias("n"))
            if windows is not None:
                found = windows.select("window").distinct().join(found, "window", "left").fillna(0, ["n"])
            made = found.select("window", F.lit(attempt).alias("attempt"), "n", F.current_timestamp().alias("finished_at"))
            made.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # a row a window, in one file: all of them or none
        return attempt

    @staticmethod
    def _schema(rows: DataFrame) -> T.StructType:
        return T.StructType([*[f for f in rows.schema.fields if f.name != "window"], T.StructField("window", T.StringType())])

    def read(self, like: DataFrame) -> DataFrame:
        """The rows of all finished windows, in the columns of ``like``."""
        schema = T.StructType([*self._schema(like).fields, T.StructField("attempt", T.StringType())])
        rows = read_if_there(self.spark, f"{self.path}/rows", schema)
        return rows.join(F.broadcast(self.finished().select("window", "attempt")) if self._few() else self.finished().select("window", "attempt"), ["window", "attempt"], "left_semi").select(*like.columns)

    def _few(self, most: int = 100_000) -> bool:
        return self.finished().limit(most + 1).count() <= most

    def cached(self, name: str, make: Callable[[], DataFrame], like: str) -> DataFrame:
        """What is kept under ``name``, if it has a row; else what ``make`` gives, kept for the next time. ``like``: its schema."""
        schema = T.StructType.fromDDL(like) if isinstance(like, str) else like
        if self.finished(1).where(F.col("window") == name).isEmpty():
            self.write(make().select(*schema.names, F.lit(name).alias("window")))
        empty = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("window", T.StringType())]))
        return self.read(empty).where(F.col("window") == name).drop("window")
