"""Tables that are written and read back: stages of a plan, twins in two formats, days that are overwritten."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file:///tmp/checkpoints/trackweave"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that use it several times: written as Parquet and read back, it outlives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_twins(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    r"""Write ``df`` as Parquet and as CSV below ``path`` and read both. CSV has ``\N`` for null, so that an empty text stays one."""
    form = {"header": True, "nullValue": "\\N", "escape": '"'}
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").options(**form).csv(f"{path}/csv")
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(f"{path}/parquet"), spark.read.schema(df.schema).options(**form, multiLine=True).csv(f"{path}/csv")


def overwrite_parts(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Replace the partitions of ``path`` that ``df`` has rows in, leave the others; twice the same gives the same."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    rest = [f for f in df.schema.fields if f.name not in by]
    schema = reduce(lambda s, f: s.add(f), [df.schema[c] for c in by], type(df.schema)(list(rest)))
    return df.sparkSession.read.schema(schema).parquet(path).select(*[F.col(c) for c in df.columns])
