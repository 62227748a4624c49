"""Times of any column type: dispatch by type, windows that scans can use, units of epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import epoch_unit, parse_time

#: Names of text columns that hold epoch seconds (fixed values).
EPOCH_NAMES = ("time", "ts")
_MICROS = {"s": 1e6, "ms": 1e3, "us": 1.0, "ns": 1e-3}


def _kind(rows: DataFrame, name: str) -> str:
    of = rows.schema[name].dataType
    if isinstance(of, T.NumericType):
        return "number"
    if isinstance(of, T.StringType):
        return "epoch text" if name.lower() in EPOCH_NAMES else "text"
    return "time"


def as_time(rows: DataFrame, name: str) -> Column:
    """The column as a timestamp: numbers and texts named as epochs are seconds, other texts are read, times stay. What cannot be read is null."""
    c, kind = F.col(f"`{name}`"), _kind(rows, name)
    if kind == "number":
        return F.timestamp_micros(F.floor(c.cast("double") * 1e6))
    if kind == "epoch text":
        return F.timestamp_micros(F.floor(c.try_cast("double") * 1e6))
    return F.timestamp_seconds(parse_time(c)) if kind == "text" else c.cast("timestamp")


def within(rows: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """``rows`` whose time is in [start, end) microseconds. On numbers and times the bounds are on the column as stored, so that scans use them."""
    c, kind = F.col(f"`{name}`"), _kind(rows, name)
    if kind == "number":
        return rows.where((c >= F.lit(start / 1e6)) & (c < F.lit(end / 1e6)))
    if kind == "time":
        low, high = (F.timestamp_micros(F.lit(x)).cast(rows.schema[name].dataType) for x in (start, end))
        return rows.where((c >= low) & (c < high))
    t = as_time(rows, name)
    return rows.where((t >= F.timestamp_micros(F.lit(start))) & (t < F.timestamp_micros(F.lit(end))))


def _scaled(number: Column, unit: Column) -> Column:
    factor = F.create_map(*[x for u, f in _MICROS.items() for x in (F.lit(u), F.lit(f))])
    return F.timestamp_micros(F.round(number * F.element_at(factor, unit)).cast("long"))


def coerced(rows: DataFrame, name: str, group: str) -> DataFrame:
    """``rows`` with ``coerced``, the column as a timestamp.

    The unit of numbers is that of their median magnitude in a group. Texts are read as times first; only those that fail are
    tried as numbers, whose unit is that of the failed ones. The rest is null.
    """
    c, kind = F.col(f"`{name}`"), _kind(rows, name)
    if kind == "time":
        return rows.withColumn("coerced", c.cast("timestamp"))
    read = F.lit(None).cast("timestamp")
    if kind != "number":
        plain = F.regexp_replace(F.translate(c, "T/", " -"), "Z", "")
        read = F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss"))
    tried = rows.withColumn("__read", read).withColumn("__number", F.when(F.col("__read").isNull(), c.try_cast("double")))
    units = tried.groupBy(group).agg(F.coalesce(epoch_unit(F.median(F.abs("__number"))), F.lit("s")).alias("__unit"))
    joined = tried.join(units.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn("coerced", F.coalesce("__read", _scaled(F.col("__number"), F.col("__unit")))).drop("__read", "__number", "__unit", "__group")
