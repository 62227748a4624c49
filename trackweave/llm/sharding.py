"""Sharding of indivisible groups by best-fit-decreasing bin packing."""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a chunk within which one task numbers slots.
CHUNK = 100_000


def best_fit_decreasing(histogram: dict[int, int], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, count, bin): each item, largest first, goes to the fullest bin of ``capacity`` that has room.

    ``histogram`` counts the items of each size; equal items that go to one bin are one run. Remaining
    capacities are kept in order, so the tightest bin is found by bisection. An item over ``capacity`` gets
    a bin of its own. None if more than ``most`` bins would be needed.
    """
    room: list[tuple[int, int]] = []
    runs, bins = [], 0
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            at = bisect.bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
            elif most is not None and bins == most:
                return None
            else:
                left, b, bins = max(capacity, size), bins, bins + 1
            take = min(n, left // size)
            runs.append((size, take, b))
            bisect.insort(room, (left - take * size, b))
            n -= take
    return runs


def pack_into(histogram: dict[int, int], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, count, shard 0..shards-1) with sizes near equal: the least capacity that best fit can fill."""
    if not histogram:
        return []
    low = max(-(-sum(s * n for s, n in histogram.items()) // shards), max(histogram))
    step, best = 1, best_fit_decreasing(histogram, low, shards)
    if best is not None:
        return best
    while best is None:  # low fails
        step *= 2
        best = best_fit_decreasing(histogram, low + step, shards)
    low, high = low + step // 2 + 1, low + step
    while low < high:
        mid = (low + high) // 2
        found = best_fit_decreasing(histogram, mid, shards)
        if found is None:
            low = mid + 1
        else:
            high, best = mid, found
    return best


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal bytes; equal texts stay together.

    Size: UTF-8 bytes of the text (null: 0) plus 1. Groups of equal texts are summed before any
    shuffle. Only how many groups there are of each size matters to the packing: this histogram (different sizes
    add up to the whole, so with b bytes it has at most the square root of 2 b rows) is packed best fit decreasing
    on the driver, with the least capacity that ``shards`` bins hold; groups take their places by rank within
    their size. Columns: id, size, text_crc32, shard, slot (gapless from 0, by id). Null ids come first, null
    texts are one group, repeated rows each get a slot, an empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`")
    sized = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("__g"),
    )
    sized = materialize(sized, "sized")
    groups = materialize(sized.groupBy("__g").agg(F.sum("size").alias("__bytes")), "groups")
    histogram = {r["__bytes"]: r["n"] for r in groups.groupBy("__bytes").agg(F.count("*").alias("n")).toLocalIterator()}
    place: dict[int, int] = defaultdict(int)
    rows = []
    for size, n, b in pack_into(histogram, shards):
        rows.append((size, place[size], place[size] + n, b))
        place[size] += n
    spark = docs.sparkSession
    places = spark.createDataFrame(rows, "__bytes long, __from long, __to long, shard int")  # a row a size, and one more where a bin is full
    ranked = with_slots(groups, "__bytes", ["__g"]).withColumnRenamed("slot", "__rank")
    there = ranked.join(places, "__bytes").where("__rank >= __from AND __rank < __to").select("__g", "shard")
    placed = materialize(sized.join(there, "__g").select(id_col, "size", "text_crc32", "shard"), "placed")
    return with_slots(placed, "shard", [id_col, "text_crc32"])


def with_slots(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``slot``: position from 0 among the rows of ``by``, numbered chunk by chunk.

    A shard can hold a large part of all rows, so that no task numbers a whole one: rows are dealt by
    hash into chunks of about CHUNK rows, each is numbered alone, and the chunks' counts are summed up.
    """
    from pyspark.sql import Window

    chunks = max(1, -(-rows.count() // CHUNK)) * 8
    c = rows.withColumn("__c", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    n = c.groupBy(by, "__c").agg(F.count("*").alias("__n"))
    base = n.withColumn("__base", F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    w = Window.partitionBy(by, "__c").orderBy(*order)
    return (
        c.withColumn("__r", F.row_number().over(w) - 1)
        .join(base, [by, "__c"])
        .withColumn("slot", (F.col("__base") + F.col("__r")).cast("long"))
        .drop("__c", "__r", "__base")
    )
