"""Places in a seeded order without one task that sees all rows: permutations, exact samples, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def permuted(rows: DataFrame, name: Column, seed: int, digits: int = 3) -> DataFrame:
    """``rows`` with ``place`` (from 1) in the order of a digest of seed and ``name``, and ``total``, their number.

    The order does not depend on the layout. Rows are numbered within the 16 ** ``digits`` beginnings that a digest can
    have, which are equally likely; only the numbers of rows of each beginning are added up together. Equal names
    take places in any order, null names take the last.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), name))
    keyed = rows.withColumn("__name", name).withColumn("__digest", F.coalesce(digest, F.lit("g"))).withColumn("__cell", F.substring("__digest", 1, digits))
    sizes = keyed.groupBy("__cell").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("__cell", "n"))).alias("s"))  # one row of at most 16 ** digits + 1 entries
    plus = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    before = sizes.select(plus(F.col("s")).alias("total"), F.explode(F.transform("s", lambda x, i: F.struct(x["__cell"].alias("__cell"), plus(F.slice("s", F.lit(1), i)).alias("__before")))).alias("b")).select("total", "b.*")
    own = F.row_number().over(Window.partitionBy("__cell").orderBy("__digest", "__name"))
    placed = keyed.withColumn("__own", own).join(F.broadcast(before), "__cell")
    return placed.withColumn("place", F.col("__before") + F.col("__own")).drop("__name", "__digest", "__cell", "__own", "__before")


def sampled(rows: DataFrame, name: Column, k: int, seed: int) -> DataFrame:
    """Exactly ``k`` of ``rows`` (all, if fewer), the same ones for every layout."""
    return permuted(rows, name, seed).where(F.col("place") <= k).drop("place", "total")


def split_of_keys(keys: DataFrame, key: str, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(key, split): each distinct key in one split, of exact sizes rounded half to even; a null key is in train."""
    known = permuted(keys.select(key).where(F.col(key).isNotNull()).distinct(), F.col(key), seed)
    first, second = F.bround(train * F.col("total"), 0), F.bround(val * F.col("total"), 0)
    split = F.when(F.col("place") <= first, "train").when(F.col("place") <= first + second, "val").otherwise("test")
    return known.select(key, split.alias("split")).unionByName(keys.select(key).where(F.col(key).isNull()).distinct().withColumn("split", F.lit("train")))
