"""Helpers shared by the corpus operators: shared folders, Arrow maps, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a local folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file:///tmp/checkpoints/trackweave"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there. ``made`` gets the folder."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(made: list[str]) -> None:
    """Remove folders that nothing reads any more; the list is empty then."""
    from pyarrow import fs

    while made:
        store, place = fs.FileSystem.from_uri(made.pop())
        store.delete_dir(place)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, the shuffle files of a query are removed when it has ended, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Bytes of an Arrow batch that are worked on at a time.
SLICE = 1 << 23


def slices(batch: pa.RecordBatch, most: int = SLICE):
    """Parts of ``batch`` of about ``most`` bytes by the mean of its rows."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    factory: Callable[[], Callable[..., Sequence[pa.Array]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns computed batch by batch from ``inputs``.

    ``factory`` runs once per task and returns a function from Arrow arrays (the inputs) to
    the new Arrow arrays. Columns of ``df`` that have the name of a new one are replaced.
    ``keep`` limits the columns that are passed on.
    """
    new = list(fields)
    names = {f.name for f in new}
    passed = [c for c in (df.columns if keep is None else keep) if c not in names]
    extra = [c for c in inputs if c not in passed]
    source = df.select(*[df[f"`{c}`"] for c in passed], *[df[f"`{c}`"].alias(f"__in{i}") for i, c in enumerate(extra)])
    schema = T.StructType([f for c in passed for f in source.schema if f.name == c] + new)
    k = len(passed)
    at = [passed.index(c) if c in passed else k + extra.index(c) for c in inputs]

    def run(batches):
        fn = factory()
        for batch in (b for whole in batches for b in slices(whole)):
            if batch.num_rows:
                made = fn(*[batch.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], names=[*passed, *[f.name for f in new]])

    return source.mapInArrow(run, schema)


Spans = dict[int, tuple[int, int]]


def dealt_blocks(rows: DataFrame, key: str, vector: str, each: int, name: str) -> tuple[str, Spans]:
    """``rows`` as files of about ``each`` by a hash of ``key``, a folder a block; for each length of vectors its first block and their number."""
    counts = rows.groupBy(F.size(vector).alias("dim")).count().orderBy("dim").collect()  # a row a length
    first, at = {}, 0
    for r in counts:
        first[r["dim"]] = (at, max(1, -(-r["count"] // each)))
        at += first[r["dim"]][1]
    path = fresh_path(rows.sparkSession, name)
    pairs = [x for dim, (a, n) in first.items() for x in (F.lit(dim), F.struct(F.lit(a).alias("first"), F.lit(n).alias("n")))]
    if pairs:
        deal = F.element_at(F.create_map(*pairs), F.size(vector))
        block = (deal["first"] + F.pmod(F.xxhash64(key), deal["n"])).cast("int")
        rows.withColumn("block", block).repartition(at, "block").write.partitionBy("block").parquet(path)
    return path, first


def read_block(path: str, block: int, columns: list[str], by: str = "block") -> pa.Table:
    """The rows of one block, in a task; none, if it has no file."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{place}/{by}={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read(columns=columns) for f in files]) if files else pa.table({c: [] for c in columns})


def pairs_of(shards: Spans, blocks: Spans) -> tuple[int, Callable[[int], tuple[int, int]]]:
    """How many pairs of a shard and a block of one length of vectors there are, and the pair of a number; those of a shard follow each other."""
    spans, total = [], 0
    for dim, (b, n) in blocks.items():
        if dim in shards:
            spans.append((total, shards[dim][0], b, n))
            total += n * shards[dim][1]

    def pair(k: int) -> tuple[int, int]:
        begin, shard, block, n = max(s for s in spans if s[0] <= k)
        return shard + (k - begin) // n, block + (k - begin) % n

    return total, pair


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges(u, v)``; root is the smallest node of the component.

    Alternating large-star and small-star steps; each is a min-aggregation (combined before the
    shuffle) and a join that adaptive execution can split where one node has very many links.
    Self-links and null ends are ignored; repeated links count once. The lineage is cut by
    ``checkpoint()`` after every round.
    """
    shared_dir(edges.sparkSession)
    e = (
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e = small.select("e.*").where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
