"""Exact top-k search by inner product over impact-ordered postings, score at a time.

Vectors of whole numbers are dealt into shards. In a shard each component has a list of postings, cut into
segments by a quantised value. A query works through the segments of all components by descending impact -
its own component times the segment's value - and adds up lower bounds of the scores. It stops only on proof:
when few rows remain whose upper bound reaches the k-th best exact score so far. Those are scored exactly.
Shards and blocks of queries are files; a task takes a pair of numbers and reads both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt_blocks, fresh_path, materialize, pairs_of, read_block

LEVELS = 256
SHARD_ROWS, QUERY_ROWS, TASKS = 16_384, 2_048, 50_000
#: Impacts, as shares of the largest, at which a query looks whether it can stop.
LOOKS = (0.5, 0.42, 0.36, 0.31, 0.27, 0.23, 0.19, 0.15, 0.1, 0.05, 0.0)
#: Part of the rows that may be left to be scored exactly.
REST = 1 / 16
EXACT = float(1 << 53)


@dataclass
class Shard:
    """Rows of whole numbers and, a row a component, places and levels of their postings by level."""

    x: np.ndarray
    low: np.ndarray
    step: np.ndarray
    post: np.ndarray
    level: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, levels: int = LEVELS) -> Shard:
        low, high = x.min(axis=0), x.max(axis=0)
        step = np.floor((high - low) / levels) + 1
        post = np.argsort((x - low) // step, axis=0, kind="stable").astype(np.int32)
        return cls.read(x, low, step, np.ascontiguousarray(post.T))

    @classmethod
    def read(cls, x: np.ndarray, low: np.ndarray, step: np.ndarray, post: np.ndarray) -> Shard:
        return cls(x, low, step, post, np.take_along_axis(((x - low) // step).T, post, 1))


def top(shard: Shard, names: np.ndarray, q: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and scores of the ``k`` best rows but ``own``, ties by ``names``; and the share of postings that were added."""
    n, d = shard.x.shape
    weight = np.abs(q) * shard.step
    top_level = shard.level[:, -1]  # of each component
    up = q > 0
    # a row's rank in a component: its level, or what is missing from the top level where the query's component is negative
    base = float((q * np.where(up, shard.low, shard.low + (top_level + 1) * shard.step - 1)).sum())
    slack = float((np.abs(q) * (shard.step - 1)).sum())
    most = weight * top_level
    use = np.flatnonzero(most > 0)
    score, seen = np.zeros(n), np.zeros(n)
    done = np.zeros(d, np.int64)
    added, left = 0, np.arange(n)
    peak = float(most.max(initial=0.0))
    for look in LOOKS:
        t = peak * look
        rows, gains = [], []
        active = [c for c in use.tolist() if most[c] > t]
        for c in active:
            # ranks over t / weight that are not yet added: the end of the list, or its start where the query's component is negative
            bar = t / weight[c]
            if up[c]:
                part = slice(int(np.searchsorted(shard.level[c], bar, side="right")), n - done[c])
                rank = shard.level[c, part]
                done[c] = n - part.start
            else:
                part = slice(done[c], int(np.searchsorted(shard.level[c], top_level[c] - bar, side="left")))
                rank = top_level[c] - shard.level[c, part]
                done[c] = part.stop
            rows.append(shard.post[c, part])
            gains.append(rank * weight[c])
        at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        if len(at):
            score += np.bincount(at, np.concatenate(gains), n)
            seen += np.bincount(at, minlength=n)
            added += len(at)
        # what a component can still add: at most t where it has begun, all of it where not
        open_ = score + t * (len(active) - seen) + float(np.minimum(most, t)[most <= t].sum())
        bounds = open_ + (base + slack)
        first = np.argpartition(-score, min(n - 1, 4 * k))[: 4 * k + 1]
        first = first[first != own]
        known = np.sort((shard.x[first] * q).sum(axis=1))[::-1]
        bar = known[k - 1] if len(known) >= k else -np.inf
        left = np.flatnonzero(bounds >= bar)
        if len(left) <= max(4 * k, n * REST):
            break
    left = left[left != own]
    exact = (shard.x[left] * q).sum(axis=1)
    order = np.lexsort((names[left], -exact))[:k]
    return left[order], exact[order], added / max(1, n * d)


def whole(v: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles, or as Python's whole numbers where doubles could not hold products exactly."""
    x = v.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0**17:
        return np.floor(256.0 * x)
    out = np.empty(x.shape, object)
    out[...] = [[int(np.floor(256.0 * c)) if abs(c) < 2.0**40 else int(c) * 256 for c in row] for row in x.tolist()]
    return out


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def usable(vectors: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """row, id and vector of rows with an id and a vector of finite components."""
    v = F.col(f"`{vector_col}`")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False)) & (F.size(v) > 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))


def _postings(spark: SparkSession, path: str, shards: int) -> str:
    """The postings of every shard, written beside its rows: a row a component, places in the order of ``row``."""

    def build(batches):
        for b in batches:
            for block in b.column(0).to_pylist():
                t = read_block(path, block, ["row", "v"]).sort_by("row")
                x = whole(_matrix(t["v"], t.num_rows))
                if not t.num_rows or x.dtype == object:
                    continue  # searched without postings
                s = Shard.of(x)
                d = x.shape[1]
                made = [pa.array(np.full(d, block, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(s.low), pa.array(s.step), pa.array(list(s.post), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(made, names=["block", "c", "low", "step", "post"])

    out = fresh_path(spark, "postings")
    numbers = spark.range(0, shards, 1, min(shards, TASKS)).select("id")
    numbers.mapInArrow(build, "block int, c int, low double, step double, post array<int>").write.partitionBy("block").parquet(out)
    return out


def search(rows: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(qrow, query_id, vec_id, score): of each query the ``k`` best rows of every shard of its length.

    The postings of a shard and a block of queries fit a task, whatever the number of rows; the pairs of a
    shard and a block are a table of numbers, so that no vector is shuffled once for each shard.
    """
    spark = rows.sparkSession
    path, shards = dealt_blocks(rows, "row", "v", shard_rows, "shards")
    asked, blocks = dealt_blocks(queries, "row", "v", query_rows, "asked")
    total, pair_of = pairs_of(shards, blocks)
    if not total:
        return spark.createDataFrame([], "qrow long, query_id long, vec_id long, score long")
    index = _postings(spark, path, sum(n for _, n in shards.values()))

    def run(batches):
        held: tuple = (None,)
        for b in batches:
            for pair in b.column(0).to_pylist():
                shard, block = pair_of(pair)
                if held[0] != shard:
                    t = read_block(path, shard, ["row", "id", "v"]).sort_by("row")
                    x = whole(_matrix(t["v"], t.num_rows))
                    p = read_block(index, shard, ["c", "low", "step", "post"]).sort_by("c")
                    ready = Shard.read(x, p["low"].to_numpy(), p["step"].to_numpy(), _matrix(p["post"], p.num_rows)) if p.num_rows else None
                    held = (shard, x, t["row"].to_numpy(), t["id"].to_numpy(), ready, float(np.abs(x).max(initial=0)) if x.dtype != object else np.inf)
                _, x, names, ids, ready, far = held
                if not len(x):
                    continue
                t = read_block(asked, block, ["row", "id", "v"]).sort_by("row")
                q = whole(_matrix(t["v"], t.num_rows))
                out: list[list] = [[], [], [], []]
                for own, name, vector in zip(t["row"].to_pylist(), t["id"].to_pylist(), q):
                    at = int(np.searchsorted(names, own))
                    at = at if at < len(names) and names[at] == own else -1
                    if ready is not None and q.dtype != object and 4 * far * float(np.abs(vector).sum()) < EXACT:
                        best, scores, _ = top(ready, ids, vector, k, at)
                        scores = scores.astype(np.int64).tolist()
                    else:  # products past 53 bits: all rows of the shard in whole numbers
                        every = [sum(int(a) * int(b) for a, b in zip(row, vector)) for row in x]
                        best = [i for i in sorted(range(len(x)), key=lambda i: (-every[i], ids[i])) if i != at][:k]
                        scores = [min(max(every[i], -(1 << 63)), (1 << 63) - 1) for i in best]
                    for column, values in zip(out, ([own] * len(best), [name] * len(best), ids[best].tolist(), scores)):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["qrow", "query_id", "vec_id", "score"])

    return spark.range(0, total, 1, min(total, TASKS)).mapInArrow(run, "qrow long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` rows of the largest integer inner product for each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Components are floor(256 x). Ties go to the smaller id, and a query's own row is no candidate of it. Rows without an id,
    and vectors that are null, without components, or hold a null or non-finite one, take no part; zero vectors do.
    Vectors of different lengths are searched apart. Repeated rows are candidates and queries each. An empty table gives
    no row. Scores past 64 bits are given as the nearest number of 64 bits.
    """
    rows = materialize(usable(vectors, vector_col, id_col), "rows")
    found = search(rows, rows.where(F.col("id") % every == 0), k, shard_rows, query_rows)
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
