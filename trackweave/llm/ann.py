"""Nearest neighbours over robust-pruned directed graphs, one a shard.

Vectors are dealt into shards of bounded size by a hash. Within a shard a graph grows in batches:
greedy searches propose neighbours, and pruning keeps an edge only if no kept neighbour is closer to
its end by the factor ALPHA. Queries run as beam searches over every shard, and the shards' answers
are merged. Largest inner products become least distances by one more component, which makes all
vectors equally long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_blocks, fresh_path, materialize, pairs_of, read_block

DEGREE, ALPHA, BEAM_BUILD, BEAM = 32, 1.2, 48, 160
SHARD_ROWS, QUERY_ROWS, TASKS = 16_384, 4_096, 50_000


def beam_search(x: np.ndarray, sq: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (less the query's square) of the ``beam`` nearest nodes met, nearest first; -1: none."""
    n, m = len(x), len(q)
    rows = np.arange(m)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.zeros((m, beam), bool)
    ids[:, 0] = entry
    dist[:, 0] = sq[entry] - 2 * (q @ x[entry])
    seen = np.zeros((m, n + 1), bool)
    seen[:, entry] = True
    seen[:, n] = True  # the pad
    live = rows
    while len(live):
        open_ = (~done[live]) & (ids[live] >= 0)
        order = np.argsort(~open_, axis=1, kind="stable")[:, :wide]
        ok = np.take_along_axis(open_, order, 1)
        going = ok.any(axis=1)
        live, order, ok = live[going], order[going], ok[going]
        if not len(live):
            break
        found = []
        for k in range(order.shape[1]):
            node = np.where(ok[:, k], ids[live, order[:, k]], n)
            done[live[ok[:, k]], order[ok[:, k], k]] = True
            near = graph[node]
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            found.append(np.where(new, near, n))
        near = np.sort(np.concatenate(found, axis=1), axis=1)
        width = int((near < n).sum(axis=1).max())
        if not width:
            continue
        near = near[:, :width]
        pad = near == n
        safe = np.where(pad, 0, near)
        d = sq[safe] - 2 * np.matmul(x[safe], q[live][:, :, None])[:, :, 0]
        d = np.where(pad, np.inf, d)
        all_d = np.concatenate((dist[live], d), axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(np.concatenate((ids[live], np.where(pad, -1, near)), axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate((done[live], pad), axis=1), best, 1)
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node out of ``cand`` (pad: len(x)); the pad fills the rest."""
    n = len(x)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    cand[cand == nodes[:, None]] = n
    pad = cand == n
    c = x[np.where(pad, 0, cand)]
    d = ((c - x[nodes][:, None, :]) ** 2).sum(axis=2)
    d[pad] = np.inf
    order = np.argsort(d, axis=1)[:, : 3 * degree]
    cand, d, c = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(c, order[:, :, None], 1)
    s = (c * c).sum(axis=2)
    between = s[:, :, None] + s[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), n, np.int64)
    alive = np.isfinite(d)
    rows = np.arange(len(nodes))
    for k in range(degree):
        if not alive.any():
            break
        pick = np.where(alive, d, np.inf).argmin(axis=1)
        some = alive[rows, pick]
        out[some, k] = cand[rows, pick][some]
        alive &= alpha * alpha * between[rows, pick] > d
        alive[rows, pick] = False
        alive &= some[:, None]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BEAM_BUILD) -> tuple[np.ndarray, int]:
    """Neighbours (n + 1 rows, the last only pads; pad: n) and the entry node."""
    n = len(x)
    graph = np.full((n + 1, degree), n, np.int64)
    sq = (x * x).sum(axis=1)
    entry = int((sq - 2 * (x @ x.mean(axis=0))).argmin())
    order = np.random.default_rng(3).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    at, size = 1, 1
    while at < n:
        size = min(2 * size, 512, n - at)
        batch = order[at : at + size]
        at += size
        ids, _ = beam_search(x, sq, graph, entry, x[batch], beam)
        ids = np.where(ids < 0, n, ids)
        mates = np.broadcast_to(batch[:64], (len(batch), min(64, len(batch))))  # those of the same batch, who are not yet in the graph
        graph[batch] = robust_prune(x, batch, np.concatenate((ids, mates), axis=1), degree, alpha)
        # edges back
        to = graph[batch].ravel()
        fro = np.repeat(batch, degree)
        fro, to = fro[to < n], to[to < n]
        by = np.argsort(to, kind="stable")
        fro, to = fro[by], to[by]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        width = int(min(count.max(initial=1), 3 * degree))
        fresh = np.full((len(ends), width), n, np.int64)
        fits = place < width
        fresh[np.repeat(np.arange(len(ends)), count)[fits], place[fits]] = fro[fits]
        merged = np.concatenate((graph[ends], fresh), axis=1)
        room = (merged < n).sum(axis=1) <= degree
        simple = np.sort(merged[room], axis=1)
        simple[:, 1:][simple[:, 1:] == simple[:, :-1]] = n
        graph[ends[room]] = np.sort(simple, axis=1)[:, :degree]
        if (~room).any():
            graph[ends[~room]] = robust_prune(x, ends[~room], merged[~room], degree, alpha)
    return graph, entry


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that every vector is as long as the longest."""
    more = np.sqrt(np.maximum(longest**2 - (x.astype(np.float64) ** 2).sum(axis=1), 0))
    return np.concatenate((x, more[:, None].astype(np.float32)), axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def usable(vectors: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """id and vector of rows with an id and finite, not all zero components."""
    v = F.col(f"`{vector_col}`")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> Index:
    """The index over distinct vectors: shard, node (least id), v, near (positions in the shard), members, entry.

    Equal vectors are one node; of its ids the ``k`` + 1 least are kept, as no search for k needs more.
    """
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)  # limited before the shuffle
    nodes = materialize(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members")), "nodes")
    nodes = nodes.withColumn("node", F.col("members")[0])
    # inner products exist within one length of vectors; each has its own shards
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    lengths = nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(square)).alias("longest")).orderBy("dim").collect()
    first, at, longest = {}, 0, {}
    for r in lengths:
        first[r["dim"]], longest[r["dim"]] = (at, max(1, -(-r["n"] // shard_rows))), r["longest"]
        at += first[r["dim"]][1]
    kind = dict(nodes.dtypes)["v"]

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = _matrix(table["v"]).astype(np.float32)
        graph, entry = build_graph(lengthened(x, longest[x.shape[1]]))
        k = len(x)
        return table.append_column("near", pa.array(list(graph[:k].astype(np.int32)), pa.list_(pa.int32()))).append_column("pos", pa.array(np.arange(k, dtype=np.int32))).append_column("entry", pa.array(np.full(k, entry, np.int32)))

    deal = _by_length(F.size("v"), first)
    dealt = nodes.select((deal["first"] + F.pmod(F.xxhash64("node"), deal["shards"])).cast("int").alias("shard"), "node", "v", "members")
    built = dealt.groupBy("shard").applyInArrow(build, f"shard int, node long, v {kind}, members array<long>, near array<int>, pos int, entry int")
    path = fresh_path(nodes.sparkSession, "index")
    built.write.partitionBy("shard").parquet(path)
    return Index(nodes.sparkSession.read.schema(built.schema).parquet(path), path, first)


@dataclass
class Index:
    """``rows`` as written to ``path``, a folder a shard; ``first``: length of vectors to (first shard, number of shards)."""

    rows: DataFrame
    path: str
    first: dict[int, tuple[int, int]]


def _by_length(size, first: dict[int, tuple[int, int]]):
    pairs = [x for d, (a, n) in first.items() for x in (F.lit(d), F.struct(F.lit(a).alias("first"), F.lit(n).alias("shards")))]
    return F.element_at(F.create_map(*pairs), size) if pairs else F.struct(F.lit(0).alias("first"), F.lit(1).alias("shards"))


def _answers(held: tuple, q: np.ndarray, names: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    _, x, x32, graph, nodes, entry = held
    out_q, out_n, out_s = [], [], []
    none = np.zeros(len(x), np.float32)
    for i in range(0, len(q), 512):
        own = q[i : i + 512]
        ids, _ = beam_search(x32, none, graph, entry, own.astype(np.float32), beam)
        safe = np.where(ids < 0, 0, ids)
        s = np.matmul(x[safe].astype(np.float64), own.astype(np.float64)[:, :, None])[:, :, 0]
        s[ids < 0] = -np.inf
        order = np.lexsort((nodes[safe], -s), axis=1)[:, : k + 1]
        s, ids = np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)
        ok = np.isfinite(s)
        out_q.append(np.repeat(names[i : i + 512], ok.sum(axis=1)))
        out_n.append(nodes[ids[ok]])
        out_s.append(s[ok])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q), pa.int64()), pa.array(np.concatenate(out_n), pa.int64()), pa.array(np.concatenate(out_s))], names=["qnode", "node", "score"])


def search(index: Index, queries: DataFrame, k: int, beam: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(qnode, best): for each distinct query vector the k + 1 best (score, id), found by beam search in every shard of its length.

    ``queries``: qnode, q, dealt into files of about ``query_rows``. The pairs of a shard and a file are a table of numbers:
    a task reads both, so that neither grows with the input and no query is shuffled once for each shard.
    """
    asked, blocks = dealt_blocks(queries.select("qnode", "q"), "qnode", "q", query_rows, "asked")
    total, pair_of = pairs_of(index.first, blocks)
    if not total:
        return queries.limit(0).selectExpr("qnode", "CAST(NULL AS array<struct<s: double, id: bigint>>) AS best")
    path = index.path

    def run(batches):
        held = (None,)
        for batch in batches:
            for k_pair in batch.column(0).to_pylist():
                shard, block = pair_of(k_pair)
                if held[0] != shard:
                    a = read_block(path, shard, ["node", "v", "near", "pos", "entry"], "shard")
                    if not a.num_rows:
                        continue
                    a = a.sort_by("pos")
                    x, near = _matrix(a["v"]), _matrix(a["near"]).astype(np.int64)
                    held = (shard, x, x.astype(np.float32), np.concatenate((near, np.full((1, near.shape[1]), len(x), np.int64))), a["node"].to_numpy(), int(a["entry"][0].as_py()))
                q = read_block(asked, block, ["qnode", "q"])
                if q.num_rows:
                    yield _answers(held, _matrix(q["q"]), q["qnode"].to_numpy(), k, beam)

    found = queries.sparkSession.range(0, total, 1, min(total, TASKS)).mapInArrow(run, "qnode long, node long, score double")
    first = Window.partitionBy("qnode").orderBy(F.desc("score"), "node")
    top = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    ids = top.join(index.rows.select("node", "members"), "node").select("qnode", F.transform("members", lambda m: F.struct((-F.col("score")).alias("s"), m.alias("id"))).alias("m"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, k + 1)  # of at most (k + 1) squared
    return ids.groupBy("qnode").agg(best.alias("best"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller id, and a query is not
    its own neighbour. Rows without an id, and vectors that are null, zero, or hold a null or non-finite
    component, take no part. Vectors of different lengths are searched apart, as no inner product is defined between them. Repeated rows are candidates each.
    """
    rows = materialize(usable(vectors, vector_col, id_col), "vectors")
    index = build_index(rows, k, shard_rows)
    asked = rows.where(F.col("id") % every == 0)
    nodes = index.rows.select("v", F.col("node").alias("qnode"))
    queries = materialize(asked.join(nodes, "v").select(F.col("id").alias("query_id"), "qnode"), "queries")
    distinct = nodes.join(queries.select("qnode").distinct(), "qnode").select("qnode", F.col("v").alias("q"))
    best = search(index, distinct, k)
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return (
        queries.join(best, "qnode")
        .select("query_id", F.posexplode(others).alias("p", "b"))
        .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))
    )
