"""Exact search against all inner products, in plain whole numbers."""

import math
from collections import Counter

import numpy as np
import pytest

from trackweave.llm import impact


def test_postings_give_the_exact_best():
    rng = np.random.default_rng(0)
    for n, d, r, k in ((1, 1, 5, 5), (3, 2, 4, 5), (50, 3, 2, 5), (200, 5, 300, 5), (40, 4, 1, 5), (300, 8, 1000, 3), (60, 3, 0, 5)):
        for _ in range(20):
            x = rng.integers(-r, r + 1, (n, d)).astype(float)
            shard, q = impact.Shard.of(x, int(rng.integers(1, 9))), rng.integers(-r, r + 1, d).astype(float)
            ids, own = rng.permutation(n), int(rng.integers(-1, n))
            best, scores, _ = impact.top(shard, ids, q, k, own)
            every = (x * q).sum(axis=1)
            want = [i for i in np.lexsort((ids, -every)) if i != own][:k]
            assert want == best.tolist() and scores.tolist() == every[want].tolist()


def test_a_clear_winner_ends_the_search_early():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 20, (5000, 16)))
    x[:6] = 300
    _, scores, share = impact.top(impact.Shard.of(x), np.arange(5000), np.full(16, 300.0), 5, 0)
    assert scores.tolist() == [16 * 90_000.0] * 5 and share < 0.2


def vectors(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    one = rows[3][1]
    rows += [(None, one), (10_000, None), (10_050, []), (10_100, [math.nan] * 64), (10_150, [None, 1.0]), (10_200, [math.inf] + one[1:]), (10_250, [0.0] * 64)]
    rows += [(20_000 + i, one) for i in range(20)] + [(20_000, one)] + [(30_000 + 50 * i, [float(i), -0.5, 1.0]) for i in range(4)]
    return rows + [(40_000, [1e30, 1.0]), (40_001, [3.0, -1e30]), (40_050, [0.001, 0.002]), (40_003, [-5.0, 1e12])]


def plain(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) if abs(x) < 1e9 else 256 * int(x) for x in np.float32(v).astype(float).tolist()]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v))
            out += [(i, r, j, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, j) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 60, "query_rows": 3}])
def test_top_k_of_whole_tables(spark, sf_dir, limits):
    rows = vectors(spark, sf_dir)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, row string, score int").repartition(4)
    got = impact.top_k(df, **limits)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    if limits:  # past 64 bits, shards are ranked by the nearest number of 64 bits
        keep = lambda rows: Counter(tuple(r) for r in rows if not 40_000 <= r[0] < 50_000)
    else:
        keep = lambda rows: Counter(map(tuple, rows))
    assert keep(got.collect()) == keep(plain(rows))


def test_no_vectors(spark):
    assert impact.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert impact.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []
    assert impact.top_k(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")).collect() == []
