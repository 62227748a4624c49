"""Paths that only large inputs take, forced by small limits; the stages of the pipeline on clashing columns."""

import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import ann, decontaminate, substrings
from trackweave.llm.common import dealt_blocks, pairs_of, read_block


def test_texts_of_one_hash_are_told_apart(spark):
    texts = ["a", "b", "a", None, "", None, *"cdefg"]
    df = spark.createDataFrame([(t,) for t in texts], "__text string")
    own, counts = substrings.identified(df, bits=8)
    by = {}
    for r in own.collect():
        by.setdefault(r.uid, set()).add(r["__text"])
    assert all(len({t for t in x if t is not None}) == 1 or x == {None} for x in by.values())
    assert sum(r.n for r in counts.collect()) == len(texts)


def test_large_benchmarks_are_searched_in_several_stages(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(12))) for k in range(40)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(30)) + " " + (items[k % 40][1] if k % 3 == 0 else "")) for k in range(90)] + [(None, None), (500, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole = decontaminate.benchmark_overlap(d, b)
    monkeypatch.setattr(decontaminate, "PASSES", 2)
    parts = decontaminate.benchmark_overlap(d, b, block_bytes=300)
    rows = lambda df: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in df.collect())
    assert rows(whole) == rows(parts) and sum(r[4] for r in rows(parts)) >= 30


def test_pairs_of_shards_and_blocks(spark):
    rows = spark.createDataFrame([(i, [1.0] * (2 + i % 2)) for i in range(50)], "k long, v array<double>")
    path, first = dealt_blocks(rows, "k", "v", 10, "b")
    assert first == {2: (0, 3), 3: (3, 3)}
    assert sorted(k for b in range(6) for k in read_block(path, b, ["k"])["k"].to_pylist()) == list(range(50)) and read_block(path, 9, ["k"]).num_rows == 0
    total, pair = pairs_of({2: (0, 3), 3: (3, 2), 7: (5, 1)}, {2: (0, 2), 3: (2, 1), 9: (3, 4)})
    assert [pair(k) for k in range(total)] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 2), (4, 2)]
    assert dealt_blocks(rows.limit(0), "k", "v", 10, "b")[1] == {}


@pytest.fixture(scope="module")
def stages():
    return dict(sys.modules.get("corpus_pipeline", __import__("corpus_pipeline")).STAGES)


CLASH = "doc_id long, text string, score double, predicted int, spans string, contaminated boolean, n_hit string, __node string, __row string, ids string"


def rows_of(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(9001, None), (9002, ""), (None, "Mail a.b@example.com now."), (9003, rows[0][1]), (9003, rows[0][1])]
    return spark.createDataFrame([(*r, 0.5, 7, "s", True, "h", "n", "r", "i") for r in rows], CLASH)


@pytest.mark.parametrize("name", ["toxicity", "near copies", "decontamination", "personal data"])
def test_stages_keep_columns_of_any_name(spark, sf_dir, stages, name):
    docs = rows_of(spark, sf_dir)
    out = stages[name](spark, docs, sf_dir)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert rows and all(tuple(r)[2:] == (0.5, 7, "s", True, "h", "n", "r", "i") for r in rows)
    assert sum(not r.text for r in rows) == 2
    if name == "personal data":
        assert len(rows) == docs.count() and [r.text for r in rows if r.doc_id is None] == ["Mail [email] now."]
    else:
        had = Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in docs.collect())
        assert not Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in rows) - had


@pytest.mark.parametrize("name", ["toxicity", "near copies", "decontamination", "personal data", "packing"])
def test_stages_of_an_empty_table(spark, sf_dir, stages, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stages[name](spark, docs, sf_dir).count() == 0


def test_counts_of_characters_follow_the_new_text(spark, sf_dir, stages):
    docs = spark.createDataFrame([(1, "Mail a.b@example.com now.", 25), (2, "Mail a.b@example.com now.", None), (3, None, 0)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: r.n_chars for r in stages["personal data"](spark, docs, sf_dir).select("doc_id", F.col("n_chars")).collect()}
    assert out == {1: 17, 2: None, 3: 0}


def test_recall_of_a_large_shard():
    """A shard of 4000 vectors in groups, at the beam that queries have, against all inner products."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (40, 64))[rng.integers(0, 40, 4000)] + rng.normal(0, 1, (4000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph, entry = ann.build_graph(ann.lengthened(x, 1.0))
    q = np.arange(0, 4000, 40)
    ids, _ = ann.beam_search(x, np.zeros(len(x), np.float32), graph, entry, x[q], ann.BEAM)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -9
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(set(b) & set(i)) / 20 for b, i in zip(best.tolist(), ids.tolist())]) > 0.95
