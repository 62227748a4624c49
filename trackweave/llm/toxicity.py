"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Words get labels from document labels: in toxic documents, words whose form or beginning stands in many
toxic and next to no other labelled documents. A two-state chain over all words of a text, with
weights of the word, its beginnings and its ending, learns these; forward-backward marginals mark the
spans, and a logistic model over the marginals of a document gives its score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns
from .tokens import in_slices, release

#: Labelled rows a class that are fitted on: those first by a hash of their id.
TRAIN_ROWS = 1500
#: Longest text, in bytes, that takes part in the fit.
TRAIN_BYTES = 1 << 15
#: Words of a chain that advance one by one; longer chains are cut into blocks.
BLOCK = 1024
BUCKETS = 1 << 18
#: Words whose scores a task keeps.
WORDS = 250_000
HELD_OUT = 5

_APART = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())
_TO_SPACE = str.maketrans(_APART + "\t\n\r\x0b\x0c", " " * (len(_APART) + 5))
_WORD = re.compile(r"[^\s" + re.escape(_APART) + r"]+")


def words_of(text: str) -> list[str]:
    return text.lower().translate(_TO_SPACE).split(" ")


def word_features(word: str) -> list[str]:
    return ["w" + word] + ["p" + word[:k] for k in (3, 4, 5) if len(word) > k] + ["s" + word[-3:]]


def _slots(words: list[str]) -> np.ndarray:
    """Five hashed features a word (the last slot is the bias, BUCKETS)."""
    out = np.full((len(words), 6), BUCKETS, np.int64)
    for i, w in enumerate(words):
        for k, f in enumerate(word_features(w)):
            out[i, k] = zlib.crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
    return out


@dataclass
class Model:
    weights: np.ndarray  # of the hashed features, and the bias
    trans: np.ndarray  # 2 x 2 log weights of neighbouring labels
    top: np.ndarray  # of the document model

    def word_scores(self, words: list[str]) -> np.ndarray:
        padded = np.append(self.weights, 0.0)
        slots = _slots(words)
        bias = slots == BUCKETS
        bias[:, 5] = False
        slots[bias] = BUCKETS + 1
        return padded[slots].sum(axis=1)


def _advance(e: np.ndarray, starts: np.ndarray, size: np.ndarray, m: np.ndarray, entry: np.ndarray, out: np.ndarray) -> None:
    """Fill ``out`` with the odds of chains that follow ``entry`` (NaN: nothing), all side by side."""
    order = np.argsort(-size, kind="stable")
    starts, size, r = starts[order], size[order], entry[order]
    active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")  # chains of at least t words
    for t, k in enumerate(active.tolist()):
        at, r = starts[:k] + t, r[:k]
        r = e[at] * np.where(np.isnan(r), 1.0, (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r))
        out[at] = r


def _odds(e: np.ndarray, lengths: np.ndarray, m: np.ndarray, block: int | None = None) -> np.ndarray:
    """Odds along chains laid end to end: e at the first word, then e (m01 + m11 r) / (m00 + m10 r).

    A long chain is cut into blocks. Each is a product of two-by-two matrices, found for all blocks side by
    side; these give what enters each block, and the blocks then advance side by side.
    """
    block = block or BLOCK
    out, starts = np.empty(len(e)), np.cumsum(lengths) - lengths
    count = np.maximum(-(-lengths // block), 1)
    first = np.cumsum(count) - count
    nr = np.arange(int(count.sum())) - np.repeat(first, count)
    begin = np.repeat(starts, count) + nr * block
    size = np.minimum(np.repeat(lengths, count) - nr * block, block)
    entry = np.full(len(nr), np.nan)
    most = int(count.max(initial=1))
    if most > 1:
        inner = np.flatnonzero((nr > 0) & (nr + 1 < np.repeat(count, count)))  # all of them of ``block`` words
        p = np.broadcast_to(np.eye(2), (len(inner), 2, 2)).copy()
        for t in range(block if len(inner) else 0):
            own = e[begin[inner] + t]
            top = m[0, 0] * p[:, 0] + m[1, 0] * p[:, 1]
            low = own[:, None] * (m[0, 1] * p[:, 0] + m[1, 1] * p[:, 1])
            p = np.stack((top, low), 1)
            p /= p.max(axis=(1, 2), keepdims=True)
        where = np.full(len(nr), -1)
        where[inner] = np.arange(len(inner))
        long = np.flatnonzero(count > 1)
        heads = first[long]
        _advance(e, begin[heads], size[heads], m, entry[heads], out)
        r = out[begin[heads] + block - 1]
        for j in range(1, most):
            going = count[long] > j
            long, r = long[going], r[going]
            at = first[long] + j
            entry[at] = r
            mid = count[long] > j + 1
            long, at, r = long[mid], at[mid], r[mid]
            q = p[where[at]]
            r = (q[:, 1, 0] + q[:, 1, 1] * r) / (q[:, 0, 0] + q[:, 0, 1] * r)
    _advance(e, begin, size, m, entry, out)
    return out


def messages(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of the second label at every position, for chains laid end to end.

    The backward odds times the word's own are the forward odds of the reversed chain.
    """
    m, e = np.exp(trans), np.exp(np.clip(scores, -30, 30))
    forward = _odds(e, lengths, m)
    backward = _odds(e[::-1], lengths[::-1], m.T)[::-1] / e
    return np.log(np.maximum(forward, 1e-300)), np.log(np.maximum(backward, 1e-300))


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log odds of the second label at every position."""
    forward, backward = messages(scores, lengths, trans)
    return forward + backward


def _train_chain(bank: np.ndarray, chains: list[np.ndarray], labels: list[np.ndarray], epochs: int = 6, rate: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive gradient ascent on the chains' conditional likelihood; ``chains`` are rows of ``bank``, the words' feature slots."""
    weights, seen = np.zeros(BUCKETS + 2), np.full(BUCKETS + 2, 1e-6)
    trans, tseen = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    order = np.random.default_rng(7).permutation(len(chains))
    for _ in range(epochs):
        for i in range(0, len(order), 256):
            part = order[i : i + 256]
            slots = bank[np.concatenate([chains[j] for j in part])]
            y = np.concatenate([labels[j] for j in part]).astype(float)
            lengths = np.array([len(chains[j]) for j in part])
            s = weights[slots].sum(axis=1)
            forward, backward = messages(s, lengths, trans)
            p = 1 / (1 + np.exp(-np.clip(forward + backward, -30, 30)))
            g = np.bincount(slots.ravel(), np.repeat(y - p, slots.shape[1]), BUCKETS + 2)
            g[BUCKETS + 1] = 0
            g -= 1e-3 * weights
            seen += g * g
            weights += rate * g / np.sqrt(seen)
            inner = np.ones(len(y), bool)
            inner[np.cumsum(lengths) - 1] = False
            a = np.flatnonzero(inner)
            pair = np.stack([trans[u, v] + u * forward[a] + v * (np.clip(s[a + 1], -30, 30) + backward[a + 1]) for u in (0, 1) for v in (0, 1)])
            pair = np.exp(pair - pair.max(axis=0, initial=-np.inf)) if len(a) else np.zeros((4, 0))
            d = -(pair / np.maximum(pair.sum(axis=0), 1e-300)).sum(axis=1).reshape(2, 2) - 1e-3 * trans
            np.add.at(d, (y[a].astype(int), y[a + 1].astype(int)), 1.0)
            tseen += d * d
            trans = np.clip(trans + 0.1 * d / np.sqrt(tseen), -4, 4)
    return weights[: BUCKETS + 1], trans


def _doc_features(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: the largest log odds, expected toxic words, the share of them, a constant."""
    out = np.zeros((len(lengths), 4))
    out[:, 3] = 1
    some = np.flatnonzero(lengths)
    if len(some):
        at = (np.cumsum(lengths) - lengths)[some]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        total = np.add.reduceat(p, at)
        out[some, 0] = np.clip(np.maximum.reduceat(odds, at), -12, 12) / 4
        out[some, 1] = np.log1p(total)
        out[some, 2] = np.sqrt(total / lengths[some])
    out[lengths == 0, 0] = -3
    return out


def fit(texts: list[str], toxic: list[int], share: float = 0.1) -> Model:
    """Fit on labelled texts; ``share`` is the share of toxic ones outside the sample."""
    index: dict[str, int] = {}
    docs = [[index.setdefault(w, len(index)) for w in words_of(t or "") if w] for t in texts]
    words = list(index)
    toxic = np.array(toxic, int)
    n = np.maximum(np.bincount(toxic, minlength=2), 1)
    seen: list[Counter] = [Counter(), Counter()]
    for d, y in zip(docs, toxic):
        seen[y].update({f for w in set(d) for f in word_features(words[w])[:-1]})
    least = max(3, 0.002 * n[1])
    marked = {f for f, c in seen[1].items() if c >= least and (c / n[1]) / ((seen[0][f] + 0.5) / n[0]) > 12}
    hit = np.array([any(f in marked for f in word_features(w)[:-1]) for w in words], bool)
    seen.clear()
    bank = _slots(words)
    bank[:, :5][bank[:, :5] == BUCKETS] = BUCKETS + 1
    chains, labels = [], []
    for d, y in zip(docs, toxic):
        d = np.array(d, np.int64)
        for i in range(0, len(d), 200):
            chains.append(d[i : i + 200])
            labels.append(hit[d[i : i + 200]] & (y == 1))
    weights, trans = _train_chain(bank, chains, labels)
    model = Model(weights, trans, np.zeros(4))
    lengths = np.array([len(d) for d in docs], np.int64)
    own = model.word_scores(words) if words else np.zeros(0)
    x = _doc_features(marginals(own[np.concatenate([np.array(d, np.int64) for d in docs])] if docs else own, lengths, trans), lengths)
    side = np.where(toxic == 1, share / n[1], (1 - share) / n[0]) * len(toxic)
    top = np.zeros(4)
    for _ in range(400):
        p = 1 / (1 + np.exp(-x @ top))
        h = (x * (side * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        step = np.linalg.solve(h, x.T @ (side * (toxic - p)) - 0.05 * top)
        top = top + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    model.top = top
    return model


def remainder(id_col) -> "F.Column":
    return F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``rows`` labelled rows of either label whose id's CRC-32 is not divisible by five.

    Rows without an id, text or label take no part, nor do texts of over ``most_bytes``, so that what reaches
    the driver is bounded; of rows with one id one takes part. Chains are cut at 200 words for the fit alone. Without any labelled row of both labels, scores are
    those of an untrained model.
    """
    lab = labels.where(F.col("toxic").isin(0, 1) & (remainder(F.col(id_col)) != 0)).select(id_col, "toxic")
    both = lab.groupBy("toxic").count().collect()
    count = {r["toxic"]: r["count"] for r in both}
    share = count.get(1, 0) / max(1, sum(count.values()))
    first = [lab.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(11), F.col(id_col)), id_col).limit(rows) for y in (0, 1)]
    picked = first[0].unionByName(first[1])
    fits = docs.where(F.octet_length(F.col(f"`{text_col}`")) <= most_bytes).select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("t"))
    found = fits.join(F.broadcast(picked.withColumnRenamed(id_col, "__id")), "__id")  # at most 2 * rows rows of two numbers
    one = Window.partitionBy("__id").orderBy(F.xxhash64("t"), "t", "toxic")  # repeated ids: one text each
    sample = found.withColumn("__r", F.row_number().over(one)).where("__r = 1").select(F.xxhash64(F.lit(11), "__id").alias("h"), "__id", "t", "toxic").collect()
    sample.sort(key=lambda r: (r["h"], r["__id"]))  # the fit does not depend on how files are laid out
    texts, toxic = [r["t"] for r in sample], [r["toxic"] for r in sample]
    return fit(texts, toxic, min(max(share, 0.01), 0.99))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` and, if asked for, ``toxic_spans`` (code points, end exclusive).

    Whole texts are scored; a null text counts as empty, whose score is that of a text without words.
    Columns of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        release()
        model = shared.value
        held: dict[str, float] = {}

        def run(column):
            every = [t or "" for t in column.to_pylist()]
            parts = [part(every[a:b]) for a, b in in_slices(every, 1 << 22)]
            return [pa.concat_arrays(x) for x in zip(*parts)]

        def part(texts):
            plain = pa.array([t.lower().translate(_TO_SPACE) for t in texts], pa.large_string())
            lists = pc.split_pattern(plain, " ")
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(held) > WORDS:
                held.clear()
            new = [w for w in words if w not in held]
            for i in range(0, len(new), 50_000):
                held.update(zip(new[i : i + 50_000], model.word_scores(new[i : i + 50_000]).tolist()))
            own = np.array([held[w] for w in words])
            full = np.array([w != "" for w in words], bool)
            idx = coded.indices.to_numpy()
            at = lists.offsets.to_numpy()
            there = full[idx] if len(idx) else np.zeros(0, bool)
            ends = np.concatenate(([0], np.cumsum(there)))
            lengths = ends[at[1:] - at[0]] - ends[at[:-1] - at[0]]
            odds = marginals(own[idx[there]] if len(idx) else np.zeros(0), lengths, model.trans)
            p = 1 / (1 + np.exp(-_doc_features(odds, lengths) @ model.top))
            out = [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            if spans:
                found, at = [], 0
                for t, k in zip(texts, lengths.tolist()):
                    hot = np.flatnonzero(odds[at : at + k] > 0)
                    at += k
                    where = [m.span() for m in _WORD.finditer(t)] if len(hot) else []
                    # lower() can change the number of words of a text only by characters that grow
                    found.append([list(where[j]) for j in hot.tolist() if j < len(where)])
                out.append(pa.array(found, pa.list_(pa.list_(pa.int32()))))
            return out

        return run

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if spans:
        fields.append(T.StructField("toxic_spans", T.ArrayType(T.ArrayType(T.IntegerType()))))
    return add_columns(docs, [text_col], fields, factory, keep)
