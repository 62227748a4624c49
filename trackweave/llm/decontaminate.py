"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of consecutive benchmark words. A block is two words: the shift table tells
how far the search may move on from the block before it, blocks that end a pattern lead to a bucket
by that suffix, and the whole window of words is compared with the bucket's patterns.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialize

WINDOW = 10
#: Benchmark texts are searched in blocks of about so many bytes, each shipped to all tasks.
BLOCK_BYTES = 2 << 20

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and all that is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Patterns:
    """The search tables of patterns with ``m`` words each."""

    def __init__(self, m: int, found: dict[tuple[bytes, ...], frozenset[str]]):
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], frozenset[str]]] = defaultdict(dict)
        for pattern, items in found.items():
            for j in range(self.b, m + 1):
                block = pattern[j - self.b : j]
                self.shift[block] = min(self.shift.get(block, self.most), m - j)
            self.buckets[pattern[m - self.b :]][pattern] = items

    def search(self, words: list[bytes]):
        """(position of the last word, items) of every occurrence."""
        m, b, most, shift, buckets = self.m, self.b, self.most, self.shift.get, self.buckets
        i, n = m, len(words)
        while i <= n:
            move = shift(tuple(words[i - b : i]), most)
            if move:
                i += move
                continue
            items = buckets[tuple(words[i - b : i])].get(tuple(words[i - m : i]))
            if items:
                yield i, items
            i += 1

#: Blocks that are searched for in one stage; then what was found is written.
PASSES = 4


def build(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], frozenset[str]]] = defaultdict(dict)
    known: dict[bytes, bytes] = {}  # one object a word
    alone: dict[str, frozenset[str]] = {}
    for item, text in items:
        words = [known.setdefault(w, w) for w in words_of(text)]
        own = alone.setdefault(item, frozenset((item,)))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            pattern = tuple(words[i : i + m])
            found = by_length[m].get(pattern, own)
            by_length[m][pattern] = found if item in found else found | own
    return [Patterns(m, found) for m, found in by_length.items()]


def _spans(words: list[bytes], tables: list[Patterns]) -> tuple[list[tuple[int, int]], set[str]]:
    hits: list[tuple[int, int]] = []
    items: set[str] = set()
    for t in tables:
        for end, found in t.search(words):
            hits.append((end - t.m, end))
            items |= found
    return _union(hits), items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_overlap(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted strings), hit_spans (word offsets, end exclusive), contaminated.

    The benchmark is split by size into blocks of about ``block_bytes``; every block is searched for in
    all documents, and the columns gather what was found. Null texts have no words; benchmark rows with a null
    id or no words take no part; repeated item ids are one item; an empty benchmark gives no hits.
    Columns of ``docs`` with one of these names are replaced.
    """
    b = benchmark.where(F.col(f"`{item_id}`").isNotNull() & F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("words"))
    size = b.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    span = T.ArrayType(T.ArrayType(T.IntegerType()))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", span), T.StructField("contaminated", T.BooleanType())]
    names = [f.name for f in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    again = text_col in kept  # the text goes to the tasks once
    name = text_col if again else "__text"
    out = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if again else [F.col(f"`{text_col}`").alias(name)]))
    for k in range(blocks):
        items = [(r.item, r.words) for r in b.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).collect()]  # about block_bytes
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def factory(shared=shared, first=k == 0):
            tables = build(shared.value, window)

            def run(texts, *before):
                old_items, old_spans = ([None] * len(texts), [None] * len(texts)) if first else (x.to_pylist() for x in before)
                n, hit, ids, spans = [], [], [], []
                for text, i, s in zip(texts.to_pylist(), old_items, old_spans):
                    words = words_of(text)
                    found, own = _spans(words, tables)
                    found = _union(found + [tuple(x) for x in s or []])
                    n.append(len(words))
                    hit.append(sum(e - a for a, e in found))
                    ids.append(sorted(own | set(i or [])))
                    spans.append([list(x) for x in found])
                return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array([h > 0 for h in hit])]

            return run

        if k and k % PASSES == 0:  # so many blocks to a stage: each has a Python worker with its tables
            out = materialize(out, "searched")
        out = add_columns(out, [name] + ([] if k == 0 else ["item_ids", "hit_spans"]), fields, factory, keep=[*kept, *([name] if k + 1 < blocks and not again else [])])
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    own = [f"__c{i}" for i in range(len(docs.columns))]  # no name of theirs is replaced
    found = benchmark_overlap(docs.toDF(*own), benchmark, own[docs.columns.index("text")], window=window)
    return found.where(~F.col("contaminated")).select(*own).toDF(*docs.columns)
