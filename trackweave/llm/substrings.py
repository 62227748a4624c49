"""Removal of byte strings that occur twice, over sorted suffixes.

Every string of LENGTH bytes holds the least of its GRAM-byte substrings, by a hash and then the last
position; two equal strings agree on that anchor. Positions that share an anchor form a run, whose
context is all that its strings cover. So suffixes need sorting only where an anchor occurs again:

1. runs are grouped by anchor; where a whole context occurs twice, all its strings do;
2. one run of each other context goes on if its anchor has several contexts. These contexts are
   range-partitioned by their leading bytes from the anchor on (Spark samples the splitters), the suffixes that
   start in them are sorted by eight-byte keys, each key only within ties of those before (multikey sort), and
   neighbours that agree on LENGTH bytes are repeated. Equal strings have equal anchors and so the same range
   key: no pair of neighbours is parted by a boundary;
3. covered bytes are united by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, materialize

LENGTH, GRAM = 200, 64
#: Bytes hashed at once, and contexts sorted at once.
SLICE, CONTEXTS = 1 << 20, 8192
#: An anchor with more runs than this is not gathered in one task.
HOT = 10_000
#: So many hashes of texts with copies are broadcast; beyond, they are joined by a shuffle.
COPIED = 1_000_000
_POS = 28
_MASK = np.uint64((1 << _POS) - 1)


def _tables():
    rng = np.random.default_rng(12)
    t = rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    inv = np.uint64(pow(int(base), -1, 1 << 64))
    n = 5 * SLICE
    up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base))), dtype=np.uint64)
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inv))), dtype=np.uint64)
    return t, up, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, tables, length: int = LENGTH, gram: int = GRAM):
    """Runs of the texts that lie end to end in ``buf``: text nr, anchor hash, context hash, anchor, first and last start."""
    none = (np.zeros(0, np.int64),) * 6
    n = len(buf)
    if n < length:
        return none
    t, up, down = tables
    total = np.concatenate(([np.uint64(0)], np.cumsum(t[0][buf] * up[:n], dtype=np.uint64)))
    grams = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    key = (_mix(grams) & ~_MASK) | (_MASK - np.arange(len(grams), dtype=np.uint64))
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    place = (_MASK - (key & _MASK)).astype(np.int64)  # of each start 0 .. n - length
    first = np.repeat(begins, np.maximum(ends - begins - length + 1, 0))
    counts = np.maximum(ends - begins - length + 1, 0)
    if not counts.sum():
        return none
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first
    owner = np.repeat(np.arange(len(begins)), counts)
    p = place[at]
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (owner[1:] != owner[:-1])))
    lo = np.flatnonzero(new)
    hi = np.concatenate((lo[1:] - 1, [len(at) - 1]))
    doc, p, lo, hi = owner[lo], p[lo], at[lo], at[hi]
    total2 = np.concatenate(([np.uint64(0)], np.cumsum(t[1][buf] * up[:n], dtype=np.uint64)))
    context = _mix((total2[hi + length] - total2[lo]) * down[lo] + ((p - lo) * 1009 + (hi - lo)).astype(np.uint64))
    return doc, _mix(grams[p]).view(np.int64), context.view(np.int64), p - begins[doc], lo - begins[doc], hi - begins[doc]


def text_runs(texts: list[bytes], tables, length: int = LENGTH, gram: int = GRAM):
    """Runs of all texts, slice by slice; a text over four slices is cut into parts that overlap by a string."""
    parts = []
    for i, t in enumerate(texts):
        step = 4 * SLICE - length
        for a in range(0, max(1, len(t) - length + 1), step):
            parts.append((i, a, t[a : a + step + length - 1] if len(t) > step else t))
    out, group, size = [], [], 0

    def flush():
        if group:
            lens = np.array([len(x) for _, _, x in group])
            ends = np.cumsum(lens)
            doc, g, c, p, lo, hi = runs(np.frombuffer(b"".join(x for _, _, x in group), np.uint8), ends - lens, ends, tables, length, gram)
            own, shift = np.array([i for i, _, _ in group]), np.array([a for _, a, _ in group])
            out.append((own[doc], g, c, p + shift[doc], lo + shift[doc], hi + shift[doc]))

    for part in parts:
        if group and size + len(part[2]) > SLICE:
            flush()
            group, size = [], 0
        group.append(part)
        size += len(part[2])
    flush()
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def same_strings(windows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True for rows of bytes that equal another of the same group: a multikey sort, eight bytes a key."""
    n, width = windows.shape
    pad = -width % 8
    if pad:
        windows = np.concatenate((windows, np.zeros((n, pad), np.uint8)), axis=1)
    words = np.ascontiguousarray(windows).view(">u8")
    rows, tie = np.arange(n), group.astype(np.int64)
    for k in range(-1, words.shape[1]):
        key = words[rows, k].astype(np.uint64) if k >= 0 else np.zeros(len(rows), np.uint64)
        order = np.lexsort((key, tie))
        rows, tie, key = rows[order], tie[order], key[order]
        new = np.concatenate(([True], (tie[1:] != tie[:-1]) | (key[1:] != key[:-1]))) if len(rows) else np.zeros(0, bool)
        tie = np.cumsum(new)
        alone = new & np.concatenate((new[1:], [True])) if len(rows) else new
        rows, tie = rows[~alone], tie[~alone]
        if not len(rows):
            break
    out = np.zeros(n, bool)
    out[rows] = True
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _find_runs(length: int, gram: int):
    def run(batches):
        tables = _tables()
        for batch in batches:
            uid = batch.column(0).to_numpy()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            doc, g, c, p, lo, hi = text_runs(texts, tables, length, gram)
            if len(doc):
                # equal contexts of one text are one row, which holds the places of the others
                key = _mix(c.view(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.argsort(key, kind="stable")
                doc, g, c, pos, key = doc[order], g[order], c[order], ((lo << 16) | ((p - lo) << 8) | (hi - lo))[order], key[order]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (c[1:] != c[:-1]) | (g[1:] != g[:-1])))
                heads = np.flatnonzero(new)
                others = np.diff(np.concatenate((heads, [len(new)]))) - 1
                more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(others))).astype(np.int32)), pa.array(pos[~new]), mask=pa.array(others == 0))
                yield pa.RecordBatch.from_arrays([pa.array(uid[doc[heads]]), pa.array(g[heads]), pa.array(c[heads]), pa.array(pos[heads]), more], names=["uid", "g", "c", "pos", "more"])

    return run


def _cut_contexts(length: int):
    """The bytes of each open context, with its leading bytes from the anchor on as an ordered number."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for uid, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for f in found:
                    pos = f["pos"]
                    lo, p, n = pos >> 16, pos >> 8 & 255, pos & 255
                    # contexts of hot anchors are not sorted here, and lie anywhere
                    lead = uid ^ pos if f["hot"] else int.from_bytes(raw[lo + p : lo + p + 8], "big") - (1 << 63)
                    for column, v in zip(cols, (lead, f["g"], uid, pos, raw[lo : lo + n + length], f["hot"])):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["lead", "g", "uid", "pos", "bytes", "hot"])

    return run


def repeated_starts(g: np.ndarray, pos: np.ndarray, contexts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(context nr, first, last start) of runs of starts whose string is met in another context of its anchor.

    Equal strings have their anchor at the same place, so the suffixes are sorted place by place.
    """
    lo, p, n = pos >> 16, pos >> 8 & 255, pos & 255
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(x) for x in contexts])))[:-1]
    views = np.lib.stride_tricks.sliding_window_view(buf, length) if len(buf) >= length else np.zeros((0, length), np.uint8)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for before in range(int(p.max(initial=-1)) + 1):
        off = p - before  # of the start within the context
        own = np.flatnonzero((off >= 0) & (off <= n))
        if len(own) > 1:
            rep = same_strings(views[at[own] + off[own]], g[own])
            hits.append((own[rep], (lo + off)[own[rep]]))
    if not hits:
        return []
    who, start = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    if not len(who):
        return []
    new = np.concatenate(([True], (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(who) - 1]))
    return list(zip(who[new].tolist(), start[new].tolist(), start[last].tolist()))


_FOUND = "uid long, lo long, hi long, g long, pos long, bytes binary"


def _sort_contexts(length: int, limit: int):
    """Spans of repeated strings; contexts of an anchor with over ``limit`` of them are handed on."""

    def run(batches):
        def rows(spans, big):
            k, m = len(spans), len(big)
            cols = [[x[0] for x in spans] + [x[1] for x in big], [x[1] for x in spans] + [None] * m, [x[2] for x in spans] + [None] * m, [None] * k + [x[0] for x in big], [None] * k + [x[2] for x in big], [None] * k + [x[3] for x in big]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.binary()) for i, c in enumerate(cols)], names=["uid", "lo", "hi", "g", "pos", "bytes"])

        def solve(held):
            g = np.array([x[0] for x in held], np.int64)
            found = repeated_starts(g, np.array([x[2] for x in held], np.int64), [x[3] for x in held], length)
            return [(held[i][1], a, b + length) for i, a, b in found]

        held, group, big = [], [], None  # complete groups; the one at hand; the anchor of a large one
        for batch in batches:
            out, spans = [], []
            for *row, hot in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4, 5))):
                if hot or row[0] == big:
                    out.append(row)
                    continue
                if group and group[0][0] != row[0]:
                    held += group
                    group = []
                    if len(held) >= limit:
                        spans += solve(held)
                        held = []
                group.append(row)
                if len(group) > limit:
                    big, out, group = row[0], out + group, []
            if spans or out:
                yield rows(spans, out)
        if held or group:
            yield rows(solve(held + group), [])

    return run


def _windows(length: int):
    """A row for every string of the contexts of very frequent anchors: two digests and its place."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for uid, pos, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k in range((pos & 255) + 1):
                    d = hashlib.blake2b(raw[k : k + length], digest_size=16).digest()
                    for column, v in zip(cols, (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), uid, (pos >> 16) + k)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["a", "b", "uid", "lo"])

    return run


def repeated_spans(docs: DataFrame, uid: str, text: str, length: int = LENGTH, gram: int = GRAM, contexts: int = CONTEXTS, hot: int = HOT) -> DataFrame:
    """(uid, lo, hi): byte spans that together cover all strings of ``length`` bytes that start twice or more."""
    from pyspark.sql import Window

    assert gram < length <= gram + 254
    rows = docs.select(uid, text).where(F.octet_length(text) >= length)
    everything = rows.mapInArrow(_find_runs(length, gram), "uid long, g long, c long, pos long, more array<long>")
    crowded = materialize(everything.groupBy("g").count().where(F.col("count") > hot).select("g"), "crowded")
    some = crowded.count()
    side = F.broadcast(crowded) if some <= 1_000_000 else crowded  # 8 bytes a row
    found = everything.join(side, "g", "left_anti") if some else everything
    w = Window.partitionBy("g").orderBy("c")
    before, after = F.lag("c").over(w), F.lead("c").over(w)
    lowest = F.first("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = found.select("uid", "g", "pos", "more", "c", before.alias("p"), after.alias("n"), lowest.alias("f"))
    marked = marked.select(
        "uid", "g", "pos", "more",
        F.coalesce(F.when(F.col("more").isNotNull(), True), (F.col("c") == F.col("p")) | (F.col("c") == F.col("n")), F.col("c") == F.coalesce("p", "n"), F.lit(False)).alias("whole"),
        # one run of each context, where the anchor has several: of the lowest context the last one
        F.coalesce(F.when(F.col("c") == F.col("f"), F.col("n") != F.col("c")).otherwise(F.col("p") != F.col("c")), F.lit(False)).alias("open"),
    )
    marked = marked.where("whole OR open").withColumn("hot", F.lit(False))
    if some:
        # of a crowded anchor, equal contexts are counted before any shuffle, and a join that can be split marks them
        many = everything.join(side, "g", "left_semi")
        each = materialize(many.groupBy("g", "c").agg(F.sum(F.when(F.col("more").isNull(), 1).otherwise(2)).alias("n"), F.first("uid").alias("uid"), F.first("pos").alias("pos")), "contexts")
        met = many.join(each.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").select("uid", "g", "pos", "more", F.lit(True).alias("whole"), F.lit(False).alias("open"), F.lit(True).alias("hot"))
        own = each.select("uid", "g", "pos", F.lit(None).cast("array<long>").alias("more"), F.lit(False).alias("whole"), F.lit(True).alias("open"), F.lit(True).alias("hot"))
        marked = marked.unionByName(met).unionByName(own)
    marked = materialize(marked, "runs")
    span = lambda df: df.select("uid", "lo", "hi")
    lo = F.shiftright("pos", 16)
    places = F.when(F.col("more").isNull(), F.array("pos")).otherwise(F.concat(F.array("pos"), "more"))
    whole = marked.where("whole").select("uid", F.explode(places).alias("pos")).select("uid", lo.alias("lo"), (lo + F.col("pos").bitwiseAND(255) + length).alias("hi"))
    wanted = marked.where("open").groupBy("uid").agg(F.collect_list(F.struct("g", "pos", "hot")).alias("found"))  # of one text
    cut = rows.withColumnRenamed(uid, "uid").join(wanted, "uid").select("uid", text, "found").mapInArrow(_cut_contexts(length), "lead long, g long, uid long, pos long, bytes binary, hot boolean")
    dealt = cut.repartitionByRange("lead", "g").sortWithinPartitions("lead", "g")
    looked = materialize(dealt.mapInArrow(_sort_contexts(length, contexts), _FOUND), "suffixes")
    many = looked.where("lo IS NULL").select("uid", "pos", "bytes").mapInArrow(_windows(length), "a long, b long, uid long, lo long")
    times = many.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    often = many.join(times, ["a", "b"]).select("uid", "lo", (F.col("lo") + length).alias("hi"))
    return whole.unionByName(span(looked.where("lo IS NOT NULL"))).unionByName(often)


def identified(rows: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``uid``, a hash of ``bits`` of ``__text`` that no two different texts share, and (uid, n), the rows of each.

    Texts of one hash are told apart by SHA-256; where there are any, another seed is taken for all.
    """
    seed = 0
    while True:
        hashed = F.xxhash64(F.lit(seed), "__text")
        own = rows.withColumn("uid", hashed if bits == 64 else F.pmod(hashed, F.lit(1 << bits)))
        digest = F.sha2("__text", 256)
        counts = materialize(own.groupBy("uid").agg(F.count("*").alias("n"), F.min(digest).alias("a"), F.max(digest).alias("b")).select("uid", "n", (F.col("a") != F.col("b")).alias("clash")), "texts")
        if counts.where("clash").isEmpty():
            return own, counts.select("uid", "n")
        seed += 1


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS, hot: int = HOT) -> DataFrame:
    """Of each document: id, n_bytes, n_removed, n_spans, kept (the remaining bytes), removed (spans), kept_sha256.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same
    document or another; strings are judged on the input. Null texts are empty; texts shorter than
    ``length`` stay; rows with equal id and text are documents of their own, and so remove each other.
    """
    d, counts = identified(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")))
    # of equal texts one is searched: each string of a text that is there twice is repeated
    copied = counts.where("n > 1").select("uid")
    side = F.broadcast(copied) if copied.count() <= COPIED else copied  # 8 bytes a row
    alone, copies = d.join(side, "uid", "left_anti"), d.join(side, "uid", "left_semi")
    one = materialize(copies.where(F.octet_length("__text") >= length).groupBy("uid").agg(F.first("__text").alias("__text")), "texts")
    spans = repeated_spans(alone.select("uid", "__text").unionByName(one), "uid", "__text", length, gram, contexts, hot)
    # spans of one text, of which there are fewer than bytes
    by = spans.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    n = F.octet_length("__text").cast("long")
    all_of_it = F.when(n >= length, F.array(F.struct(F.lit(0).cast("long").alias("lo"), n.alias("hi"))))
    joined = alone.join(by, "uid", "left").select("__id", "__text", "spans").unionByName(copies.select("__id", "__text", all_of_it.alias("spans")))

    def factory():
        def run(texts, spans):
            cols: list[list] = [[], [], [], [], [], []]
            for text, found in zip(texts.to_pylist(), spans.to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                own = union([(f["lo"], f["hi"]) for f in found or []])
                at, kept = 0, []
                for a, b in own:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join(kept) + raw[at:]
                for column, v in zip(cols, (len(raw), len(raw) - len(kept), len(own), kept, [list(x) for x in own], hashlib.sha256(kept).hexdigest())):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.string())
            return [pa.array(c, t) for c, t in zip(cols, kinds)]

        return run

    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_sha256", T.StringType())]
    return add_columns(joined, ["__text", "spans"], fields, factory, keep=["__id"]).withColumnRenamed("__id", id_col)
