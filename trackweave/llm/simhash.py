"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves of 32 bits. Two fingerprints that differ in at most
two bits either have high halves that differ in at most one bit, or equal low halves. The index
therefore holds 32 one-wildcard variants of the high half and the low half itself; an equality
grouping on these 33 signatures meets every pair, and the whole fingerprints decide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, connected_components, materialize

SEED = 42
#: A signature with more fingerprints than this is split by finer signatures instead.
DENSE = 64


#: Bytes of a text whose shingles are hashed at a time.
PART = 1 << 22
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _hashes(words: list[bytes], width: int) -> list[int]:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def shingle_parts(text: str | None, width: int = 3):
    """The shingles' hashes of a text, part by part; words are cut at ASCII white space and lower-cased A-Z."""
    raw, at, carry, some = (text or "").encode("utf-8", "surrogatepass"), 0, [], False
    while at < len(raw):
        gap = _GAP.search(raw, at + PART) if at + PART < len(raw) else None
        end = gap.end() if gap else len(raw)
        words = carry + raw[at:end].lower().split()
        at = end
        if len(words) >= width:
            yield _hashes(words, width)
            some = True
        carry = words[max(0, len(words) - width + 1) :]
    if carry and not some:
        yield [xxhash.xxh64_intdigest(b" ".join(carry), SEED)]


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    return [h for part in shingle_parts(text, width) for h in part]


def fingerprints(texts: list[str | None], width: int = 3, block: int = 1 << 19) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: a bit is 1 if set in over half of the hashes."""
    out = np.zeros(len(texts), np.uint64)
    one = np.uint64(1)
    shifts = np.arange(64, dtype=np.uint64)

    def close(rows, counts, hashes):
        if not rows:
            return
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.concatenate(([0], np.cumsum(counts)[:-1]))
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        on = (2 * sums > np.array(counts)[:, None]).astype(np.uint64)
        out[rows] = (on * (one << shifts)).sum(axis=1, dtype=np.uint64)

    rows, counts, hashes = [], [], []
    for i, text in enumerate(texts):
        if len(text or "") > PART:  # summed part by part
            sums, n = np.zeros(64, np.int64), 0
            for h in shingle_parts(text, width):
                for k in range(0, len(h), 1 << 16):
                    sums += np.unpackbits(np.array(h[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                n += len(h)
            out[i] = ((2 * sums > n).astype(np.uint64) * (one << shifts)).sum(dtype=np.uint64)
            continue
        h = shingle_hashes(text, width)
        if h:
            rows.append(i)
            counts.append(len(h))
            hashes += h
        if len(hashes) >= block:
            close(rows, counts, hashes)
            rows, counts, hashes = [], [], []
    close(rows, counts, hashes)
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", width: int = 3, keep=None) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long (null and blank texts: 0)."""

    def factory():
        return lambda texts: [pa.array(fingerprints(texts.to_pylist(), width).view(np.int64))]

    return add_columns(docs, [text_col], [T.StructField("fp", T.LongType())], factory, keep)


def _signatures(fps: DataFrame) -> DataFrame:
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    k = F.col("k")
    masked = hi.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, k)")))
    key = F.when(k < 32, masked.bitwiseOR(F.expr("shiftleft(CAST(k AS BIGINT), 32)"))).otherwise(lo.bitwiseOR(F.lit(32 << 32)))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("k")).select("fp", key.alias("sig"))


def _links_in_order(batches):
    """Verified links of signature-sorted (sig, fp) rows; a spanning forest of each signature."""
    keep_sig, keep_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(sig, fp):
        u, v = [], []
        group = np.concatenate(([0], np.cumsum(sig[1:] != sig[:-1]))) if len(sig) else np.empty(0, int)
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = parent[x]
            return x

        kind = (sig >> 32).astype(np.uint64)
        for d in range(1, DENSE):
            if d >= len(sig):
                break
            same = group[d:] == group[:-d]
            if not same.any():
                break
            i = np.flatnonzero(same)
            x = fp[i] ^ fp[i + d]
            near = np.bitwise_count(x) <= 2
            i, x = i[near], x[near]
            high = x >> np.uint64(32)
            one = np.bitwise_count(high)
            k = kind[i]
            # each pair is taken at one of the signatures that it shares
            own = np.where(k < 32, (one == 1) | ((one == 0) & (k == 0)), one == 2)
            for a in i[own].tolist():
                p, q = find(a), find(a + d)
                if p != q:
                    parent[p] = q
                    u.append(a)
                    v.append(a + d)
        return pa.RecordBatch.from_arrays([pa.array(fp[u].view(np.int64)), pa.array(fp[v].view(np.int64))], names=["u", "v"])

    for batch in batches:
        sig = np.concatenate((keep_sig, batch.column(0).to_numpy()))
        fp = np.concatenate((keep_fp, batch.column(1).to_numpy().view(np.uint64)))
        if not len(sig):
            continue
        cut = int(np.searchsorted(sig, sig[-1]))
        keep_sig, keep_fp = sig[cut:], fp[cut:]
        yield links(sig[:cut], fp[:cut])
    yield links(keep_sig, keep_fp)


def _dense_links(rows: DataFrame) -> DataFrame:
    """Links of signatures with very many fingerprints, by finer signatures.

    Wildcards at the bits (i, j) leave groups of at most four distinct fingerprints, all within two
    bits of each other, so that each group is linked to its smallest member without comparisons.
    """
    k = F.shiftrightunsigned("sig", 32)
    pairs = F.expr("flatten(transform(sequence(0, 30), a -> transform(sequence(a + 1, 31), b -> struct(a AS i, b AS j))))")
    lows = F.expr("transform(sequence(0, 31), b -> struct(CAST(shiftrightunsigned(sig, 32) AS INT) + 32 AS i, b AS j))")
    highs = F.transform(pairs, lambda p: F.struct((p["i"] + 32).alias("i"), (p["j"] + 32).alias("j")))
    wild = F.when(k == 32, highs).when(k == 0, F.concat(pairs, lows)).otherwise(lows)
    masked = F.expr("fp & ~(shiftleft(1L, w.i) | shiftleft(1L, w.j))")
    groups = (
        rows.select("fp", F.explode(wild).alias("w"))
        .select("fp", F.col("w.i").alias("i"), F.col("w.j").alias("j"), masked.alias("rest"))
        .groupBy("i", "j", "rest")
        .agg(F.collect_set("fp").alias("m"))
        .where(F.size("m") > 1)
    )
    return groups.select(F.array_min("m").alias("u"), F.explode("m").alias("v")).where("u <> v")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fps(fp)`` within two bits.

    Every two such fingerprints are connected, directly or through others, by links whose ends
    differ in at most two bits; repeats are not all listed.
    """
    sigs = _signatures(fps)
    counts = materialize(sigs.groupBy("sig").count().where(F.col("count") > DENSE).select("sig"), "dense")
    n = counts.count()
    if n == 0:
        sparse, dense = sigs, None
    else:
        side = F.broadcast(counts) if n <= 100_000 else counts  # 8 bytes a row
        sparse, dense = sigs.join(side, "sig", "left_anti"), sigs.join(side, "sig", "left_semi")
    out = sparse.select("sig", "fp").repartition("sig").sortWithinPartitions("sig").mapInArrow(_links_in_order, "u long, v long")
    return out if dense is None else out.unionByName(_dense_links(dense))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row a document: id, ``fp``, ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the smallest id that is reachable over links of two or fewer bits. Null and
    blank texts have fingerprint zero and are linked like others; repeated ids keep their rows; a
    row whose id is null belongs to its group, whose smallest id may be null if all are. An empty
    table gives an empty result. Other columns are not passed on.
    """
    fp = materialize(with_fingerprint(docs, text_col, width, keep=[id_col]).select(F.col(f"`{id_col}`").alias(id_col), "fp"), "fp")
    nodes = fp.groupBy("fp").agg(F.min(id_col).alias("low"))
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = labelled.join(lows, "root").select("fp", "component_id")
    return fp.join(by_fp, "fp").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id stays.

    Rows that share the smallest id stay together. Rows without an id have nothing to be told apart by
    and stay if no row of their component has one.
    """
    marks = near_duplicates(docs, id_col, text_col)
    kept = materialize(marks.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__kept")).distinct(), "kept")
    # ids grow with the input, so that they are never broadcast: one plan at every size
    return docs.join(kept.hint("merge"), docs[f"`{id_col}`"].eqNullSafe(kept["__kept"]), "left_semi")
