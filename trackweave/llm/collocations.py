"""Phrases that occur together more often than chance, mined level by level.

Every level is one pass over the texts: a phrase of k words is counted only where both phrases of k - 1
words in it are frequent, as no other can be. The frequent phrases go to the tasks as a bitmap of hashes
of bounded size. It never misses one, so that a false hit costs a count that the threshold removes again;
the counts themselves are by the words. A candidate is scored by its cuts, whose halves are looked up in
the tables of the levels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of the bitmap for each frequent phrase, and of the whole bitmap at the least and at the most.
BITS_EACH, BITS = 32, (1 << 16, 1 << 28)
#: Longer texts are worked on in windows of so many bytes, which end between words.
WINDOW = 1 << 22
#: Parts of a language that are ranked apart before their heads are ranked together.
PARTS = 64

_KIND = np.zeros(256, np.uint8)  # of a byte: 0 of a word, 1 between words, 2 between pieces
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = re.compile(rb"[\t-\r .,;:!?]")
_WORD = re.compile(rb"[^\t-\r .,;:!?]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of texts in a row: codes into ``names``, piece and language; ``own`` of them begin phrases."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, own: int | None = None):
        kind, n = _KIND[data], len(data)
        inside = kind == 0
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        before[cuts], after[cuts - 1] = False, False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
        ends = np.zeros(len(first) + 1, np.int32)
        ends[1:] = np.cumsum(last - first + 1)
        coded = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])).dictionary_encode()
        self.names = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        text = np.searchsorted(offsets, first, side="right") - 1
        self.piece = text + np.searchsorted(np.flatnonzero(kind == 2), first)
        self.lang = langs[text]
        self.own = len(first) if own is None else int(np.searchsorted(first, own))


def words_of(texts: pa.Array, langs: np.ndarray, k: int, window: int = WINDOW) -> Iterator[Words]:
    """The words of all ``texts``; very long ones in windows, each with the ``k`` - 1 words that follow it."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    long = np.flatnonzero(np.diff(offsets) > window)
    at = 0
    for i in [*long.tolist(), len(texts)]:
        if i > at:
            yield Words(data[offsets[at] : offsets[i]], offsets[at : i + 1] - offsets[at], langs[at:i])
        if i < len(texts):
            whole, lo = data[offsets[i] : offsets[i + 1]].tobytes(), 0
            while lo < len(whole):
                cut = _BETWEEN.search(whole, lo + window)
                hi = end = cut.end() if cut else len(whole)
                for m, _ in zip(_WORD.finditer(whole, hi), range(k - 1)):
                    end = m.end()
                part = np.frombuffer(whole[lo:end], np.uint8)
                yield Words(part, np.array([0, end - lo]), langs[i : i + 1], hi - lo)
                lo = hi
        at = i + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def hashes(names: list, lang: list) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in names], np.uint64), np.array([digest(w, 1) for w in lang], np.uint64)


def extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases, of the hashes of all but their last word (at first: of the language) and of that word."""
    return _mix(h * _ODD + word)


class Bitmap:
    """A set of hashes of bounded size: says yes to each of its own, and to few others while it is not crowded."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[slots] = values

    @staticmethod
    def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(bits - 1)
        return h & mask, (h >> np.uint64(32)) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h, int(self.mask) + 1):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def bitmap_of(frequent: DataFrame, count: int, bits: tuple[int, int] = BITS) -> Bitmap:
    """The bitmap of (lang, phrase), from slots that are joined in Spark: at most ``bits[1]`` / 64 rows reach the driver."""
    size = bits[0]
    while size < min(BITS_EACH * count, bits[1]):
        size *= 2

    def run(batches):
        for b in batches:
            langs, phrases = b.column(0).to_pylist(), b.column(1).to_pylist()
            own = np.zeros(len(phrases), np.uint64)
            for i, (lang, phrase) in enumerate(zip(langs, phrases)):
                w, h = hashes(phrase.split(" "), [lang])
                for j in range(len(w)):
                    h = extended(h, w[j : j + 1])
                own[i] = h[0]
            p = np.concatenate(Bitmap.places(own, size)) if len(own) else own
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["slot", "bit"])

    slots = frequent.select("lang", "phrase").mapInArrow(run, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    return Bitmap(size, slots["slot"].to_numpy(), slots["bit"].to_numpy().view(np.uint64))


def emitted(w: Words, langs: list[str], k: int, frequent: Bitmap | None) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of the distinct phrases of ``k`` words whose both parts may be frequent."""
    n = len(w.codes)
    at = np.arange(n)
    if frequent is not None:
        names, lang = hashes(w.names.to_pylist(), langs)
        word = names[w.codes]
        h = extended(lang[w.lang], word)
        alive = frequent.has(h)
        for j in range(2, k + 1):
            both = np.zeros(n, bool)
            m = n - j + 1
            if m > 0:
                both[:m] = alive[:m] & alive[1 : m + 1] & (w.piece[:m] == w.piece[j - 1 :])
            at = np.flatnonzero(both)
            if j == k:
                break
            h[at] = extended(h[at], word[at + j - 1])
            alive = both
            alive[at] = frequent.has(h[at])
    at = at[at < w.own]
    size = max(1, len(w.names))
    key, bound = w.lang[at].astype(np.int64), max(1, len(langs))
    for j in range(k):
        if bound * size >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            bound = len(key) + 1
        key, bound = key * size + w.codes[at + j], bound * size
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return at[first], count


def counted(docs: DataFrame, k: int, frequent: Bitmap | None, text_col: str, lang_col: str, window: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``k`` words that may be frequent; at the first level also (lang, null, all words)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for batch in (b for whole in batches for b in slices(whole)):
            coded = batch.column(1).fill_null("und").dictionary_encode()
            langs, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for w in words_of(batch.column(0), code, k, window):
                first, count = emitted(w, langs, k, shared.value)
                parts = [w.names.take(pa.array(w.codes[first + j])) for j in range(k)]
                phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
                lang = coded.dictionary.take(pa.array(w.lang[first]))
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(count.astype(np.int64))], names=["lang", "phrase", "f"])
                if k == 1:
                    here, n = np.unique(w.lang[: w.own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(here)), pa.nulls(len(here), pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "f"])

    plain = docs.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"))
    return plain.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", bits: tuple[int, int] = BITS, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n), all words of a language.

    Null texts are empty, a null language is ``und``. An empty table gives two empty ones.
    """
    first = materialize(counted(docs, 1, None, text_col, lang_col, window).where(F.col("phrase").isNull() | (F.col("f") >= least)), "level1")
    levels = [first.where("phrase IS NOT NULL")]
    every = 0
    for k in range(2, longest + 1):
        found = levels[-1].count()
        every += found
        if not found:
            break
        frequent = bitmap_of(reduce(DataFrame.unionByName, levels), every, bits)
        levels.append(materialize(counted(docs, k, frequent, text_col, lang_col, window).where(F.col("f") >= least), f"level{k}"))
    tables = [t.select("lang", F.lit(k).alias("k"), "phrase", "f") for k, t in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, tables), first.where("phrase IS NULL").select("lang", F.col("f").alias("n"))


def scored(levels: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, n, l, r, score) of each phrase of two or more words, by its lowest-scoring cut.

    Both halves of a cut are at least as frequent as the phrase, so that they are in ``levels``. Products are
    decimals of 38 digits, and the quotient is that of whole numbers.
    """
    words = F.split("phrase", " ")
    cut = lambda j: F.array(*[F.struct(j.alias("j"), F.lit(side).alias("side"), F.array_join(part, " ").alias("part")) for side, part in (("l", F.slice(words, F.lit(1), j)), ("r", F.slice(words, j + 1, F.col("k") - j)))])
    parts = levels.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), cut))).alias("c"))
    known = levels.select("lang", F.col("phrase").alias("part"), "f")
    halves = parts.select("lang", "k", "phrase", "a", "c.*").join(known, ["lang", "part"])
    cuts = halves.groupBy("lang", "k", "phrase", "a").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("side", F.col("j").cast("string")), "f"))).alias("f"))  # two for each cut
    joined = cuts.join(totals.withColumnRenamed("lang", "__lang"), F.col("lang") == F.col("__lang")).drop("__lang")
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    left, right = whole("f[concat('l', j)]"), whole("f[concat('r', j)]")
    best = F.expr(
        f"array_min(transform(sequence(1, k - 1), j -> struct(({whole(1000)} * {whole('a')} * {whole('n')}) div ({left} * {right}) AS score, j AS j, f[concat('l', j)] AS l, f[concat('r', j)] AS r)))"
    )
    return joined.withColumn("best", best).select("lang", "k", "phrase", "a", "n", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, cover: int = 100) -> DataFrame:
    """The phrases that lie in no longer one with ``cover`` hundredths of their occurrences.

    What lies between a phrase and a longer one is at least as frequent as the longer, so that longer
    phrases by one word decide.
    """
    words = F.split("phrase", " ")
    parts = F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))
    longer = phrases.where("k >= 3").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("by")).groupBy("lang", "phrase").agg(F.max("by").alias("by"))
    return phrases.join(longer, ["lang", "phrase"], "left").where(F.col("by").isNull() | (100 * F.col("by") < cover * F.col("a"))).drop("by")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", cover: int = 100, **limits) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Nulls count as empty texts and as the language ``und``; repeated rows count each; ties of scores go to the
    more frequent phrase, then to the one first in byte order; no text gives no row. Other columns play no part.
    """
    levels, totals = mine(docs, least, longest, text_col, lang_col, **limits)
    kept = materialize(uncovered(scored(levels, totals), cover), "scored")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # heads of parts first: the last ranking of a language sees at most PARTS * top rows
    heads = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
