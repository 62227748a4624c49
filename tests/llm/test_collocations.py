"""Phrases against a plain count of all of them."""

import re
from collections import Counter, defaultdict

import pytest

from trackweave.llm import collocations

ODD = [
    (None, "en"), ("", "en"), (" \t,. ", None), ("one", "en"), ("to be, or not to be", None), ("to be or not to be " * 40, None), ("a b " * 3000, "de"), ("A B" * 500, "de"),
    ("x\x1cy é²Ⅷ x\x1cy é²Ⅷ " * 10, "fr"), ("é\nà\rü\x0bö\x0cß" * 20, "fr"), ("b a,b a;b a " * 15, ""),
]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()] + ODD + ODD[4:6]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def plain(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    good = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    covered = set()
    for (lang, w), a in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 100 * f[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    by = defaultdict(list)
    for (lang, w), a in good.items():
        if (lang, w) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:j]] * f[lang, w[j:]]), j) for j in range(1, len(w))]
            score, j = min(cuts)
            by[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:j]], f[lang, w[j:]]))
    return [(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, own in by.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]


@pytest.mark.parametrize("limits", [{}, {"window": 50}, {"bits": (64, 64)}])
def test_whole_tables(spark, rows, limits):
    """Also with windows of few bytes, and with a bitmap so crowded that it prunes nothing."""
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, phrase string, f int").repartition(5)
    got = [tuple(r) for r in collocations.collocations(docs, least=12, top=300, **limits).collect()]
    assert sorted(got) == sorted(plain(rows, 12, top=300)) and any(len(r[2].split()) > 3 for r in got)


def test_no_texts(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_products_past_64_bits_are_exact(spark):
    a, n, left, right = 3_000_000_000_007, 9_000_000_000_000_011, 4_000_000_000_033, 5_000_000_000_077
    levels = spark.createDataFrame([("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], "lang string, k int, phrase string, f long")
    got = collocations.scored(levels, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert (got.score, got.l, got.r) == (1000 * a * n // (left * right), left, right)


def test_ties_of_cuts_go_to_the_first(spark):
    levels = spark.createDataFrame([("en", 1, "x", 10), ("en", 1, "z", 10), ("en", 2, "x y", 10), ("en", 2, "y z", 10), ("en", 3, "x y z", 10)], "lang string, k int, phrase string, f long")
    totals = spark.createDataFrame([("en", 100)], "lang string, n long")
    by = {r.phrase: r for r in collocations.scored(levels.unionByName(spark.createDataFrame([("en", 1, "y", 20)], levels.schema)), totals).collect()}
    assert (by["x y z"].l, by["x y z"].r, by["x y z"].score) == (10, 10, 1000 * 10 * 100 // 100)
