"""The corpus operators against brute force, on a small fixture with the odd cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trackweave.llm import ann, decontaminate, extract, huffman, packing, pii, sharding, simhash, substrings, tokens, toxicity
from trackweave.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, fp string"
ODD = [
    (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "", "en", "s", 0), (None, "text without an id", None, None, None),
    (9004, " \n\t ", None, "s", 4), (9005, "one", "en", None, 3), (9006, "one two", "en", "s", 7), (9005, "one", "en", None, 3),
    (9007, "Mail a.b@c.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.1.", "en", "s", 80),
    (9008, "ab" * 700, "en", "s", 1400), (9009, "xy " * 9000, "en", "s", 27000), (9010, "é²Ⅷ x y  z\x1c", "fr", "s", 9),
    (9011, "call (555) 123-4567 now", "en", "s", 23),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += ODD + [(9100 + i, rows[3][1], "en", "s", 1) for i in range(5)] + [(9200, rows[3][1] + " tail", "en", "s", 1)]
    return spark.createDataFrame([(*r, 0.5, "clash", "clash") for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def none(docs):
    return docs.limit(0)


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# 1


def test_minimum_cut_is_minimal():
    random.seed(2)
    for _ in range(200):
        n = random.randint(1, 7)
        s, t = [random.random() * 3 for _ in range(n)], [random.random() * 3 for _ in range(n)]
        e = [(i, j, random.random()) for i in range(n) for j in range(i) if random.random() < 0.5]
        cost = lambda l: sum(t[i] if l[i] else s[i] for i in range(n)) + sum(c for i, j, c in e if l[i] != l[j])  # noqa: B023, E731, E741
        assert abs(cost(extract.minimum_cut(s, t, e)) - min(map(cost, itertools.product((0, 1), repeat=n)))) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">A &amp; B</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>A  title</h1><p>First &lt;b&gt;   text, which is <b>bold</b> and long enough. It goes on.<br><p>Second
paragraph; quite long as well, with words. And more.</p><div class="share">Share this</div></article>
<form><p>Your name</p><input></form><div id="comments"><p>I read this. It was nice to read all of it.</p></div><aside>Side</aside><footer>&copy; x &middot; y</footer></body></html>"""


def test_extract(spark):
    rows = [(1, "u", PAGE, 7), (2, None, None, 7), (None, "u", "", 7), (1, "u", PAGE, 7), (3, "u", "<p>unclosed <b>words" * 3, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = extract.extract(pages, extract.train(pages)).collect()
    assert len(got) == 5 and got[0].n_chars == len(got[0].text)
    want = "A title\nFirst <b> text, which is bold and long enough. It goes on.\nSecond paragraph; quite long as well, with words. And more."
    assert [r.text for r in got if r.page_id == 1] == [want] * 2
    assert [r.text for r in got if r.page_id in (2, None)] == ["", ""]
    assert extract.extract(none(pages), extract.train(none(pages))).count() == 0


def test_extract_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html

    for r in extract.extract(pages, extract.train(pages)).collect():
        a = re.search(r"<article>(.*?)</article>", r.html, re.S)
        a = a.group(1) if a else r.html[r.html.index("<article>") + 9 :]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", c)))).strip() for c in re.split(r"</?(?:p|h1)>", a))
        assert r.text == "\n".join(p for p in parts if p)


# 2


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """{fingerprint: set of linked fingerprints' root} by all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(docs, plain):
    got = simhash.near_duplicates(docs).collect()
    want = [(i, fingerprint(t)) for i, t in plain]
    root = components([f for _, f in want])
    low = defaultdict(list)
    for i, f in want:
        if i is not None:
            low[root[f]].append(i)
    assert multiset((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", min(low[root[f]], default=None)) for i, f in want)
    assert simhash.near_duplicates(none(docs)).count() == 0


def test_fingerprint_links_dense(spark, monkeypatch):
    random.seed(5)
    fps = set()
    for _ in range(6):
        c = random.getrandbits(64)
        fps |= {c} | {c ^ (1 << a) ^ (1 << b) for a, b in (random.sample(range(64), 2) for _ in range(150))} | {c ^ (1 << random.randrange(32)) for _ in range(20)}
        fps |= {(c & 0xFFFFFFFF) | random.getrandbits(32) << 32 for _ in range(90)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    rows = links.collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in rows)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    want = components(fps)
    mine = {f: roots.get(s, s) for f, s in zip(fps, signed)}
    assert len(set(zip((want[f] for f in fps), (mine[f] for f in fps)))) == len(set(want.values())) == len(set(mine.values()))


def test_keep_one(docs, plain):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in kept.collect()} - {None} == {c for c in comp.values() if c is not None}


# 3


def test_nearest(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding), 0.0) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    dim = len(rows[0][1])
    rows += [(10_000 + 20 * i, rows[5][1], 0.0) for i in range(30)] + [(20_000, None, 0.0), (20_020, [0.0] * dim, 0.0), (20_040, [None] + rows[1][1][1:], 0.0), (20_060, [float("nan")] * dim, 0.0), (20_080, [float("inf")] * dim, 0.0), (None, rows[2][1], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = defaultdict(list)
    for r in ann.nearest(df, shard_rows=150).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x, ids = np.array([v for _, v in ok]), np.array([i for i, _ in ok])
    hit = total = 0
    for q, v in ok:
        if q % 20 == 0:
            s = x @ v
            want = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
            assert len(got[q]) == len(want) and all(i != q for i, _ in got[q])
            assert all(abs(s[list(ids).index(i)] - z) < 1e-9 for i, z in got[q])
            hit, total = hit + len(set(want) & {i for i, _ in got[q]}), total + len(want)
    assert set(got) == {q for q, _ in ok if q % 20 == 0} and hit / total >= 0.95
    assert ann.nearest(none(df)).count() == 0


# 4, 9


def ids_of(plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in plain]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_cuts_like_the_library():
    e = tokens.Encoder(tokens.vocabulary_path())
    odd = ["", "a", " ", "  a", "a  b\n\nc", "\n", "a\n", "\nb", " a b ", "a\tb c", "don't  stop ", "é b c", " \n ", "a \nb", "12 ² Ⅷ x", "a\x01 b", "naïve\nTwo lines, 3rd."]
    for t in [*odd, "\n".join(odd)]:
        want = e.tok.encode(t, add_special_tokens=False).ids
        assert e.encode([t, "foo bar", t])[0].tolist() == want + e.tok.encode("foo bar", add_special_tokens=False).ids + want


def test_huffman_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 60000):
        ids = np.minimum((rng.pareto(1.0, n) * 5).astype(int), 50000)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=50257), 16)
        raw, offsets = huffman.encode_bits(ids, huffman.canonical_codes(lengths), lengths)
        assert (huffman.decode_bits(raw, offsets, n, huffman.decode_table(lengths)) == ids).all() and lengths.max(initial=0) <= 16


def test_token_files(docs, plain, spark):
    want, start = [], 0
    rows = sorted(((i, x + [0]) for i, x in ids_of(plain)), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    for i, x in rows:
        want.append((i, start, len(x), crc(x)))
        start += len(x)
    assert multiset(huffman.token_files(docs, tokens.vocabulary_path()).collect()) == Counter(want)
    assert huffman.token_files(none(docs), tokens.vocabulary_path()).count() == 0


def test_packing(docs, plain):
    pieces = packing.pack_documents(docs, tokens.vocabulary_path())
    got = pieces.collect()
    want = Counter()
    for i, x in ids_of(plain):
        x = x + [2]
        r = len(x) % 1024
        cuts = ([0] if r else []) + list(range(r, len(x), 1024)) + [len(x)]
        want.update((i, p, a, b - a, crc(x[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 1024
    assert len(by) <= sum(r.length for r in got) / 1024 * 1.03 + 2
    s = packing.sequences(pieces).collect()
    assert len(s) == len(by) and all(len(r.ids) == 4 * r.length for r in s)
    assert packing.pack_documents(none(docs), tokens.vocabulary_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pack_histogram(seed):
    rng = np.random.default_rng(seed)
    x = [rng.integers(1, 1024, 3000), rng.integers(400, 700, 2000), np.minimum(rng.gamma(2, 150, 3000).astype(int) + 1, 1023), rng.integers(1, 9, 50)][seed]
    got = Counter()
    bins = packing.pack_histogram(dict(Counter(x.tolist())), 1024)
    for lengths, m in bins:
        assert sum(lengths) <= 1024 and m > 0
        for v in lengths:
            got[v] += m
    assert got == Counter(x.tolist())


# 5


def test_sharding(docs, plain):
    got = sharding.shard_documents(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in plain)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(16)) and all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    texts = defaultdict(set)
    for r in got:
        texts[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for (n, _), s in texts.items() if n > 1)
    total = [sum(r.size for r in rows) for rows in by.values()]
    largest = max(Counter({(i, t): size(t) for i, t in plain}).values())
    assert max(total) - min(total) <= max(0.1 * sum(total) / 16, largest)
    assert sharding.shard_documents(none(docs)).count() == 0


def plain_best_fit_decreasing(sizes, capacity):
    room, where = [], []
    for size in sorted(sizes, reverse=True):
        fits = [b for b, left in enumerate(room) if left >= size]
        if fits:
            b = min(fits, key=lambda b: (room[b], b))
        else:
            b = len(room)
            room.append(max(capacity, size))
        room[b] -= size
        where.append((size, b))
    return where


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [3, 12, 60, 200, 400, 90][seed], 300).tolist()
    for capacity in (100, 217, 1000):
        runs = sharding.best_fit_decreasing(dict(Counter(sizes)), capacity)
        got = sorted((s, b) for s, n, b in runs for _ in range(n))
        want = sorted(plain_best_fit_decreasing(sizes, capacity))
        assert got == want


def test_shards_take_the_least_capacity_that_best_fit_fills():
    rng = np.random.default_rng(9)
    for shards in (2, 5, 16):
        sizes = rng.integers(1, 50, 80).tolist()
        runs = sharding.pack_into(dict(Counter(sizes)), shards)
        assert Counter({s: 0 for s in sizes}) + sum((Counter({s: n}) for s, n, _ in runs), Counter()) == Counter(sizes)
        load = Counter()
        for s, n, b in runs:
            load[b] += s * n
        capacity = max(load.values())
        assert max(load) < shards and len({b for _, b in plain_best_fit_decreasing(sizes, max(capacity - 1, max(sizes)))}) >= min(shards, len(load))
    assert sharding.pack_into({}, 16) == []
    assert sharding.best_fit_decreasing({6: 1, 5: 2, 4: 1}, 10) == [(6, 1, 0), (5, 2, 1), (4, 1, 0)]


# 6


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in reversed(re.sub("[ -]", "", m.group()))]
        if 12 <= len(d) <= 19 and sum(c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c) for i, c in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_fuzz():
    random.seed(1)
    for _ in range(20000):
        t = "".join(random.choices("ab@.+1245 -()0é", k=random.randint(0, 40)))
        assert [(k, a, b) for k, a, b, ok in pii.candidates(t) if ok] == base_spans(t)


def test_pii(docs, plain):
    found = pii.find(docs, pii.train(docs), redact=True)
    assert set(found.columns) == set(docs.columns)
    got = pii.digest(pii.find(docs, pii.train(docs), keep=["doc_id"])).collect()
    want = Counter()
    for i, t in plain:
        s = base_spans(t or "")
        n = Counter(k for k, _, _ in s)
        want[(i, *(n[k] for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert next(r.spans for r in got if r.doc_id == 9011) == "phone:5:19"  # added by the method
    clean = {r.doc_id: r.text for r in found.collect()}
    assert clean[9007] == "Mail [email] or [phone], card [card] at [ip]." and clean[9001] is None
    assert pii.find(none(docs), pii.train(none(docs))).count() == 0


# 7


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    trans, lengths, s = rng.normal(size=(2, 2)), np.array([3, 0, 5, 1]), rng.normal(size=9)
    want, at = [], 0
    for n in lengths.tolist():
        w = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=n):
            z = np.exp(sum(s[at + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                w[i, y[i]] += z
        want += [np.log(a[1] / a[0]) for a in w]
        at += n
    assert np.allclose(toxicity.marginals(s, lengths, trans), want)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(toxicity.remainder(F.col("doc_id")) == 0).collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    spans = toxicity.score(spark.createDataFrame([(1, "You stupid idiot, it rains."), (2, None), (3, "")], "doc_id long, text string"), model, spans=True).collect()
    assert [spans[0].text[a:b] for a, b in spans[0].toxic_spans] == ["stupid", "idiot"] and all(0 <= r.score <= 1 for r in spans)


def test_toxicity_odd(docs, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, empty)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


# 8


def norm(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_benchmark_overlap(spark, docs, plain, sf_dir, block_bytes):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(None, "one"), (501, None), (502, ""), (503, "text without"), (503, "id"), (504, "Xy xy")]
    df = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.benchmark_overlap(docs, df, block_bytes=block_bytes).collect()
    items = [(str(i), w) for i, t in bench if i is not None and (w := norm(t))]
    want = Counter()
    for i, t in plain:
        w, hit, ids = norm(t), set(), set()
        at = defaultdict(list)
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                at[tuple(w[k : k + n])].append(k)
        for item, x in items:
            m = min(10, len(x))
            for k in range(len(x) - m + 1):
                for p in at.get(tuple(x[k : k + m]), ()):
                    hit |= set(range(p, p + m))
                    ids.add(item)
        want[(i, len(w), len(hit), ",".join(sorted(ids)))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in got) == want
    assert decontaminate.benchmark_overlap(none(docs), df).count() == 0
    assert decontaminate.without_benchmark(docs, none(df)).count() == docs.count()
    assert sorted(decontaminate.without_benchmark(docs, df).columns) == sorted(docs.columns)


# 10


def removed(texts, n):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                hit[i] += 1
                if i + n < len(hit):
                    hit[i + n] -= 1
        out.append(np.cumsum(hit)[: len(t)] > 0)
    return out


@pytest.mark.parametrize("contexts, hot", [(8192, 10_000), (3, 10_000), (8192, 4)])
def test_repeats(spark, docs, plain, contexts, hot):
    rows = plain + [(9300, plain[7][1][:500] + "é middle " * 40 + plain[8][1][-300:]), (9301, "q" * 201), (9302, "z" * 199), (9303, plain[8][1][-300:])]
    random.seed(3)
    rows += [(9400 + i, "".join(random.choices("abcdef", k=90)) + "The same passage, of about one hundred and fifty bytes, stands in many texts between words that differ, so that most is kept. " + "shared" * 6 + "".join(random.choices("abcdef", k=90))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, contexts=contexts, hot=hot).collect()}
    raw = [(t or "").encode() for _, t in rows]
    want = set()
    for (i, _), t, m in zip(rows, raw, removed(raw, 200)):
        spans = int((m & ~np.concatenate(([False], m[:-1]))).sum()) if len(m) else 0
        want.add((i, len(t), int(m.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    assert got == want
    assert substrings.remove_repeats(none(docs)).count() == 0


# the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = spark.createDataFrame(after.collect(), docs.schema)
    assert before.count() > 0
    assert {r.doc_id for r in cp.run(spark, sf_dir).collect()} == {r.doc_id for r in before.collect()}


def test_packing_ends_after_python_workers_have_run(spark):
    """Over 200 steps of column generation, where the basis is inverted anew, in a process that has run Python workers."""
    spark.range(1000).mapInArrow(lambda batches: batches, "id long").count()
    rng = np.random.default_rng(4)
    histogram = Counter(int(x) for x in np.clip(rng.normal(420, 60, 8000), 1, 1024))
    steps = []
    real = packing.inverted
    packing.inverted = lambda m: steps.append(1) or real(m)
    try:
        bins = packing.pack_histogram(histogram, 1024, 256)
    finally:
        packing.inverted = real
    assert steps
    placed = Counter()
    for lengths, m in bins:
        assert sum(lengths) <= 1024
        for x in lengths:
            placed[x] += m
    assert placed == histogram


def test_long_texts_of_failed_numbers_and_deep_pages():
    spans = pii.candidates("123456789012345, " * 300_000)
    assert len(spans) == 300_000 and all(not strict for *_, strict in spans)
    deep = "<article>" + "<div>Some words of it. " * 50_000
    assert extract.main_text(deep, extract.fit(np.zeros((0, 13)), np.zeros(0))).count("Some words") == 50_000
    assert extract.blocks_of("<article><header><h1>Title</h1></header><p>Text.</p></article>")[0].hint == 1
    assert extract.blocks_of("<body><header><h1>Site</h1></header><p>Text.</p></body>")[0].hint == -2


def test_packing_is_no_worse_than_best_fit_decreasing():
    rng = np.random.default_rng(3)
    cases = [rng.integers(1, 1024, 8000), np.clip(rng.normal(420, 60, 8000).astype(int), 1, 1023), np.clip(rng.lognormal(5.5, 1, 8000).astype(int), 1, 1023), rng.integers(300, 360, 500), np.array([513] * 7 + [511] * 7 + [1])]
    for lengths in cases:
        histogram = Counter(lengths.tolist())
        bins = packing.pack_histogram(dict(histogram), 1024)
        assert sum((Counter({k: v * m for k, v in Counter(b).items()}) for b, m in bins), Counter()) == histogram
        assert all(sum(b) <= 1024 for b, _ in bins)
        plain = packing.best_fit([], dict(histogram), 1024)
        assert sum(m for _, m in bins) <= sum(m for _, m in plain)


def test_packing_takes_most_bins_from_configurations():
    histogram = Counter(np.random.default_rng(4).integers(257, 1024, 20000).tolist())
    grouped = packing.round_up_groups(dict(histogram), packing.GROUPS)
    demand = [sum(n for _, n in members) for _, members in grouped]
    found = sum(int(x + 1e-9) for _, x in packing.configurations([top for top, _ in grouped], demand, 1024))
    assert found > 0.9 * packing.number(packing.pack_histogram(dict(histogram), 1024))


def test_chains_in_blocks_equal_plain_recursion(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.array([0, 1, 5, 64, 65, 63, 700, 0, 128, 3])
    scores, trans = rng.normal(0, 3, lengths.sum()), rng.normal(0, 1, (2, 2))
    monkeypatch.setattr(toxicity, "BLOCK", 10_000)
    whole = toxicity.messages(scores, lengths, trans)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert all(np.allclose(a, b) for a, b in zip(whole, toxicity.messages(scores, lengths, trans)))
    monkeypatch.undo()
    import time

    start = time.process_time()
    toxicity.messages(rng.normal(0, 1, 1_000_000), np.array([1_000_000]), trans)
    assert time.process_time() - start < 5


def test_fingerprint_of_long_texts_by_parts(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["A", "bb", "cé", "d"], n)) + e for n in (0, 1, 2, 3, 4, 50, 400) for e in ("", " \n")]
    want = simhash.fingerprints(texts).tolist(), [simhash.shingle_hashes(t) for t in texts]
    for part in (1, 5, 64):
        monkeypatch.setattr(simhash, "PART", part)
        assert (simhash.fingerprints(texts).tolist(), [simhash.shingle_hashes(t) for t in texts]) == want


def test_nearest_of_vectors_in_double_precision_and_of_two_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4 if i % 3 else 6)], "extra") for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 300, 20):
        v = np.array(rows[q][1])
        score = lambda i: float(v @ np.array(rows[i][1]))
        want = sorted((-score(i), i) for i in range(300) if i != q and len(rows[i][1]) == len(v))[:5]
        hit += len({i for _, i in want} & {i for i, _ in got[q]})
        assert all(abs(s - score(i)) < 1e-12 for i, s in got[q]) and len(got[q]) == 5
    assert hit >= 0.95 * 75


def test_pages_with_open_heads_formulas_and_distance():
    w = extract.fit(np.zeros((0, 13)), np.zeros(0))
    body = "<article><p>" + "A long enough sentence of an article. " * 4 + "</p></article>"
    page = "<html><head><meta charset=x><title>no</title>" + body
    assert extract.main_text(page, w).startswith("A long enough")
    page = "<html><head><title>no</title><body class=x>" + body
    assert extract.main_text(page, w).startswith("A long enough")
    formula = body.replace("article. ", "article <math><mi>x</mi><mo>=</mo><mn>2</mn></math>. ", 1)
    assert "article x=2." in extract.main_text(formula, w)
    steps = [b.steps for b in extract.blocks_of("<div><p>a</p><p>b</p></div><section><div><p>c</p></div></section>d")]
    assert steps[1:] == [2, 5, 4]
