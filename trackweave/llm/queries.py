"""The registered queries of the corpus operators: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, decontaminate, dialogues, extract, huffman, impact, packing, pii, sharding, simhash, substrings, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.train(pages), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op4_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_files(_table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.train(docs), keep=["doc_id"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(toxicity.remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokens.vocabulary_path()).drop("ids")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.audit(_table(spark, sf_dir, "conversations"))


def op12_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (op1_main_text, op2_simhash, op3_nearest, op4_huffman, op5_sharding, op6_pii, op7_toxicity, op8_wu_manber, op9_packing, op10_suffixes, op11_conversations, op12_impact_topk, op13_collocations)
    return {f.__name__: f for f in own}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT rid, i, g.m, item FROM g JOIN p ON g.m = p.m AND g.s = p.s),
n AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""


OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
raw AS (SELECT conv_id, coalesce('=' || conv_id, '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
way AS (SELECT raw.*, xor(list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda h, b: xor(h >> 8, t[CAST(xor(h, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 20 AS way FROM raw, crc),
dam AS (SELECT c, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS k FROM way WHERE way <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text), k) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM dam),
fau AS (SELECT *, CASE WHEN blank THEN 'b' WHEN row_number() OVER (PARTITION BY c, blank, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS ini FROM num),
cnt AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
 FROM (SELECT *, lag(ini) OVER (PARTITION BY c ORDER BY i) AS prev FROM fau) GROUP BY c),
ops AS (SELECT * FROM (VALUES (0, 'D', '', 0, 3), (1, 'D', '', 1, 3), (2, 'D', '', 2, 3), (3, 'D', '', 3, 3), (0, 'R', '', 2, 2), (1, 'R', '', 2, 2), (2, 'R', '', 3, 2), (3, 'R', '', 2, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0)) v(q, e, ini, q2, cost)),
ins AS (SELECT * FROM (VALUES (0, '', 0, 0, []::VARCHAR[]), (1, '', 1, 0, []), (2, '', 2, 0, []), (3, '', 3, 0, []), (0, 'I', 2, 2, ['user:']), (1, 'I', 2, 2, ['user:']), (2, 'I', 3, 2, ['assistant:']), (3, 'I', 2, 2, ['user:']), (0, 'II', 3, 4, ['user:', 'assistant:']), (1, 'II', 3, 4, ['user:', 'assistant:'])) v(q, e, q2, cost, more)),
dp AS (SELECT c, 0::BIGINT AS i, q2 AS q, printf('%09d', cost) || e AS s, more AS lines FROM cnt, ins WHERE q = 0
 UNION ALL
 SELECT c, i, q2, min(s2), arg_min(lines2, s2) FROM (
  SELECT c, i, n.q2, printf('%09d', CAST(s[1:9] AS INTEGER) + n.cost) || s[10:] || n.e AS s2, list_concat(lines, n.more) AS lines2 FROM (
   SELECT c, i, q2 AS q, min(s1) AS s, arg_min(lines1, s1) AS lines FROM (
    SELECT d.c, f.i, o.q2, printf('%09d', CAST(d.s[1:9] AS INTEGER) + o.cost + CASE WHEN o.e <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END) || d.s[10:] || o.e AS s1,
     CASE o.e WHEN 'D' THEN d.lines WHEN 'K' THEN list_append(d.lines, f.role || ':' || f.text) ELSE list_append(d.lines, CASE o.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text) END AS lines1
    FROM dp d JOIN fau f ON f.c = d.c AND f.i = d.i + 1 JOIN ops o ON o.q = d.q AND (o.e = 'D' OR (f.fault NOT IN ('b', 'd') AND (o.e = 'R' OR o.ini = f.ini)))
   ) GROUP BY c, i, q2
  ) p JOIN ins n ON n.q = p.q
 ) GROUP BY c, i, q2),
fin AS (SELECT c, min(s) AS s, arg_min(lines, s) AS lines FROM dp JOIN cnt USING (c) WHERE dp.i = cnt.n AND q IN (0, 3) GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(CAST(s[1:9] AS BIGINT), 0) AS cost, coalesce(s[10:], '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM raw) o LEFT JOIN cnt USING (c) LEFT JOIN fin USING (c)
"""

OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, len(embedding) AS d, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score FROM v AS q JOIN v AS c ON q.d = c.d AND q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
u AS (SELECT lang, k, phrase, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT u.lang, u.k, u.phrase, a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM u JOIN f AS x ON x.lang = u.lang AND x.phrase = head JOIN f AS y ON y.lang = u.lang AND y.phrase = tail JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT DISTINCT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a AS by FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
t AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.by >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """Windows of words can be searched for in SQL; XXH64, token ids, fitted models, packings and graphs are tested by brute force."""
    return {"op8_wu_manber": OP8_SQL, "op11_conversations": OP11_SQL, "op12_impact_topk": OP12_SQL, "op13_collocations": OP13_SQL}
