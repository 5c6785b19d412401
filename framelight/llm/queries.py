"""Queries of the training-text operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.llm import ann, bpe, context_mixing, filter_audit, jaccard_join, langid, line_dedup, mixing, prefix_trie, quality, sharding, token_counts, toxicity

#: Where the driver finds the tokenizer files; they are never copied.
TOKENIZERS = os.environ.get("FRAMELIGHT_TOKENIZERS") or os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", end_id=50256)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, f"{TOKENIZERS}/word_bpe_49k.json").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.assess(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_line_dedup, op4_sharding, op5_quality, op6_mixing, op7_token_counts, op8_nearest, op9_toxicity, op10_bpe, op11_context_mixing, op12_prefix_trie, op13_filter_audit)}

ORACLES: dict[str, str] = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node) c USING (doc_id)
""",
    "op3_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
t AS (SELECT doc_id, line_no, line, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS tokens FROM l),
s AS (SELECT tokens, min((doc_id, line_no)) AS first_place, len(tokens) AS n, row_number() OVER () AS sid FROM t WHERE len(tokens) > 0 GROUP BY tokens),
w AS (SELECT sid, n, unnest(tokens) AS token FROM s),
df AS (SELECT token, count(*) AS df FROM w GROUP BY token),
r AS (SELECT sid, n, token, row_number() OVER (PARTITION BY sid ORDER BY df, token) AS pos FROM w JOIN df USING (token)),
p AS (SELECT sid, n, token FROM r WHERE pos <= n - ceil(n * 80 / 100.0) + 1),
c AS (SELECT DISTINCT x.sid AS a, y.sid AS b FROM p x JOIN p y ON x.token = y.token AND x.sid < y.sid AND 80 * x.n <= 100 * y.n AND 80 * y.n <= 100 * x.n),
v AS (SELECT a, b FROM c JOIN s x ON x.sid = a JOIN s y ON y.sid = b
  WHERE 100 * len(list_intersect(x.tokens, y.tokens)) >= 80 * (x.n + y.n - len(list_intersect(x.tokens, y.tokens)))),
later AS (SELECT DISTINCT CASE WHEN x.first_place > y.first_place THEN a ELSE b END AS sid FROM v JOIN s x ON x.sid = a JOIN s y ON y.sid = b),
k AS (SELECT t.doc_id, t.line_no, t.line, len(t.tokens) > 0 AND ((t.doc_id, t.line_no) <> s.first_place OR later.sid IS NOT NULL) AS gone
  FROM t LEFT JOIN s ON t.tokens = s.tokens LEFT JOIN later ON later.sid = s.sid)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM k GROUP BY doc_id
""",
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, '')) || '/' || row_number() OVER (PARTITION BY doc_id, text ORDER BY source NULLS FIRST) AS seed FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([1.0, 2.0, 3.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight,
  (3 * source_size)::DOUBLE AS full_size, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - sum(full_size) OVER o + full_size) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level_here
  FROM w WINDOW o AS (ORDER BY full_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(full_size, coalesce(weight * (SELECT arg_min(level_here, full_size / weight) FROM l WHERE level_here <= full_size / weight), full_size)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target,
  (floor(rate) + CASE WHEN ('0x' || substr(md5(seed), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS n_copies
  FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * n_copies AS taken, n_copies FROM c
""",
    "op12_prefix_trie": r"""
WITH o AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM o),
r AS (SELECT h.conv_id, coalesce(b.t[1:h], []) || h.t[h + 1:] AS t FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(t) AS size, d AS depth, t[1:d] AS path FROM r, LATERAL (SELECT unnest(range(0, len(t) + 1)) AS d)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = depth AS leaf, (count(*) - 1) * coalesce(length(any_value(path)[depth].text), 0) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM m GROUP BY path, depth),
s AS (SELECT path[1:d] AS path, d AS depth, count(*) FILTER (depth = d + 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM n, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS d) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.path = n.path LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1] AND n.depth > 0
""",
    "op13_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)::INT AS fails FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
  list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65)))::INT AS found FROM o, (SELECT unnest(range(1, 6)) AS step)),
p AS (SELECT filter_order, step, bit, coalesce(found, 0) AS before FROM s),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, p GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
""",
}
