"""Queries over caches, claims, runs, sources and sinks, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.config import Config
from framelight.operators import cache, mentions, metrics, retrieval, verify
from framelight.plans import ctes as sql
from framelight.plans.frame_queries import query_vector, query_vectors, rounded, suppressed, tiered
from framelight.plans.registry import query
from framelight.sources import tables

CAPACITY = 16


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Cache arrivals: every frame once, and every seventh again right after."""
    frames = suppressed(spark, sf).withColumns({"query_similarity": F.lit(0.0), "pagerank": F.lit(0.0), "motion_entropy": F.col("entropy"), "hessian": F.col("motion_magnitude") / 100})
    again = frames.filter("frame_idx % 7 = 0").withColumn("arrival", F.col("frame_idx") * 2 + 1)
    return frames.withColumn("arrival", F.col("frame_idx") * 2).unionByName(again)


def cached(spark: SparkSession, sf: str, config: Config = Config()) -> DataFrame:
    return cache.admit(arrivals(spark, sf), config, CAPACITY)


def cache_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Final cache entries with the frames' embeddings."""
    frames = tables.frames(spark, sf).select("video_id", "frame_idx", "event_id")
    return tables.with_embeddings(cached(spark, sf).join(frames, ["video_id", "frame_idx"]), spark, sf).drop("event_id")


def cache_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Final cache entries with the frames' display columns."""
    shown = suppressed(spark, sf).select("video_id", "frame_idx", "timestamp_sec", "is_peak", F.when(F.col("event_type") == "view", "a view").when(F.col("event_type") == "click", "a rabbit").alias("caption"))
    return cached(spark, sf).join(shown, ["video_id", "frame_idx"])


# G: cache


#: The cache of every video after every arrival, as a list of entries in insertion order.
REPLAY = f"""{sql.NMS},
arrivals AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY arrival) AS rn FROM (
  SELECT video_id, frame_idx, frame_idx * 2 AS arrival, action_score, 0.3 * action_score + 0.2 * 0.0 + 0.15 * persistence_value + 0.1 * 0.0 + 0.1 * entropy + 0.1 * (motion_magnitude / 100) AS fixed FROM nmsed
  UNION ALL SELECT video_id, frame_idx, frame_idx * 2 + 1, action_score, 0.3 * action_score + 0.15 * persistence_value + 0.1 * entropy + 0.1 * (motion_magnitude / 100) FROM nmsed WHERE frame_idx % 7 = 0)),
replay AS (
  SELECT DISTINCT video_id, 0::BIGINT AS rn, []::STRUCT(f INT, a DOUBLE, s DOUBLE, t BIGINT)[] AS cache, 0::BIGINT AS counter, NULL::BIGINT AS arrival, NULL::INT AS frame_idx, NULL::INT AS victim, NULL::DOUBLE AS keep_score FROM arrivals
  UNION ALL
  SELECT video_id, rn, CASE WHEN hit THEN list_transform(cache, lambda c: CASE WHEN c.f = f THEN struct_pack(f := c.f, a := a, s := s, t := 0::BIGINT) ELSE c END)
      ELSE list_append(CASE WHEN gone IS NULL THEN cache ELSE list_concat(cache[1:gone - 1], cache[gone + 1:]) END, struct_pack(f := f, a := a, s := s, t := counter)) END,
    counter + CASE WHEN hit THEN 0 ELSE 1 END, arrival, f, CASE WHEN gone IS NOT NULL THEN cache[gone].f END, scores[gone]
  FROM (SELECT *, CASE WHEN NOT hit AND len(cache) >= {CAPACITY} THEN list_position(scores, list_min(scores)) END AS gone
    FROM (SELECT r.video_id, x.rn, r.cache, r.counter, x.arrival, x.frame_idx::INT AS f, x.action_score AS a, x.fixed AS s,
        list_contains(list_transform(r.cache, lambda c: c.f), x.frame_idx::INT) AS hit,
        list_transform(r.cache, lambda c: c.s + 0.05 * greatest(0.0, 1 - (r.counter - c.t)::DOUBLE / greatest(r.counter, 1))) AS scores
      FROM replay r JOIN arrivals x ON x.video_id = r.video_id AND x.rn = r.rn + 1))),
entries AS (SELECT video_id, e.f AS frame_idx, e.a AS action_score, e.s AS fixed, e.t AS admitted_at, position, counter FROM (
  SELECT video_id, counter, unnest(cache) AS e, unnest(range(len(cache))) AS position FROM replay QUALIFY rn = max(rn) OVER (PARTITION BY video_id)))"""


@query(f"WITH RECURSIVE {REPLAY} SELECT video_id, frame_idx, admitted_at, position, round(action_score, 6) + 0.0 AS action_score FROM entries")
def g1_l1_admit(spark, sf):
    return rounded(cached(spark, sf).select("video_id", "frame_idx", "admitted_at", "position", "action_score"), "action_score")


@query(f"WITH RECURSIVE {REPLAY} SELECT video_id, arrival, frame_idx, victim, round(keep_score + 1e-9, 6) + 0.0 AS keep_score FROM replay WHERE victim IS NOT NULL")
def g2_l1_evict(spark, sf):
    """Which frame went for which arrival."""
    gone = cache.evictions(arrivals(spark, sf), Config(), CAPACITY).withColumn("keep_score", F.col("keep_score") + 1e-9)
    return rounded(gone, "keep_score")


@query(f"WITH RECURSIVE {sql.NMS}, k AS (SELECT *, max(frame_idx) OVER (PARTITION BY video_id) + 1 AS total FROM nmsed) SELECT video_id, frame_idx, round(0.3 * action_score + 0.15 * persistence_value + 0.1 * entropy + 0.1 * motion_magnitude / 100 + 0.05 * (1 - (total - frame_idx)::DOUBLE / total) + 1e-9, 6) AS keep_score FROM k")
def g3_keep_score(spark, sf):
    from pyspark.sql import Window

    frames = suppressed(spark, sf).withColumns({"query_similarity": F.lit(0.0), "pagerank": F.lit(0.0), "motion_entropy": F.col("entropy"), "hessian": F.col("motion_magnitude") / 100, "admitted_at": F.col("frame_idx")})
    total = F.max("frame_idx").over(Window.partitionBy("video_id")) + 1
    return frames.withColumn("total", total).select("video_id", "frame_idx", F.round(cache.keep_score(F.col("total")) + 1e-9, 6).alias("keep_score"))


EMBEDDED = sql.EMBEDDED.removeprefix(sql.FRAMES + ",")


@query(f"WITH RECURSIVE {REPLAY}, {EMBEDDED}, q AS (SELECT e.*, least(greatest(list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0.0), 1.0) AS similarity FROM entries e JOIN embedded USING (video_id, frame_idx)), k AS (SELECT *, fixed + 0.2 * similarity + 0.05 * greatest(0.0, 1 - (counter - admitted_at)::DOUBLE / greatest(counter, 1)) AS keep FROM q), o AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY keep DESC, position))::INT AS rank FROM k) SELECT video_id, frame_idx, rank, round(keep + 1e-9, 6) + 0.0 AS keep_score, round(similarity, 6) + 0.0 AS query_similarity FROM o WHERE rank <= 5")
def g4_l1_query(spark, sf):
    found = cache.query_cache(cache_vectors(spark, sf), query_vector(spark, sf), 5).withColumn("keep_score", F.col("keep_score") + 1e-9)
    return rounded(found.select("video_id", "frame_idx", "rank", "keep_score", "query_similarity"), "keep_score", "query_similarity")


@query(f"WITH RECURSIVE {REPLAY}, {EMBEDDED}, v AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS query_embedding FROM embeddings WHERE vec_id % 50 = 0), q AS (SELECT e.*, query_id, least(greatest(list_cosine_similarity(embedding, query_embedding), 0.0), 1.0) AS similarity FROM entries e JOIN embedded USING (video_id, frame_idx), v), k AS (SELECT *, fixed + 0.2 * similarity + 0.05 * greatest(0.0, 1 - (counter - admitted_at)::DOUBLE / greatest(counter, 1)) AS keep FROM q), o AS (SELECT *, (row_number() OVER (PARTITION BY query_id, video_id ORDER BY keep DESC, position))::INT AS rank FROM k) SELECT query_id, video_id, frame_idx, rank, round(keep + 1e-9, 6) + 0.0 AS keep_score FROM o WHERE rank <= 5")
def g4_l1_query_many(spark, sf):
    found = cache.query_cache(cache_vectors(spark, sf), query_vectors(spark, sf), 5).withColumn("keep_score", F.col("keep_score") + 1e-9)
    return rounded(found.select("query_id", "video_id", "frame_idx", "rank", "keep_score"), "keep_score")


@query(f"WITH RECURSIVE {REPLAY} SELECT e.video_id, e.frame_idx, round(n.entropy / 2, 6) + 0.0 AS pagerank FROM entries e JOIN nmsed n USING (video_id, frame_idx)")
def g5_l1_update_pagerank(spark, sf):
    scores = tables.frames(spark, sf).select("video_id", "frame_idx", (F.col("entropy") / 2).alias("pagerank_score"))
    return rounded(cache.update_pagerank(cached(spark, sf), scores).select("video_id", "frame_idx", "pagerank"), "pagerank")


@query(f"WITH {sql.FRAMES}, v AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE frame_idx % 7 = 0) AS hits FROM frames GROUP BY video_id) SELECT video_id, hits, n AS misses, least(n, {CAPACITY})::BIGINT AS size, n >= {CAPACITY} AS is_full FROM v")
def g6_l1_counters(spark, sf):
    return cache.counters(cached(spark, sf), CAPACITY)


#: A frame's block as C's format has it.
BLOCK = "printf('Frame %d' || chr(10) || 'Timestamp: %.1fs' || chr(10, 10) || 'Caption:' || chr(10) || '%s' || chr(10, 10) || 'Action Score:' || chr(10) || '%.2f' || chr(10, 10) || 'Persistence:' || chr(10) || '%.2f', frame_idx, timestamp_sec, caption, action_score, persistence_value) || CASE WHEN is_peak THEN chr(10, 10) || 'Selection Reason:' || chr(10) || 'Top peak after NMS.' ELSE '' END".replace("chr(10, 10)", "chr(10) || chr(10)")


@query(f"""WITH RECURSIVE {REPLAY}, shown AS (SELECT e.video_id, e.frame_idx, e.position, n.timestamp_sec, n.action_score, n.persistence_value, n.is_peak, CASE n.event_type WHEN 'view' THEN 'a view' WHEN 'click' THEN 'a rabbit' ELSE '[CAPTION_FAILED]' END AS caption FROM entries e JOIN nmsed n USING (video_id, frame_idx))
SELECT video_id, string_agg({BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context FROM shown GROUP BY video_id""")
def g7_display_text(spark, sf):
    return cache.context_text(cache_rows(spark, sf))


@query(f"WITH {sql.FRAMES} SELECT DISTINCT video_id, printf('Frame %d at %.2fs: a view.', frame_idx, timestamp_sec) AS fact FROM frames WHERE event_type = 'view'")
def g8_nli_fact(spark, sf):
    frames = tables.frames(spark, sf).withColumn("caption", F.when(F.col("event_type") == "view", "a view").when(F.col("event_type") == "click", "A Rabbit runs").when(F.col("event_type") == "error", "[CAPTION_FAILED]"))
    facts = frames.select("video_id", cache.nli_fact(F.col("frame_idx"), F.col("timestamp_sec"), F.col("caption")).alias("fact"))
    return facts.filter("fact is not null").dropDuplicates()


TEXT = r"""triples AS (SELECT doc_id AS triple_id, CASE WHEN doc_id % 11 = 0 THEN 'search ' || source ELSE source END AS subject, (['is', 'said', 'shows', 'asked', 'contains', 'reported', 'has'])[doc_id % 7 + 1] AS verb, lang AS object,
  CASE doc_id % 4 WHEN 1 THEN ['2019'] WHEN 2 THEN ['2020', 'spring'] ELSE [] END AS temporal_anchors, doc_id % 5 = 0 AS is_negated, CASE WHEN doc_id % 9 = 0 THEN 'stable' END AS condition,
  coalesce(q.quality, 0) * 0.5::DOUBLE + ((doc_id * 37) % 101)::DOUBLE / 202 AS score FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id)),
texts AS (SELECT *, CASE WHEN is_negated THEN 'NOT: ' ELSE '' END || subject || ' ' || verb || ' ' || object || CASE WHEN len(temporal_anchors) > 0 THEN ' [' || array_to_string(temporal_anchors, ', ') || ']' ELSE '' END
  || coalesce(' (if ' || condition || ')', '') AS text FROM triples)"""
WORDS = r"len(regexp_extract_all(text, '\S+'))"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.triples(spark, sf).withColumn("text", cache.triple_text())


def fact_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Facts in twenty sets, each text upserted in id order."""
    return texts(spark, sf).select((F.col("triple_id") % 20).alias("set_id"), "text", "score", F.col("triple_id").alias("seq"))


UPSERTED = f"{TEXT}, facts_in AS (SELECT triple_id % 20 AS set_id, text, arg_max(score, triple_id) AS score, min(triple_id) AS seq FROM texts GROUP BY ALL)"
TRIMMED = f"{UPSERTED}, ranked AS (SELECT *, row_number() OVER w AS rn, sum({WORDS}) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM facts_in WINDOW w AS (PARTITION BY set_id ORDER BY score DESC, seq DESC)), trimmed AS (SELECT set_id, text, score, seq FROM ranked WHERE used <= 100 OR rn <= 2)"
TURNS = f"lines AS (SELECT conv_id AS set_id, turn AS seq, role, trim(text) AS text FROM conversations WHERE trim(text) <> '')"


@query(f"WITH lines AS (SELECT conv_id AS set_id, trim(text) AS text, min(turn) AS seq FROM conversations WHERE role = 'system' AND trim(text) <> '' GROUP BY ALL) SELECT set_id, text, seq, (sum({WORDS}) OVER (PARTITION BY set_id ORDER BY seq))::BIGINT AS tokens, sum({WORDS}) OVER (PARTITION BY set_id ORDER BY seq) > 50 AS over_budget FROM lines")
def g9_add_system(spark, sf):
    rows = tables.turns(spark, sf, "system").select(F.col("run_id").alias("set_id"), F.col("pos").alias("seq"), "text")
    return cache.add_system(rows, strict=False)


@query(f"WITH {UPSERTED} SELECT set_id, text, round(score, 6) AS score, seq FROM facts_in")
def g10_add_fact(spark, sf):
    return rounded(cache.upsert_facts(fact_rows(spark, sf)), "score")


#: The facts of every set after every row, as a list in order of entry.
FACT_REPLAY = f"""{TEXT}, steps AS (SELECT triple_id % 20 AS set_id, triple_id AS seq, text, score, {WORDS} AS tokens, row_number() OVER (PARTITION BY triple_id % 20 ORDER BY triple_id) AS rn FROM texts),
held AS (
  SELECT DISTINCT set_id, 0::BIGINT AS rn, []::STRUCT(text VARCHAR, score DOUBLE, seq BIGINT, tokens BIGINT)[] AS facts FROM steps
  UNION ALL
  SELECT set_id, rn, list_filter(facts, lambda f, i: NOT list_contains(list_transform(list_filter(low, lambda x, k: used - coalesce(list_sum(list_transform(low[1:k - 1], lambda y: y.t)), 0) > 100 AND len(facts) - k + 1 > 2), lambda x: x.i), i))
  FROM (SELECT *, list_sum(list_transform(facts, lambda f: f.tokens)) AS used, list_sort(list_transform(facts, lambda f, i: struct_pack(s := f.score, i := i, t := f.tokens))) AS low
    FROM (SELECT s.set_id, s.rn, CASE WHEN list_contains(list_transform(h.facts, lambda f: f.text), s.text)
      THEN list_transform(h.facts, lambda f: CASE WHEN f.text = s.text THEN struct_pack(text := f.text, score := s.score, seq := f.seq, tokens := f.tokens) ELSE f END)
      ELSE list_append(h.facts, struct_pack(text := s.text, score := s.score, seq := s.seq, tokens := s.tokens::BIGINT)) END AS facts FROM held h JOIN steps s ON s.set_id = h.set_id AND s.rn = h.rn + 1))),
final AS (SELECT set_id, unnest(facts) AS f, unnest(range(len(facts))) AS position FROM (SELECT * FROM held QUALIFY rn = max(rn) OVER (PARTITION BY set_id)))"""


@query(f"WITH RECURSIVE {FACT_REPLAY} SELECT set_id, f.text AS text, round(f.score, 6) AS score, f.seq AS seq, position FROM final")
def g11_trim_facts(spark, sf):
    """Facts as they come in, trimmed after each; many come again with a lower score."""
    return rounded(cache.replay_facts(fact_rows(spark, sf)), "score")


@query(f"WITH {TRIMMED} SELECT set_id, text, round(score, 6) AS score, seq FROM trimmed")
def g11_trim_facts_once(spark, sf):
    return rounded(cache.trim_facts(cache.upsert_facts(fact_rows(spark, sf))), "score")


def conversation_rows(spark, sf, *more):
    return tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("seq"), *more, "text")


@query(rf"WITH {TURNS}, u AS (SELECT *, sum(len(regexp_extract_all(role || ': ' || text, '\S+'))) OVER (PARTITION BY set_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS used FROM lines) SELECT set_id, seq, role, text FROM u WHERE used <= 150")
def g12_add_history(spark, sf):
    return cache.add_history(conversation_rows(spark, sf, "role"))


@query(rf"WITH {TURNS}, named AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'search' ELSE 'tool' END AS tool_name FROM lines), u AS (SELECT *, sum(len(regexp_extract_all(tool_name || ': ' || text, '\S+'))) OVER (PARTITION BY set_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS used FROM named) SELECT set_id, seq, tool_name, text FROM u WHERE used <= 100")
def g12_add_tool(spark, sf):
    return cache.add_tools(conversation_rows(spark, sf, F.when(F.col("turn") % 3 == 0, " search ").otherwise("  ").alias("tool_name")))


SCRATCH = rf"{TURNS}, u AS (SELECT *, sum({WORDS}) OVER (PARTITION BY set_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS used FROM lines)"


@query(f"WITH {SCRATCH} SELECT set_id, seq, text FROM u WHERE used <= 80")
def g12_add_scratch(spark, sf):
    return cache.add_scratch(conversation_rows(spark, sf))


@query(f"WITH {SCRATCH} SELECT set_id, string_agg(text, chr(10) ORDER BY seq) AS flushed FROM u WHERE used <= 80 GROUP BY set_id")
def g13_flush_scratch(spark, sf):
    flushed = cache.flush_scratch(cache.add_scratch(conversation_rows(spark, sf)))
    return flushed.withColumn("flushed", F.array_join("flushed", "\n"))


ROUTED = f"{TEXT}, routed AS (SELECT triple_id, CASE WHEN regexp_matches(lower(verb), '{'|'.join(cache.SPEECH_WORDS)}') THEN 'history' WHEN regexp_matches(lower(subject), '{'|'.join(cache.TOOL_WORDS)}') THEN 'tools' ELSE 'facts' END AS set_name FROM triples)"


@query(f"WITH {ROUTED} SELECT triple_id, set_name FROM routed")
def g14_route_triple(spark, sf):
    return tables.triples(spark, sf).select("triple_id", cache.route_set(F.col("verb"), F.col("subject")).alias("set_name"))


@query(f"WITH {ROUTED} SELECT set_name, count(*) AS entries FROM routed GROUP BY set_name")
def g15_routing_stats(spark, sf):
    return g14_route_triple(spark, sf).groupBy("set_name").agg(F.count("*").alias("entries"))


RERANK_QUERY = "What changed in 2019 for 3 sources?"


@query(f"""WITH {TEXT}, y AS (SELECT triple_id, text, score, regexp_extract_all(text || ' ' || array_to_string(temporal_anchors, ' '), '\\b(?:19|20)\\d{{2}}\\b') AS fy, regexp_extract_all(text, '\\b\\d+(?:[\\.,]\\d+)?%?\\b') AS fn FROM texts)
SELECT triple_id, round((0.4 * score + 0.6 * 0.5) * CASE WHEN len(list_filter(fn, lambda n: n NOT IN ('2019', '3'))) > 0 THEN 0.4 ELSE 1.0 END, 6) AS score FROM y WHERE len(fy) = 0 OR list_contains(fy, '2019')""")
def g16_rerank_facts(spark, sf):
    return rounded(cache.rerank_facts(texts(spark, sf), RERANK_QUERY, F.lit(0.5)).select("triple_id", "score"), "score")


@query(rf"""WITH {TURNS}, s AS (SELECT set_id, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 2 ELSE 3 END AS section, CASE role WHEN 'system' THEN 'System Instructions:' WHEN 'assistant' THEN 'Fact Cache:' ELSE 'Conversation History:' END AS heading, string_agg(text, chr(10) ORDER BY seq) AS body FROM lines GROUP BY ALL)
SELECT set_id, string_agg(heading || chr(10) || body, chr(10) ORDER BY section) AS context FROM s GROUP BY set_id""")
def g17_context_lines(spark, sf):
    rows = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("set_id"), F.col("turn").alias("seq"), F.trim("text").alias("line"), F.when(F.col("role") == "system", "system").when(F.col("role") == "assistant", "facts").otherwise("history").alias("set_name"))
    return cache.context_lines(rows.filter("line <> ''"))


@query(f"WITH {TEXT} SELECT triple_id, text FROM texts")
def g18_triple_text(spark, sf):
    return texts(spark, sf).select("triple_id", "text")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS tokens FROM documents")
def g20_token_count(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", cache.token_count(F.col("text")).alias("tokens"))


@query(f"WITH RECURSIVE {sql.NMS} SELECT video_id, printf('Frame %d at %.2fs depicts salient visual cues (residual energy %.4f, action score %.4f)', frame_idx, timestamp_sec, round(residual_energy + 1e-9, 4), round(action_score + 1e-9, 4)) AS text, round(CASE WHEN action_score = 0 THEN residual_energy ELSE action_score END, 6) AS score FROM nmsed WHERE is_peak")
def g21_populate_cache(spark, sf):
    rows = suppressed(spark, sf).filter("is_peak")
    text = cache.salient_fact(F.col("frame_idx"), F.col("timestamp_sec"), F.col("residual_energy"), F.col("action_score"))
    score = F.coalesce(F.when(F.col("action_score") != 0, F.col("action_score")), F.col("residual_energy"))
    return rounded(rows.select("video_id", text.alias("text"), score.alias("score")), "score")


@query()
def g22_cache_ablation(spark, sf):
    """Mean kept action score and hits of three weightings of one arrival sequence."""
    zero = {f"l1_w_{w}": 0.0 for w in ("action", "query", "persist", "pagerank", "entropy", "hessian", "recency")}
    variants = {"lru": Config(**zero | {"l1_w_recency": 1.0}), "action_only": Config(**zero | {"l1_w_action": 1.0}), "full": Config()}
    parts = [cached(spark, sf, c).agg(F.lit(n).alias("variant"), F.round(F.avg("action_score"), 6).alias("mean_action"), F.sum("hits").alias("hits")) for n, c in variants.items()]
    return parts[0].union(parts[1]).union(parts[2])


def revisits(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals in which every third frame comes again much later."""
    first = arrivals(spark, sf).filter("arrival % 2 = 0")
    return first.unionByName(first.filter("frame_idx % 3 = 0").withColumn("arrival", F.col("arrival") + 61))


@query()
def g22_cache_report(spark, sf):
    """Three weightings on one trace against the best possible cache; each video is asked for the frame of its middle."""
    zero = {f"l1_w_{w}": 0.0 for w in ("action", "query", "persist", "pagerank", "entropy", "hessian", "recency")}
    variants = {"lru": Config(**zero | {"l1_w_recency": 1.0}), "action_only": Config(**zero | {"l1_w_action": 0.6, "l1_w_query": 0.25, "l1_w_persist": 0.15}), "full": Config()}
    trace, vectors = revisits(spark, sf).persist(), tables.frame_embeddings(spark, sf)  # one trace for all variants
    middle = tables.frames(spark, sf).groupBy("video_id").agg(F.floor(F.max("frame_idx") / 2).cast("int").alias("frame_idx"))
    targets = middle.join(vectors.withColumnRenamed("embedding", "query_embedding"), ["video_id", "frame_idx"]).withColumn("query_id", F.col("video_id"))
    found = cache.cache_report(trace, variants, CAPACITY, targets, vectors)
    return rounded(found, "hit_rate", "best_hit_rate", "regret", "target_hit_rate", "precision_at_1", "frames_scanned")


# H: verification


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return verify.explode_claims(tables.turns(spark, sf, "assistant"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.turns(spark, sf, "user")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    turns = tables.turns(spark, sf, "assistant").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return turns.select("run_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("raw"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    found = verify.nli_label(verify.nli_pairs(claims(spark, sf), facts(spark, sf)))
    return found.withColumn("label", verify.negation_guard()).withColumn("relevant", verify.topical_overlap())


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of all runs; a run's score steps with its id, so every mode occurs."""
    own = claims(spark, sf)
    scores = own.select("run_id").distinct().withColumn("action_score", (F.col("run_id") % 10) / 10)
    return verify.verify(own, facts(spark, sf), scores)


def facts_of(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[A-Z][A-Za-z0-9-]+'), lambda w: lower(w)))"


STOPS = "[" + ", ".join(f"'{w}'" for w in verify.STOP_WORDS) + "]"


def lemmas_of(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z]{{3,}}')), lambda w: NOT list_contains({STOPS}, w))"


def negated_in(text: str) -> str:
    return rf"regexp_matches(lower({text}), '\b(no|not|never)\b|n''t\b')"


@query()
def h1_split_claims(spark, sf):
    return claims(spark, sf)


@query()
def h2_parse_claims(spark, sf):
    listed = claims(spark, sf).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    raw = listed.select("run_id", F.lit(0).cast("long").alias("pos"), F.concat(F.lit("CLAIMS: "), F.to_json(F.transform("c", lambda x: x["text"]))).alias("text"))
    return verify.parse_claims(raw)


@query("SELECT DISTINCT conv_id AS run_id, CASE WHEN conv_id % 10 >= 7 THEN 'full_nli' WHEN conv_id % 10 > 3 THEN 'filtered_nli' ELSE 'ner_only' END AS mode FROM conversations")
def h3_verification_mode(spark, sf):
    runs = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id")).distinct()
    return runs.select("run_id", verify.verification_mode((F.col("run_id") % 10) / 10).alias("mode"))


HEDGED = "[" + ", ".join(f"'{w}'" for w in verify.HEDGES) + "]"


@query(rf"""WITH w AS (SELECT conv_id AS run_id, turn AS pos, text, list_distinct(regexp_extract_all(lower(text), '\S+')) AS ws FROM conversations)
SELECT run_id, pos, CASE WHEN trim(text) = '' THEN 0.0 WHEN list_has_any(ws, {HEDGED}) THEN 0.4 WHEN len(ws) < 3 THEN 0.3 WHEN regexp_matches(text, '[A-Z][A-Za-z0-9-]+') THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence FROM w""")
def h4_confidence(spark, sf):
    return tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), verify.confidence(F.col("text")).alias("confidence"))


@query("SELECT a.conv_id AS run_id, a.turn AS pos, f.turn AS fact_pos FROM conversations a JOIN conversations f ON a.conv_id = f.conv_id WHERE a.role = 'assistant' AND f.role = 'user'")
def h5_nli_pairs(spark, sf):
    return verify.nli_pairs(tables.turns(spark, sf, "assistant"), facts(spark, sf)).select("run_id", "pos", "fact_pos")


PAIRS = "pairs AS (SELECT a.conv_id AS run_id, a.turn AS pos, f.turn AS fact_pos, a.text AS claim, f.text AS fact FROM conversations a JOIN conversations f ON a.conv_id = f.conv_id WHERE a.role = 'assistant' AND f.role = 'user')"
LABELLED = f"{PAIRS}, shared AS (SELECT *, len(list_intersect({lemmas_of('claim')}, {lemmas_of('fact')}))::DOUBLE / greatest(len({lemmas_of('claim')}), 1) AS entail_prob FROM pairs), labelled AS (SELECT *, CASE WHEN entail_prob < 0.6 THEN 'neutral' WHEN {negated_in('claim')} = {negated_in('fact')} THEN 'entailment' ELSE 'contradiction' END AS label, list_has_any({lemmas_of('claim')}, {lemmas_of('fact')}) OR list_has_any({facts_of('claim')}, {facts_of('fact')}) AS relevant FROM shared)"


def turn_pairs(spark, sf):
    """Whole assistant turns as claims, which both engines split alike."""
    return verify.nli_label(verify.nli_pairs(tables.turns(spark, sf, "assistant"), facts(spark, sf)))


@query(f"WITH {LABELLED} SELECT run_id, pos, fact_pos, label, round(entail_prob, 6) AS entail_prob FROM labelled")
def h6_nli_label(spark, sf):
    return rounded(turn_pairs(spark, sf).select("run_id", "pos", "fact_pos", "label", "entail_prob"), "entail_prob")


def eager_pairs(spark, sf):
    """A stand-in model that finds an entailment from a fifth of the words on, whatever is negated, so that the guards have work."""
    return turn_pairs(spark, sf).withColumn("label", F.when(F.col("entail_prob") >= 0.2, "entailment").otherwise("neutral"))


EAGER = f"{LABELLED}, eager AS (SELECT * EXCLUDE (label), CASE WHEN entail_prob >= 0.2 THEN 'entailment' ELSE 'neutral' END AS label FROM labelled)"


@query(f"WITH {EAGER} SELECT run_id, pos, fact_pos, CASE WHEN label = 'entailment' AND {negated_in('claim')} AND NOT {negated_in('fact')} AND entail_prob <= 0.5 THEN 'neutral' ELSE label END AS label FROM eager")
def h7_negation_guard(spark, sf):
    return eager_pairs(spark, sf).withColumn("label", verify.negation_guard()).select("run_id", "pos", "fact_pos", "label")


PLACES = rf"list_distinct(list_transform(regexp_extract_all(claim, '{verify.PLACE}', 1), lambda w: lower(w)))"


@query(f"WITH {EAGER} SELECT run_id, pos, fact_pos, CASE WHEN label = 'entailment' AND len({PLACES}) > 0 AND len(list_filter({PLACES}, lambda p: contains(lower(fact), p))) = 0 THEN 'neutral' ELSE label END AS label FROM eager")
def h8_geo_guard(spark, sf):
    return eager_pairs(spark, sf).withColumn("label", verify.geo_guard(verify.places(F.col("claim")))).select("run_id", "pos", "fact_pos", "label")


@query(f"WITH {LABELLED} SELECT run_id, pos, fact_pos, relevant FROM labelled")
def h9_topical_overlap(spark, sf):
    return turn_pairs(spark, sf).select("run_id", "pos", "fact_pos", verify.topical_overlap().alias("relevant"))


#: After both guards.
GUARDED = f"CASE WHEN label = 'entailment' AND ({negated_in('claim')} AND NOT {negated_in('fact')} AND entail_prob <= 0.5 OR len({PLACES}) > 0 AND len(list_filter({PLACES}, lambda p: contains(lower(fact), p))) = 0) THEN 'neutral' ELSE label END"
VOTES = f"guarded AS (SELECT * EXCLUDE (label), {GUARDED} AS label FROM {{0}}), votes AS (SELECT run_id, pos, count(*) FILTER (WHERE label = 'entailment') AS yes, count(*) FILTER (WHERE label = 'contradiction') AS no FROM guarded WHERE relevant GROUP BY ALL), voted AS (SELECT conv_id AS run_id, turn AS pos, text, CASE WHEN no > yes THEN 'rejected' WHEN yes > 0 THEN 'verified' ELSE 'unverifiable' END AS verdict FROM conversations LEFT JOIN votes ON run_id = conv_id AND pos = turn WHERE role = 'assistant')"
VOTED = f"{LABELLED}, {VOTES.replace('{0}', 'labelled')}"
VOTED_EAGERLY = f"{EAGER}, {VOTES.replace('{0}', 'eager')}"


@query(f"WITH {VOTED} SELECT run_id, pos, verdict FROM voted")
def h10_verdict_vote(spark, sf):
    return verify.full_nli(tables.turns(spark, sf, "assistant"), facts(spark, sf)).select("run_id", "pos", "verdict")


def eager_label(pairs):
    """The model of :func:`eager_pairs` as a plug-in."""
    return verify.nli_label(pairs).withColumn("label", F.when(F.col("entail_prob") >= 0.2, "entailment").otherwise("neutral"))


@query(f"WITH {VOTED_EAGERLY} SELECT run_id, pos, verdict FROM voted")
def h10_verdict_vote_plug_in(spark, sf):
    """The vote with another model, on whose labels both guards fire."""
    models = verify.Models(label=eager_label)
    return verify.full_nli(tables.turns(spark, sf, "assistant"), facts(spark, sf), models).select("run_id", "pos", "verdict")


@query(f"WITH {LABELLED} SELECT run_id, pos, fact_pos FROM labelled WHERE relevant")
def h5_relevant_pairs(spark, sf):
    return verify.relevant_pairs(tables.turns(spark, sf, "assistant"), facts(spark, sf)).select("run_id", "pos", "fact_pos")


@query("SELECT conv_id AS run_id, turn AS pos, 'unverifiable' AS verdict FROM conversations WHERE role = 'assistant'")
def h11_verdict_empty(spark, sf):
    return verify.full_nli(tables.turns(spark, sf, "assistant"), facts(spark, sf).filter("false")).select("run_id", "pos", "verdict")


@query(rf"""WITH {VOTED}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '\S+')) AS ws FROM voted)
SELECT run_id, pos, CASE WHEN trim(text) = '' OR list_has_any(ws, {HEDGED}) OR len(ws) < 3 THEN 'verified' ELSE verdict END AS verdict FROM w""")
def h12_filtered_nli(spark, sf):
    return verify.filtered_nli(tables.turns(spark, sf, "assistant"), facts(spark, sf)).select("run_id", "pos", "verdict")


@query(f"WITH f AS (SELECT conv_id, list_distinct(flatten(list({facts_of('text')}))) AS found FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id AS run_id, c.turn AS pos, CASE WHEN list_has_any({facts_of('c.text')}, f.found) THEN 'verified' ELSE 'unverifiable' END AS verdict FROM conversations c LEFT JOIN f USING (conv_id) WHERE role = 'assistant'")
def h13_ner_overlap(spark, sf):
    return verify.ner_overlap(tables.turns(spark, sf, "assistant"), facts(spark, sf)).select("run_id", "pos", "verdict")


@query(f"WITH {VOTED}, n AS (SELECT conv_id AS run_id, conv_id % 7 = 0 AS is_mocked, count(verdict) AS claims, count(*) FILTER (WHERE verdict = 'verified') AS yes, count(*) FILTER (WHERE verdict = 'rejected') AS no, count(*) FILTER (WHERE verdict = 'unverifiable') AS unknown FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN voted ON run_id = conv_id GROUP BY conv_id), g AS (SELECT run_id, is_mocked, CASE WHEN is_mocked THEN claims ELSE yes END AS verified, CASE WHEN is_mocked THEN 0 ELSE no END::BIGINT AS rejected, CASE WHEN is_mocked THEN 0 ELSE unknown END::BIGINT AS unverifiable FROM n) SELECT *, rejected = 0 AND unverifiable = 0 AS is_verified FROM g")
def h14_gate_result(spark, sf):
    """The verification of every seventh run is taken to have failed."""
    runs = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id")).distinct()
    return verify.gate_result(verify.full_nli(tables.turns(spark, sf, "assistant"), facts(spark, sf)), runs, failed=runs.filter("run_id % 7 = 0"))


@query(f"WITH {VOTED} SELECT run_id, coalesce(nullif(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE verdict = 'verified'), ''), string_agg(text, ' ' ORDER BY pos)) AS answer FROM voted GROUP BY run_id")
def h15_final_answer(spark, sf):
    return verify.final_answer(verify.full_nli(tables.turns(spark, sf, "assistant"), facts(spark, sf)), answers(spark, sf))


VALUE = r"(?i)([a-z]+)?\s*(\d+\.?\d*\s*(?:%|million|billion|thousand|tonnes|kg|km|years?|days?)|\b\d+\b)"
NAMES = "list_transform(regexp_extract_all(text, '[A-Z][A-Za-z0-9-]+'), lambda w: lower(w))"


@query(rf"""WITH usable AS (SELECT conv_id * 1000 + turn AS id, text, list_filter({NAMES}, lambda w, i: list_position({NAMES}, w) = i) AS found FROM conversations WHERE text IS NOT NULL AND NOT contains(upper(text), 'INSUFFICIENT DATA')),
valued AS (SELECT id, len(found) AS n, unnest(regexp_extract_all(text, '{VALUE}', 1)) AS w, unnest(regexp_extract_all(text, '{VALUE}', 2)) AS v, unnest(range(len(regexp_extract_all(text, '{VALUE}', 1)))) AS i FROM usable)
SELECT id, unnest(range(len(found)))::INT AS at, unnest(found) AS subject, 'is' AS verb, 'entity' AS object FROM usable
UNION ALL SELECT id, len(found)::INT, found[1], 'related to', found[2] FROM usable WHERE len(found) >= 2
UNION ALL SELECT id, (n + 1 + i)::INT, w, 'has value', v FROM valued WHERE w <> ''""")
def h16_entity_triples(spark, sf):
    return verify.entity_triples(tables.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


#: How user turns open, as terms: one word an organisation, two words a place.
OPENINGS = {"org": "^[A-Za-z0-9-]+", "gpe": "^[A-Za-z0-9-]+ [A-Za-z0-9-]+"}


def openings(spark, sf):
    asked = tables.turns(spark, sf, "user")
    return asked.select(F.explode(F.array(*(F.struct(F.regexp_extract("text", p, 0).alias("term"), F.lit(label).alias("label")) for label, p in OPENINGS.items()))).alias("x")).select("x.*").distinct()


#: Words with offsets, runs of one or two of them that are terms, and of these the leftmost longest in turn.
MENTIONED = f"""asked AS (SELECT text FROM conversations WHERE role = 'user'),
terms AS (SELECT term, min(label) AS label FROM ({" UNION ALL ".join(f"SELECT lower(regexp_extract(text, '{p}')) AS term, '{label}' AS label FROM asked" for label, p in OPENINGS.items())}) WHERE term <> '' GROUP BY term),
pieces AS (SELECT conv_id AS run_id, turn AS pos, unnest(regexp_extract_all(text, '[^A-Za-z0-9-]*[A-Za-z0-9-]+')) AS piece, unnest(range(len(regexp_extract_all(text, '[^A-Za-z0-9-]*[A-Za-z0-9-]+')))) AS i FROM conversations),
words AS (SELECT *, regexp_extract(piece, '[A-Za-z0-9-]+$') AS word, sum(length(piece)) OVER (PARTITION BY run_id, pos ORDER BY i) AS fin FROM pieces),
following AS (SELECT *, lead(piece) OVER w AS next, lead(word) OVER w AS next_word FROM words WINDOW w AS (PARTITION BY run_id, pos ORDER BY i)),
runs AS (SELECT run_id, pos, fin - length(word) AS beg, fin, word AS mention FROM following UNION ALL SELECT run_id, pos, fin - length(word), fin + length(next), word || next FROM following WHERE next = ' ' || next_word),
hits AS MATERIALIZED (SELECT r.*, label FROM runs r JOIN terms ON lower(mention) = term),
picked AS (SELECT * FROM (SELECT DISTINCT ON (run_id, pos) * FROM hits ORDER BY run_id, pos, beg, fin DESC)
  UNION ALL SELECT * FROM (SELECT DISTINCT ON (h.run_id, h.pos) h.* FROM picked p JOIN hits h ON h.run_id = p.run_id AND h.pos = p.pos AND h.beg >= p.fin ORDER BY h.run_id, h.pos, h.beg, h.fin DESC))"""


@query(f"""WITH RECURSIVE {MENTIONED} SELECT run_id, pos, beg::INT AS start, fin::INT AS "end", mention, label FROM picked""")
def h13_typed_mentions(spark, sf):
    texts = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), "text")
    return mentions.find_mentions(texts, openings(spark, sf), ["run_id", "pos"])


@query(f"""WITH RECURSIVE {MENTIONED}, named AS (SELECT run_id, pos, list(DISTINCT lower(mention)) AS places FROM picked WHERE label = 'gpe' GROUP BY run_id, pos), {EAGER}
SELECT e.run_id, e.pos, e.fact_pos, CASE WHEN label = 'entailment' AND len(places) > 0 AND len(list_filter(places, lambda p: contains(lower(fact), p))) = 0 THEN 'neutral' ELSE label END AS label FROM eager e LEFT JOIN named USING (run_id, pos)""")
def h8_typed_guard(spark, sf):
    """The guard of places where labels tell what a place is."""
    claims = tables.turns(spark, sf, "assistant")
    named = mentions.find_mentions(claims, openings(spark, sf), ["run_id", "pos"])
    return mentions.guard_places(eager_pairs(spark, sf), named).select("run_id", "pos", "fact_pos", "label")


@query(f"""WITH RECURSIVE {MENTIONED}, placed AS (SELECT *, row_number() OVER w AS rn, lead(mention) OVER w AS other FROM picked SEMI JOIN (SELECT conv_id AS run_id, turn AS pos FROM conversations WHERE NOT contains(upper(text), 'INSUFFICIENT DATA')) USING (run_id, pos) WINDOW w AS (PARTITION BY run_id, pos ORDER BY beg))
SELECT run_id, pos, beg::INT AS at, mention AS subject, 'is' AS verb, label AS object FROM placed
UNION ALL SELECT run_id, pos, beg::INT, mention, 'related to', other FROM placed WHERE rn = 1 AND other IS NOT NULL""")
def h16_typed_triples(spark, sf):
    """The turns hold no numbers, so the SQL has no values; those are tested against all pairs."""
    texts = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), "text")
    return mentions.typed_triples(texts, openings(spark, sf), ["run_id", "pos"])


@query("SELECT conv_id, turn, 'Question: ' || role || chr(10) || 'Evidence:' || chr(10) || text AS response FROM conversations")
def h17_generate(spark, sf):
    requests = tables.table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("prompt"), F.col("text").alias("context"))
    return verify.generate(requests).select("conv_id", "turn", "response")


@query(f"WITH {sql.FRAMES} SELECT video_id, frame_idx, event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN '[CAPTION_FAILED]' ELSE 'a ' || event_type END AS caption FROM frames")
def h18_caption_frame(spark, sf):
    def captioner(image):
        if image == "error":
            raise ValueError("unreadable image")
        return f"a {image}"

    frames = verify.caption_frames(tables.frames(spark, sf).withColumn("image", F.col("event_type")), captioner)
    return frames.select("video_id", "frame_idx", "caption_result.success", "caption_result.caption")


# I: metrics

BOTH = f"{sql.NMS},\n{sql.TIERED.removeprefix(sql.FRAMES + ',')}, both_ AS (SELECT video_id, frame_idx, tier, n.is_peak FROM tiered JOIN (SELECT video_id, frame_idx, is_peak FROM nmsed) n USING (video_id, frame_idx))"


def tiered_scored(spark, sf):
    return tiered(spark, sf).select("video_id", "frame_idx", "tier").join(suppressed(spark, sf).select("video_id", "frame_idx", "is_peak", "action_score"), ["video_id", "frame_idx"])


@query(f"WITH RECURSIVE {BOTH} SELECT video_id, round(count(*) FILTER (WHERE tier = 'SKIP')::DOUBLE / count(*), 6) AS skipped_ratio, round(coalesce(count(*)::DOUBLE / nullif(count(*) FILTER (WHERE tier <> 'SKIP'), 0), 0.0), 6) AS reduction, count(*) FILTER (WHERE tier <> 'SKIP' AND is_peak) AS peaks FROM both_ GROUP BY video_id")
def i1_run_ratios(spark, sf):
    return rounded(metrics.run_ratios(tiered_scored(spark, sf)), "skipped_ratio", "reduction")


def gated(spark, sf):
    runs = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id")).distinct()
    return verify.gate_result(verify.full_nli(tables.turns(spark, sf, "assistant"), facts(spark, sf)), runs)


@query(f"""WITH {VOTED}, {sql.FRAMES}, caches AS (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE frame_idx % 7 = 0) AS hits FROM frames GROUP BY video_id) SELECT (count(*) FILTER (WHERE verdict = 'verified'))::BIGINT AS verified, (count(*) FILTER (WHERE verdict = 'rejected'))::BIGINT AS rejected, (count(*) FILTER (WHERE verdict = 'unverifiable'))::BIGINT AS unverifiable, (SELECT round(count(*) FILTER (WHERE event_type <> 'error')::DOUBLE / count(*), 6) FROM events) AS caption_success_rate,
(SELECT sum(hits)::BIGINT FROM caches) AS cache_hits, (SELECT sum(n)::BIGINT FROM caches) AS cache_misses, (SELECT sum(least(n, {CAPACITY}))::BIGINT FROM caches) AS cache_size, (SELECT count(*) FROM caches WHERE n >= {CAPACITY}) AS full_caches FROM voted""")
def i2_validation_report(spark, sf):
    return rounded(metrics.validation_report(gated(spark, sf), h18_caption_frame(spark, sf), g6_l1_counters(spark, sf)), "caption_success_rate")


def gated_by_nli(spark, sf):
    turns, evidence = tables.turns(spark, sf, "assistant"), facts(spark, sf)
    both = verify.full_nli(turns, evidence).withColumn("nli", F.lit(True)).unionByName(verify.ner_overlap(turns, evidence).withColumn("nli", F.lit(False)))
    return both.groupBy("nli").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("verified", "rejected", "unverifiable")))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ("verified", "rejected", "unverifiable"))
ABLATED = f"""{sql.TIERED}, {VOTED}, named AS (SELECT conv_id, list_distinct(flatten(list({facts_of('text')}))) AS found FROM conversations WHERE role = 'user' GROUP BY conv_id),
ner AS (SELECT CASE WHEN list_has_any({facts_of('c.text')}, n.found) THEN 'verified' ELSE 'unverifiable' END AS verdict FROM conversations c LEFT JOIN named n USING (conv_id) WHERE role = 'assistant'),
gated AS (SELECT true AS nli, {_COUNTS} FROM voted UNION ALL SELECT false, {_COUNTS} FROM ner),
pool AS (SELECT count(*) AS total, count(*) FILTER (WHERE tier <> 'SKIP') AS passed FROM tiered),
conditions AS (SELECT * FROM (VALUES ('baseline', false, false), ('ablation_1', true, false), ('ablation_2', false, true), ('full', true, true)) t(condition, gating, nli))"""


@query(f"WITH {ABLATED} SELECT condition, CASE WHEN gating THEN passed ELSE total END AS frames_kept, round(CASE WHEN gating THEN (total - passed)::DOUBLE / total ELSE 0.0 END, 6) AS skip_ratio, verified, rejected, unverifiable, (SELECT round(avg(value), 6) FROM events WHERE event_id % 4 = position) AS latency_ms FROM conditions JOIN (VALUES ('baseline', 0), ('ablation_1', 1), ('ablation_2', 2), ('full', 3)) p(condition, position) USING (condition) CROSS JOIN pool JOIN gated USING (nli)")
def i4_ablation_metrics(spark, sf):
    """Every event's value stands for the time of a run of one of the conditions."""
    names = F.array(*(F.lit(c) for c, _, _ in metrics.CONDITIONS))
    timings = tables.table(spark, sf, "events").select(F.get(names, (F.col("event_id") % 4).cast("int")).alias("condition"), F.col("value").alias("ms"))
    return rounded(metrics.ablation_metrics(metrics.ablation_conditions(spark), tiered(spark, sf), gated_by_nli(spark, sf), timings), "skip_ratio", "latency_ms")


@query("WITH m AS (SELECT event_type AS stage, avg(value) AS mean_ms FROM events GROUP BY event_type) SELECT stage, round(mean_ms, 6) AS mean_ms, round(mean_ms * 100 / sum(mean_ms) OVER (), 6) AS share, (row_number() OVER (ORDER BY mean_ms DESC, stage))::INT AS rank FROM m")
def i5_stage_profile(spark, sf):
    timings = tables.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return rounded(metrics.stage_profile(timings), "mean_ms", "share")


@query(f"WITH RECURSIVE {BOTH}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE tier <> 'SKIP') AS candidates, count(*) FILTER (WHERE tier <> 'SKIP' AND is_peak) AS peaks, count(DISTINCT video_id) * 5 AS retrieved FROM both_) SELECT *, round(100 * (total - candidates)::DOUBLE / total, 6) AS candidates_reduction, round(100 * (candidates - peaks)::DOUBLE / candidates, 6) AS peaks_reduction, round(100 * (total - retrieved)::DOUBLE / total, 6) AS retrieved_reduction FROM c")
def i6_search_pool(spark, sf):
    kept = F.col("tier") != "SKIP"
    counts = tiered_scored(spark, sf).agg(F.count("*").alias("total"), F.count_if(kept).alias("candidates"), F.count_if(kept & F.col("is_peak")).alias("peaks"), (F.countDistinct("video_id") * 5).alias("retrieved"))
    return rounded(metrics.search_pool(counts), "candidates_reduction", "peaks_reduction", "retrieved_reduction")


def videos(spark, sf):
    return tables.frames(spark, sf).groupBy("video_id").agg(F.count("*").alias("total")).withColumn("fps", F.lit(25.0))


@query(f"WITH {sql.FRAMES}, v AS (SELECT video_id, count(*) AS total FROM frames GROUP BY video_id) SELECT video_id, rate, greatest(1, round_even(total / 25.0::DOUBLE * rate, 0))::BIGINT AS frames FROM v CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS rate)")
def i7_fps_sweep(spark, sf):
    return metrics.fps_sweep(videos(spark, sf))


@query(f"WITH {sql.TIERED}, v AS (SELECT video_id, count(*) AS total, count(*) FILTER (WHERE tier <> 'SKIP') AS kept FROM tiered GROUP BY video_id), u AS (SELECT *, greatest(1, round_even(total / 25.0::DOUBLE, 0))::BIGINT AS uniform FROM v) SELECT video_id, uniform, kept, round(total::DOUBLE / uniform, 6) AS uniform_reduction, round(total::DOUBLE / kept, 6) AS reduction, round(uniform * 0.0015, 6)::DOUBLE AS uniform_cost, round(kept * 0.0015, 6)::DOUBLE AS cost, round(100 * (uniform - kept)::DOUBLE / uniform, 6) + 0.0 AS savings_pct FROM u")
def i8_baseline_compare(spark, sf):
    kept = tiered(spark, sf).groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(F.col("tier") != "SKIP").alias("kept")).withColumn("fps", F.lit(25.0))
    return rounded(metrics.baseline_compare(kept), "uniform_reduction", "reduction", "uniform_cost", "cost", "savings_pct")


@query("SELECT unnest(['scores', 'retrieved', 'verdicts', 'answers']) AS part, 0::BIGINT AS only_first, 0::BIGINT AS only_second, true AS identical")
def i9_determinism_compare(spark, sf):
    """Two runs, the second over rows dealt out anew before every step."""

    def run(dealt):
        rows = tables.with_embeddings(dealt(suppressed(spark, sf)), spark, sf)
        found = retrieval.hybrid_retrieve(rows, query_vector(spark, sf), 5)
        judged = verify.full_nli(dealt(tables.turns(spark, sf, "assistant")), dealt(facts(spark, sf)))
        return {
            "scores": rows.select("video_id", "frame_idx", "is_peak", F.round("action_score", 9).alias("s")),
            "retrieved": found.select("video_id", "frame_idx", "rank", F.round("score", 9).alias("s")),
            "verdicts": judged.select("run_id", "pos", "verdict"),
            "answers": verify.final_answer(judged, dealt(answers(spark, sf))),
        }

    first, second = run(lambda rows: rows), run(lambda rows: rows.repartition(7))
    parts = [metrics.determinism_compare(first[k], second[k]).select(F.lit(k).alias("part"), "only_first", "only_second", "identical") for k in first]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS succeeded FROM conversations")
def i10_uses_real_aria_flag(spark, sf):
    """Every third answer is the text that reports what was processed, every second of those a failure."""
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Based on the video analysis, I processed 3 frames. "), F.when(F.col("turn") % 2 == 0, "Generation FAILED.").otherwise("Done."))).otherwise(F.col("text"))
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", metrics.generation_succeeded(text).alias("succeeded"))


# A: sources and sinks


@query(f"WITH {sql.FRAMES} SELECT video_id, count(*) AS frames, 25.0::DOUBLE AS fps, round(max(timestamp_sec), 6) AS duration_sec FROM frames GROUP BY video_id")
def a3_src_video_stats(spark, sf):
    from framelight.sources.video import video_stats

    frames = tables.frames(spark, sf)
    meta = frames.select("video_id").distinct().withColumns({"meta_frames": F.lit(None).cast("long"), "fps": F.lit(None).cast("double"), "duration_sec": F.lit(None).cast("double")})
    return rounded(video_stats(meta, frames), "duration_sec")


@query("SELECT page_id, lower(regexp_extract(url, '[^.]*$')) AS suffix, regexp_matches(lower(url), '\\.(mp4|mov|avi|mkv|webm)$') AS accepted FROM pages")
def a7_src_upload(spark, sf):
    from framelight.sources.video import upload_accepted

    pages = tables.table(spark, sf, "pages")
    return pages.select("page_id", F.lower(F.regexp_extract("url", "[^.]*$", 0)).alias("suffix"), upload_accepted(F.col("url"), F.lit("what happens?")).alias("accepted"))


@query("SELECT l_orderkey AS frame_key, count(*) AS mv_count, round(avg(sqrt((l_quantity - 25) ** 2 + (l_linenumber - 4) ** 2)), 4) AS mv_magnitude FROM lineitem GROUP BY l_orderkey")
def a9_sink_thumbnails(spark, sf):
    from framelight.sources.sinks import thumbnail_rows

    vectors = tables.motion_vectors(spark, sf).groupBy("frame_key").agg(F.collect_list(F.struct("motion_x", "motion_y")).alias("mv"))
    return thumbnail_rows(vectors.withColumn("image", F.lit(b""))).select("frame_key", "mv_count", "mv_magnitude")


@query(f"WITH {sql.FRAMES} SELECT rate, sum(greatest(1, round_even(total / 25.0::DOUBLE * rate, 0)))::BIGINT AS frames FROM (SELECT video_id, count(*) AS total FROM frames GROUP BY video_id) CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS rate) GROUP BY rate")
def a14_sink_charts(spark, sf):
    return metrics.fps_sweep(videos(spark, sf)).groupBy("rate").agg(F.sum("frames").alias("frames"))
