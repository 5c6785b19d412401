"""Hand-computed cases of the cache and of verification."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelight.config import Config
from framelight.operators import cache, metrics, verify


def events(spark, rows):
    data = [(1, i, f, s, 0.0, 0.5, 0.0, 0.0, 0.0) for i, (f, s) in enumerate(rows)]
    return spark.createDataFrame(data, "video_id long, arrival long, frame_idx int, action_score double, query_similarity double, persistence_value double, pagerank double, motion_entropy double, hessian double")


def kept(spark, rows, capacity):
    return {r["frame_idx"]: r for r in cache.admit(events(spark, rows), Config(), capacity).collect()}


def test_admission(spark):
    out = kept(spark, [(0, 0.5), (1, 0.5)], 8)
    assert [out[i]["admitted_at"] for i in (0, 1)] == [0, 1] and out[0]["counter"] == 2
    again = kept(spark, [(7, 0.5), (7, 0.6)], 8)
    assert len(again) == 1 and again[7]["counter"] == 1 and again[7]["hits"] == 1 and again[7]["action_score"] == 0.6


def test_eviction(spark):
    assert set(kept(spark, [(0, 0.1), (1, 0.5), (2, 0.9), (3, 0.8)], 3)) == {1, 2, 3}
    assert set(kept(spark, [(0, 0.95), (1, 0.05), (2, 0.7)], 2)) == {0, 2}
    assert set(kept(spark, [(0, 0.5), (0, 0.5), (1, 0.9), (2, 0.1)], 2)) == {1, 2}  # re-admission, then eviction at capacity


def test_eviction_order(spark):
    """Which frame goes for which arrival, against a plain replay; two videos in small batches."""
    import random

    rng = random.Random(3)
    rows = [(v, i, rng.randrange(40), rng.random(), 0.0, rng.random(), 0.0, 0.0, 0.0) for v in (1, 2) for i in range(120)]
    given = spark.createDataFrame(rows, "video_id long, arrival long, frame_idx int, action_score double, query_similarity double, persistence_value double, pagerank double, motion_entropy double, hessian double")
    expected, final = [], {}
    for v in (1, 2):
        held, n = {}, 0
        for _, i, f, action, _, persist, *_ in (r for r in rows if r[0] == v):
            if f in held:
                held[f] = (action, persist, 0)
                continue
            if len(held) == 5:
                keep = {x: 0.3 * a + 0.15 * p + 0.05 * max(0, 1 - (n - t) / max(n, 1)) for x, (a, p, t) in held.items()}
                victim = min(keep, key=keep.get)
                expected.append((v, i, f, victim, round(keep[victim], 9)))
                del held[victim]
            held[f], n = (action, persist, n), n + 1
        final[v] = set(held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        gone = cache.evictions(given, Config(), 5).collect()
        left = cache.admit(given, Config(), 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((*tuple(r)[:4], round(r["keep_score"], 9)) for r in gone) == sorted(expected)
    assert {v: {r["frame_idx"] for r in left if r["video_id"] == v} for v in (1, 2)} == final


def test_query(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], 0), (1, 1, [0.0, 1.0], 1), (1, 2, None, 2)], "video_id long, frame_idx int, embedding array<double>, position long")
    rows = rows.withColumns({c: F.lit(0.5) for c in cache.SIGNALS}).withColumn("admitted_at", F.lit(0)).withColumn("counter", F.lit(3))
    out = cache.query_cache(rows, spark.createDataFrame([([1.0, 0.0],)], "query_embedding array<double>"), 2).orderBy("rank").collect()
    assert [(r["frame_idx"], r["query_similarity"]) for r in out] == [(0, 1.0), (1, 0.0)]


def test_routing_and_triples(spark):
    rows = spark.createDataFrame([("search", "said"), ("a", "unsaid"), ("the api", "is"), ("a", "is")], "subject string, verb string")
    assert [r[0] for r in rows.select(cache.route_set(F.col("verb"), F.col("subject"))).collect()] == ["history", "history", "tools", "facts"]
    one = spark.createDataFrame([("cat", "sat", " ", ["2020"], True, "wet")], "subject string, verb string, object string, temporal_anchors array<string>, is_negated boolean, condition string")
    assert one.select(cache.triple_text()).first()[0] == "NOT: cat sat [2020] (if wet)"


def test_fact_floor(spark):
    long = " ".join(["w"] * 300)
    rows = spark.createDataFrame([(1, long + str(i), float(i), i) for i in range(4)], "set_id long, text string, score double, seq long")
    assert sorted(r["seq"] for r in cache.trim_facts(rows).collect()) == [2, 3]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("in 2019?", {"plain": 0.7, "made in 2019": 0.7, "weighs 7 kg": 0.28}),
        ("and 7?", {"plain": 0.7, "made in 2019": 0.28, "made in 2020": 0.28, "weighs 7 kg": 0.7}),
        ("so?", {"plain": 0.7, "made in 2019": 0.42, "made in 2020": 0.42, "weighs 7 kg": 0.42}),
    ],
)
def test_rerank(spark, query, expected):
    rows = spark.createDataFrame([(t, [], 1.0) for t in ("plain", "made in 2019", "made in 2020", "weighs 7 kg")], "text string, temporal_anchors array<string>, score double")
    assert {r["text"]: round(r["score"], 6) for r in cache.rerank_facts(rows, query, F.lit(0.5)).collect()} == expected


def test_budgets():
    assert cache.resolve_budgets({"facts": 7})["facts"] == 7
    for bad in ({"nope": 1}, {"facts": -1}):
        with pytest.raises(ValueError):
            cache.resolve_budgets(bad)


def test_nli_fact(spark):
    rows = spark.createDataFrame([(1, 0.5, "a dog"), (2, 1.0, "A Meadow"), (3, 1.0, None), (4, 1.0, "[CAPTION_FAILED]")], "i int, t double, c string")
    assert [r[0] for r in rows.select(cache.nli_fact(F.col("i"), F.col("t"), F.col("c"))).collect()] == ["Frame 1 at 0.50s: a dog.", None, None, None]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('CLAIMS: ["a b", "c",]', ["a b", "c"]),
        ("CLAIMS: ['a b', 'c']", ["a b", "c"]),
        ('[{"s": "x", "v": "y", "o": "z"}, 3]', ["x y z"]),
        ("not json", ["not json"]),
        ('<think>no\n</think>["q"]', ["q"]),
    ],
)
def test_parse_claims(raw, expected):
    assert verify.parse_claim_text(raw) == expected


def test_split_claims(spark):
    rows = spark.createDataFrame([("It is 3 p.m. now. Dr. Who left? Yes.",)], "t string")
    assert rows.select(verify.split_claims(F.col("t"))).first()[0] == ["It is 3 p.m. now.", "Dr. Who left?", "Yes."]


def test_confidence(spark):
    rows = spark.createDataFrame([("",), ("maybe so it is",), ("two words",), ("no no no no",), ("Paris is very big",), ("it is very big",), (None,)], "t string")
    assert [r[0] for r in rows.select(verify.confidence(F.col("t"))).collect()] == [0.0, 0.4, 0.3, 0.3, 0.85, 0.65, 0.0]


def texts(spark, *rows):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "run_id long, pos long, text string")


def test_verdicts(spark):
    facts = texts(spark, "Maverick flies F-18")
    check = lambda c: [r["verdict"] for r in verify.full_nli(texts(spark, *c), facts).orderBy("pos").collect()]
    assert check(["Maverick flies a jet", "Maverick does not fly: Maverick flies"]) == ["verified", "rejected"]
    assert check(["Bananas grow slowly"]) == ["unverifiable"]
    assert verify.full_nli(texts(spark, "x y z"), facts.filter("false")).first()["verdict"] == "unverifiable"
    assert verify.full_nli(texts(spark, "a").filter("false"), facts).count() == 0
    assert verify.ner_overlap(texts(spark, "Maverick pilots a jet"), facts).first()["verdict"] == "verified"


def test_vote_tie(spark):
    votes = spark.createDataFrame([(1, 0, "entailment", True), (1, 0, "contradiction", True), (1, 0, "contradiction", False)], "run_id long, pos long, label string, relevant boolean")
    assert verify.verdict_vote(texts(spark, "c"), votes).first()["verdict"] == "verified"


def test_modes(spark):
    rows = spark.createDataFrame([(0.8,), (0.5,), (0.2,)], "s double")
    assert [r[0] for r in rows.select(verify.verification_mode(F.col("s"))).collect()] == ["full_nli", "filtered_nli", "ner_only"]
    assert rows.select(verify.verification_mode(F.col("s"), Config(disable_nli=True))).distinct().count() == 1


def test_captions_and_generation(spark):
    rows = spark.createDataFrame([("ok",), ("bad",)], "image string")

    def captioner(image):
        if image == "bad":
            raise RuntimeError("no")
        return "fine"

    out = [r["caption_result"] for r in verify.caption_frames(rows, captioner).collect()]
    assert [(r["success"], r["caption"]) for r in out] == [(True, "fine"), (False, "[CAPTION_FAILED]")]
    asked = spark.createDataFrame([("p", "c")], "prompt string, context string")
    assert verify.generate(asked, lambda p, c: p + c).first()["response"] == "pc"


def test_generation_flag(spark):
    rows = spark.createDataFrame([("Based on the video analysis, I processed it, failed",), ("fine",)], "t string")
    assert [r[0] for r in rows.select(metrics.generation_succeeded(F.col("t"))).collect()] == [0.0, 1.0]


def test_gate_failure(spark):
    verdicts = spark.createDataFrame([(1, 0, "rejected"), (1, 1, "verified"), (2, 0, "rejected"), (4, 0, "verified")], "run_id long, pos int, verdict string")
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "run_id long")
    out = {r["run_id"]: (r["is_verified"], r["is_mocked"], r["verified"], r["rejected"]) for r in verify.gate_result(verdicts, runs, runs.filter("run_id = 1")).collect()}
    assert out == {1: (True, True, 2, 0), 2: (False, False, 0, 1), 3: (True, False, 0, 0), 4: (True, False, 1, 0)}


def test_sets_with_a_tokenizer(spark):
    rows = spark.createDataFrame([(1, 0, " ", "abcd"), (1, 1, "find", "ef"), (1, 2, None, "  ")], "set_id long, seq long, tool_name string, text string")
    assert [(r["tool_name"], r["text"]) for r in cache.add_tools(rows).orderBy("seq").collect()] == [("tool", "abcd"), ("find", "ef")]
    by_letter = cache.trim_fifo(rows, 8, "tool_name", "tool", cache.tokens_by(list))
    assert [r["text"] for r in by_letter.collect()] == ["ef"]  # "find: ef" has 8 letters
    assert [r["text"] for r in cache.add_scratch(rows, 1).collect()] == ["ef"]
    assert [r["flushed"] for r in cache.flush_scratch(cache.add_scratch(rows)).collect()] == [["abcd", "ef"]]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("CLAIMS: [\"a\", \"b\",]", ["a", "b"]),
        ("<think>[x]</think> ['it runs', 'it stops']", ["it runs", "it stops"]),
        ("{\"tool\": \"look\", \"at\": 3} claims : [{\"s\": \"a dog\", \"v\": \"has\", \"o\": 4}, 7, \"ok\"]", ["a dog has 4", "ok"]),
        ("[not json", ["[not json"]),
        ("CLAIMS: [broken {]", ["CLAIMS: [broken {]"]),
        ("plain words", ["plain words"]),
        ("[]", []),
        ("", [""]),
    ],
)
def test_claim_lists(text, expected):
    assert verify.parse_claim_text(text) == expected


def test_places(spark):
    rows = spark.createDataFrame([("He lives in Paris near Rome", "paris is big", "entailment"), ("Seen at Oslo", "a town", "entailment"), ("Nothing here", "x", "entailment")], "claim string, fact string, label string")
    assert [r[0] for r in rows.select(verify.geo_guard(verify.places(F.col("claim")))).collect()] == ["entailment", "neutral", "entailment"]


def test_ablation_conditions_are_the_four_switch_settings(spark):
    from framelight.operators import metrics

    assert [tuple(r) for r in metrics.ablation_conditions(spark).collect()] == [("baseline", False, False), ("ablation_1", True, False), ("ablation_2", False, True), ("full", True, True)]


def rows_of(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "run_id long, pos long, text string")


def test_places_decide_votes(spark):
    claims = rows_of(spark, ["The tower stands in Paris today", "The tower stands near Lyon today", "The tower stands today"])
    facts = rows_of(spark, ["the tower stands in paris today"])
    found = {r["pos"]: r["verdict"] for r in verify.full_nli(claims, facts).collect()}
    assert found == {0: "verified", 1: "unverifiable", 2: "verified"}
    nowhere = verify.Models(places=lambda text: F.array().cast("array<string>"))
    assert {r["verdict"] for r in verify.full_nli(claims.filter("pos = 1"), facts, nowhere).collect()} == {"verified"}


def test_models_reach_every_mode(spark):
    claims, facts = rows_of(spark, ["alpha beta gamma delta", "omega words are other"]), rows_of(spark, ["alpha thing"])
    seen = verify.Models(entities=lambda t: F.filter(F.split(t, " "), lambda w: w == "alpha"), lemmas=lambda t: F.array().cast("array<string>"), label=lambda pairs: pairs.withColumns({"label": F.lit("contradiction"), "entail_prob": F.lit(0.9)}))
    assert {r["pos"]: r["verdict"] for r in verify.full_nli(claims, facts, seen).collect()} == {0: "rejected", 1: "unverifiable"}
    assert {r["pos"]: r["verdict"] for r in verify.ner_overlap(claims, facts, seen).collect()} == {0: "verified", 1: "unverifiable"}
    assert {r["pos"]: r["verdict"] for r in verify.filtered_nli(claims, facts, models=seen).collect()} == {0: "rejected", 1: "unverifiable"}
    scores = spark.createDataFrame([(1, 0.0)], "run_id long, action_score double")
    assert {r["pos"]: r["verdict"] for r in verify.verify(claims, facts, scores, models=seen).collect()} == {0: "verified", 1: "unverifiable"}


def test_relevant_pairs_are_those_that_share_a_term_once(spark):
    claims, facts = rows_of(spark, ["red fox jumps", "Blue Fox", "nothing", "", None]), rows_of(spark, ["red fox jumps over", "blue sky", None, "red fox jumps over"])
    found = sorted((r["pos"], r["fact_pos"]) for r in verify.relevant_pairs(claims, facts).collect())
    assert found == [(0, 0), (0, 3), (1, 0), (1, 1), (1, 3)]
    every = verify.nli_pairs(claims, facts).filter(verify.topical_overlap()).select("pos", "fact_pos").collect()
    assert found == sorted(map(tuple, every))


def test_lists_that_are_nearly_json(spark):
    read = verify.parse_claim_text
    assert read("['a, ]b', \"it's\",]") == ["a, ]b", "it's"]
    assert read('CLAIMS: ["keep, } this", "two", ]') == ["keep, } this", "two"]
    assert read("['it\\'s', {'s': 'x', 'v': 'is', 'o': 'y',},]") == ["it's", "x is y"]


def test_histories_take_a_token_counter(spark):
    from framelight.operators import cache

    rows = spark.createDataFrame([(1, k, "user", "one two") for k in range(5)], "set_id long, seq long, role string, text string")
    assert cache.add_history(rows, 6).count() == 2 and cache.add_history(rows, 6, lambda line: F.lit(1)).count() == 5


def test_each_query_has_its_own_ranks(spark):
    from framelight.operators import retrieval

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(5000, 3))
    nodes = spark.createDataFrame([(i % 2, i, None if i % 9 == 0 else [float(x) for x in v], float(i % 7) / 7, None if i % 5 else 0.5) for i, v in enumerate(vectors)], "video_id long, frame_idx int, embedding array<double>, action_score double, persistence_value double")
    asked = rng.normal(size=(700, 3))
    queries = spark.createDataFrame([(k, [float(x) for x in q]) for k, q in enumerate(asked)] + [(700, None)], "query_id long, query_embedding array<double>")
    found = {}
    for r in retrieval.hybrid_retrieve(nodes, queries, 3).collect():
        found.setdefault((r["query_id"], r["video_id"]), []).append((r["rank"], r["frame_idx"]))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    unit[::9] = 0
    c = Config()
    rest = c.beta * (np.arange(5000) % 7 / 7) + c.gamma * np.where(np.arange(5000) % 5 == 0, 0.5, 0)
    assert len(found) == 2 * 701
    for k in (0, 13, 699, 700):
        q = asked[k] / np.linalg.norm(asked[k]) if k < 700 else np.zeros(3)
        score = c.alpha * unit @ q + rest
        for video in (0, 1):
            mine = [i for i in np.lexsort((np.arange(5000), -np.round(score, 12))) if i % 2 == video][:3]
            assert [f for _, f in sorted(found[k, video])] == mine
    two = queries.filter("query_id < 2").drop("query_id")
    assert retrieval.hybrid_retrieve(nodes, two, 3).count() == 12


@pytest.mark.parametrize("seed", range(3))
def test_facts_are_trimmed_after_each_as_a_plain_loop_does(spark, seed):
    rng, rows = np.random.default_rng(seed), []
    for k in range(600):
        words = int(rng.integers(0, 5))
        rows.append((int(rng.integers(0, 3)), k // 2, " ".join(["w"] * words) + f" t{int(rng.integers(0, 25))}" if rng.random() > 0.02 else None, float(rng.integers(0, 6)) if rng.random() > 0.02 else None))
    expected = []
    for own in range(3):
        facts = {}
        for _, seq, text, score in sorted((r for r in rows if r[0] == own and r[2] is not None and r[3] is not None), key=lambda r: (r[1], r[2], r[3])):
            facts[text] = (score, facts[text][1] if text in facts else seq)
            while sum(len(t.split()) for t in facts) > 20 and len(facts) > 2:
                del facts[min(facts, key=lambda t: facts[t][0])]
        expected += [(own, t, *f, k) for k, (t, f) in enumerate(facts.items())]
    table = spark.createDataFrame(rows, "set_id long, seq long, text string, score double").repartition(4)
    assert sorted(map(tuple, cache.replay_facts(table, 20).collect())) == sorted(expected)
    assert cache.replay_facts(table.filter("false")).count() == 0
    counted = cache.replay_facts(table, 3, count=lambda text: F.lit(1)).groupBy("set_id").count().collect()
    assert {r["count"] for r in counted} == {3}


def trace(spark, frames, video=1):
    data = [(video, i, f, float(f % 5) / 5, 0.0, 0.0, 0.0, 0.0, 0.0) for i, f in enumerate(frames)]
    return spark.createDataFrame(data, "video_id long, arrival long, frame_idx int, action_score double, query_similarity double, persistence_value double, pagerank double, motion_entropy double, hessian double")


def most_hits(frames, capacity):
    """By trying every eviction."""
    states = {frozenset(): 0}
    for f in frames:
        after = {}
        for held, hits in states.items():
            options = [(held, hits + 1)] if f in held else [((held - {v}) | {f}, hits) for v in held] if len(held) >= capacity else [(held | {f}, hits)]
            for h, n in options:
                after[h] = max(after.get(h, 0), n)
        states = after
    return max(states.values(), default=0)


def test_no_cache_beats_the_one_that_knows_what_comes(spark):
    rng, frames = np.random.default_rng(8), {}
    whole = None
    for video in range(12):
        frames[video] = rng.integers(0, 7, 25).tolist()
        own = trace(spark, frames[video], video)
        whole = own if whole is None else whole.union(own)
    whole = whole.repartition(3).cache()
    found = {r["video_id"]: (r["hits"], r["misses"]) for r in cache.best_possible(whole, 3).collect()}
    assert found == {v: (n := most_hits(f, 3), 25 - n) for v, f in frames.items()}
    usual = {r["video_id"]: r["hits"] for r in cache.counters(cache.admit(whole, Config(), 3), 3).collect()}
    assert all(usual[v] <= found[v][0] for v in usual)


def test_cache_report_by_hand(spark):
    """Capacity 2, newest stay: 0 1 2(evicts 0) 0(evicts 1) 2(hit) 3(evicts one): 1 hit of 6; frame 0's first eviction is regretted."""
    zero = {f"l1_w_{w}": 0.0 for w in ("action", "query", "persist", "pagerank", "entropy", "hessian", "recency")}
    events_ = trace(spark, [0, 1, 2, 0, 2, 3])
    vectors = spark.createDataFrame([(1, f, [float(f == k) for k in range(4)]) for f in range(4)], "video_id long, frame_idx int, embedding array<double>")
    targets = spark.createDataFrame([(1, 1, 3, [0.0, 0.0, 0.0, 1.0]), (2, 1, 1, [0.0, 1.0, 0.0, 0.0])], "query_id long, video_id long, frame_idx int, query_embedding array<double>")
    config = Config(**zero | {"l1_w_recency": 0.5, "l1_w_query": 0.5})
    r = cache.cache_report(events_, {"newest": config}, 2, targets, vectors).first()
    assert r["variant"] == "newest" and r["hit_rate"] == pytest.approx(1 / 6) and r["best_hit_rate"] == pytest.approx(2 / 6)
    assert r["regret"] == pytest.approx(1 / 3)
    assert (r["target_hit_rate"], r["precision_at_1"], r["frames_scanned"]) == (0.5, 0.5, (2 + 2 + 4) / 2)


def test_runs_of_any_size_give_the_same_relevant_pairs(spark, monkeypatch):
    texts_of = lambda n: [f"{'Red' if k % 3 else 'blue'} fox {'jumps' if k % 2 else 'rests'} w{chr(97 + k % 7) * 3}" for k in range(n)]
    claims, facts = rows_of(spark, texts_of(9)), rows_of(spark, texts_of(5))
    both = claims.unionAll(claims.withColumn("run_id", F.col("run_id") + 1).filter("pos < 2")), facts.unionAll(facts.withColumn("run_id", F.col("run_id") + 1).filter("pos < 2"))
    pairs = lambda: sorted(tuple(r) for r in verify.relevant_pairs(*both).select("run_id", "pos", "fact_pos", "claim", "fact").collect())
    found = pairs()
    monkeypatch.setattr(verify, "CROWDED", 8)  # the first run is crowded, the second isn't
    assert pairs() == found and len(found) > 20


def test_pairs_of_small_runs_leave_no_row_for_each_term(spark):
    rows = spark.range(3).select((F.col("id") * 0).alias("run_id"), F.col("id").alias("pos"), F.concat(F.lit("alpha beta gamma delta n"), F.col("id").cast("string")).alias("text"))
    kept = verify.relevant_pairs(rows, rows)
    kept.collect()
    final = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate" not in final  # the way by terms is left out once no run is crowded


@pytest.mark.parametrize("many", [False, True])
def test_best_of_videos_whatever_the_blocks_and_batches(spark, monkeypatch, many):
    from framelight.operators import retrieval

    rng = np.random.default_rng(5)
    # few scores, so that many are equal; one long video
    rows = [(v, i, [float(x) for x in rng.integers(-1, 2, 2)] if rng.random() > 0.1 else None, float(rng.integers(0, 3)), 0.0) for v in range(9) for i in range(60 if v == 4 else v)]
    nodes = spark.createDataFrame(rows, "video_id long, frame_idx int, embedding array<double>, action_score double, persistence_value double").repartition(3)
    asked = [(k, [float(x) for x in rng.normal(size=2)]) for k in range(23)]
    queries = spark.createDataFrame(asked, "query_id long, query_embedding array<double>")
    if many:
        monkeypatch.setattr(retrieval, "BLOCK", 7)
        monkeypatch.setattr(retrieval, "SLICE", 3)
        monkeypatch.setattr(retrieval, "TILE", 5)
        monkeypatch.setattr(retrieval, "SENT", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11 if many else 10000)
    try:
        found = retrieval.hybrid_retrieve(nodes, queries, 4)
        got = sorted((r["query_id"], r["video_id"], r["rank"], r["frame_idx"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    c, expected = Config(), []
    for k, q in asked:
        for v in range(9):
            own = []
            for _, i, e, action, _ in (r for r in rows if r[0] == v):
                size = np.linalg.norm(e) * np.linalg.norm(q) if e is not None else 0
                own.append((-round(c.alpha * (np.dot(e, q) / size if size else 0) + c.beta * action, 12), i))
            expected += [(k, v, rank, i) for rank, (_, i) in enumerate(sorted(own)[:4], 1)]
    assert got == sorted(expected)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()  # which copies all queries for every video


def test_a_query_of_one_video_meets_its_cache_alone(spark):
    rows = spark.createDataFrame([(v, i, [1.0, float(i)], i) for v in (1, 2) for i in range(3)], "video_id long, frame_idx int, embedding array<double>, position long")
    rows = rows.withColumns({c: F.lit(0.5) for c in cache.SIGNALS}).withColumn("admitted_at", F.lit(0)).withColumn("counter", F.lit(3))
    asked = spark.createDataFrame([(7, 1, [0.0, 1.0]), (8, 2, [1.0, 0.0]), (9, 3, [1.0, 0.0])], "query_id long, video_id long, query_embedding array<double>")
    found = cache.query_cache(rows, asked, 1)
    assert sorted((r["query_id"], r["video_id"], r["frame_idx"]) for r in found.collect()) == [(7, 1, 2), (8, 2, 0)]


def test_two_runs_are_compared_in_one_pass(spark):
    from framelight.operators import metrics

    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, t string")
    second = spark.createDataFrame([("a", 1), (None, 2), (None, 2), ("d", 3)], "t string, k int")
    compared = metrics.determinism_compare(first, second.select("k", "t"))
    assert tuple(compared.first()) == (2, 2, False)
    assert tuple(metrics.determinism_compare(first, first.repartition(3)).first()) == (0, 0, True)
    assert tuple(metrics.determinism_compare(first.filter("false"), first.filter("false")).first()) == (0, 0, True)
    reads = compared._jdf.queryExecution().optimizedPlan().toString()
    assert reads.count("LogicalRDD") + reads.count("LocalRelation") == 2  # each run is made once
