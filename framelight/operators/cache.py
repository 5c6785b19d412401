"""The bounded context cache: frames kept by score, and text sets kept by token budgets."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.config import Config
from framelight.functions.arrays import clip01, cosine
from framelight.functions.formats import fixed
from framelight.functions.ordered import in_order
from framelight.operators.retrieval import CAPTION_FAILED, best_of_videos

# Budgets of the five sets, the least number of facts, the words that route a triple, and how a year and a number look.
DEFAULT_BUDGETS = {"system": 50, "facts": 100, "history": 150, "tools": 100, "scratch": 80}
MIN_FACTS = 2
SPEECH_WORDS = ("said", "spoke", "asked", "replied", "told", "reported", "announced", "stated", "claimed")
TOOL_WORDS = ("tool", "result", "output", "search", "query", "api", "response")
YEAR = r"\b(?:19|20)\d{2}\b"
NUMBER = r"\b\d+(?:[\.,]\d+)?%?\b"

SIGNALS = ("action_score", "query_similarity", "persistence_value", "pagerank", "motion_entropy", "hessian")


def weights(config: Config) -> dict[str, float]:
    c = config
    return dict(zip(SIGNALS, (c.l1_w_action, c.l1_w_query, c.l1_w_persist, c.l1_w_pagerank, c.l1_w_entropy, c.l1_w_hessian), strict=True))


def keep_score(total_admitted: Column, config: Config = Config()) -> Column:
    """How much a cached frame is worth keeping."""
    recency = F.greatest(F.lit(0.0), 1 - (total_admitted - F.col("admitted_at")) / F.greatest(total_admitted, F.lit(1)))
    return sum((w * F.col(c) for c, w in weights(config).items()), config.l1_w_recency * recency)


class _Replay:
    """One video's cache of bounded size and its counters."""

    def __init__(self, size: int, config: Config):
        self.size, self.weights, self.recency = size, weights(config), config.l1_w_recency
        self.entries: dict[int, dict] = {}
        self.hits = self.misses = self.counter = 0

    def score(self, entry: dict) -> float:
        age = (self.counter - entry["admitted_at"]) / max(self.counter, 1)
        return sum(w * entry[c] for c, w in self.weights.items()) + self.recency * max(0.0, 1 - age)

    def arrive(self, row: dict) -> tuple[int, float] | None:
        """Take a frame in; returns the frame that is evicted for it and its score."""
        at, gone = row["frame_idx"], None
        if at in self.entries:
            self.hits += 1
            self.entries[at] = row | {"admitted_at": 0}
            return None
        self.misses += 1
        if len(self.entries) >= self.size:
            scores = {i: self.score(e) for i, e in self.entries.items()}
            victim = min(scores, key=scores.get)  # the earliest of equals
            del self.entries[victim]
            gone = victim, scores[victim]
        self.entries[at] = row | {"admitted_at": self.counter}
        self.counter += 1
        return gone

    def final(self, video_id: int) -> pd.DataFrame:
        rows = [{"video_id": video_id, **{c: e[c] for c in ("frame_idx", *SIGNALS, "admitted_at")}, "position": i} for i, e in enumerate(self.entries.values())]
        return pd.DataFrame(rows).assign(hits=self.hits, misses=self.misses, counter=self.counter)


def _replayed(events: DataFrame, size: int, config: Config, evicted: bool, schema: str) -> DataFrame:
    """Arrivals stream through one cache at a time: partitions are sorted by video and arrival, and may spill."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, cache = None, None
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                if cache is None or row["video_id"] != video:
                    if cache is not None and not evicted:
                        yield cache.final(video)
                    video, cache = row["video_id"], _Replay(size, config)
                gone = cache.arrive(row)
                if gone and evicted:
                    out.append((video, row["arrival"], row["frame_idx"], *gone))
            if out:
                yield pd.DataFrame(out, columns=["video_id", "arrival", "frame_idx", "victim", "keep_score"])
        if cache is not None and not evicted:
            yield cache.final(video)

    given = events.select("video_id", "arrival", "frame_idx", *SIGNALS)
    return in_order(given, ["video_id"], "arrival").mapInPandas(run, schema)


def admit(events: DataFrame, config: Config = Config(), capacity: int | None = None) -> DataFrame:
    """Replay arrivals (video_id, arrival, frame_idx and the signals) into one cache for each video.

    Returns the final entries in insertion order with the video's counters. A
    frame that is present again replaces its entry with admitted_at 0; a full
    cache first evicts the lowest keep score, the earliest of equals. The state
    is one cache of bounded size.
    """
    schema = "video_id long, frame_idx int, " + ", ".join(f"{c} double" for c in SIGNALS) + ", admitted_at long, position long, hits long, misses long, counter long"
    return _replayed(events, capacity or config.l1_capacity, config, False, schema)


def evictions(events: DataFrame, config: Config = Config(), capacity: int | None = None) -> DataFrame:
    """(video_id, arrival, frame_idx, victim, keep_score): which frame went for which arrival."""
    return _replayed(events, capacity or config.l1_capacity, config, True, "video_id long, arrival long, frame_idx int, victim int, keep_score double")


def best_possible(events: DataFrame, capacity: int) -> DataFrame:
    """(video_id, hits, misses) of the cache that knows what comes: a full one evicts the frame whose next arrival is furthest.

    No cache of this capacity that takes every arrival in has more hits. The next
    arrival of each frame is known before the replay, which holds one cache.
    """
    again = F.lead("arrival").over(Window.partitionBy("video_id", "frame_idx").orderBy("arrival"))
    given = events.select("video_id", "arrival", "frame_idx", again.alias("next"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, held, hits, misses, any_row = None, {}, 0, 0, False
        row = lambda: pd.DataFrame({"video_id": [video], "hits": [hits], "misses": [misses]})
        for rows in batches:
            for own, frame, following in zip(rows["video_id"], rows["frame_idx"], rows["next"], strict=True):
                if any_row and own != video:
                    yield row()
                if not any_row or own != video:
                    video, held, hits, misses, any_row = own, {}, 0, 0, True
                if frame in held:
                    hits += 1
                else:
                    misses += 1
                    if len(held) >= capacity:
                        del held[max(held, key=held.get)]
                held[frame] = float("inf") if pd.isna(following) else following
        if any_row:
            yield row()

    return in_order(given, ["video_id"], "arrival").mapInPandas(run, "video_id long, hits long, misses long")


def cache_report(events: DataFrame, variants: dict[str, Config], capacity: int, targets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A row a variant of the weights over the same arrivals and queries.

    hit_rate: arrivals that met their frame; best_hit_rate: those of
    :func:`best_possible`; regret: evictions of frames that arrive again, as a
    share of all; target_hit_rate: queries of ``targets`` (query_id, video_id,
    frame_idx, query_embedding) whose frame is held in the end; precision_at_1:
    those whose frame ranks first; frames_scanned: frames looked at for a query,
    those held and, where the target isn't, all of its video.
    """
    best = best_possible(events, capacity).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).select((F.col("hits") / (F.col("hits") + F.col("misses"))).alias("best_hit_rate"))
    last = events.groupBy("video_id", F.col("frame_idx").alias("victim")).agg(F.max("arrival").alias("last"))
    sizes = events.groupBy("video_id").agg(F.countDistinct("frame_idx").alias("frames"))
    asked = targets.join(sizes, "video_id")
    reports = []
    for name, config in variants.items():
        entries = admit(events, config, capacity)
        counts = entries.groupBy("video_id").agg(F.max("hits").alias("hits"), F.max("misses").alias("misses"), F.count("*").alias("held"))
        rate = counts.agg((F.sum("hits") / F.sum(F.col("hits") + F.col("misses"))).alias("hit_rate"))
        regret = evictions(events, config, capacity).join(last, ["video_id", "victim"]).agg(F.coalesce(F.avg((F.col("last") > F.col("arrival")).cast("double")), F.lit(0.0)).alias("regret"))
        # each query asks one video: its own entries are ranked for it
        named = targets.select("query_id", "video_id", "query_embedding")
        ranked = query_cache(entries.join(embeddings, ["video_id", "frame_idx"], "left"), named, 1, config).select("query_id", "video_id", F.col("frame_idx").alias("first"))
        present = entries.select("video_id", "frame_idx", F.lit(True).alias("present"))
        met = asked.join(counts.select("video_id", "held"), "video_id").join(present, ["video_id", "frame_idx"], "left").join(ranked, ["query_id", "video_id"], "left")
        found, right = F.coalesce("present", F.lit(False)), F.coalesce(F.col("first") == F.col("frame_idx"), F.lit(False))
        scanned = F.col("held") + F.when(found, 0).otherwise(F.col("frames"))
        quality = met.agg(F.avg(found.cast("double")).alias("target_hit_rate"), F.avg(right.cast("double")).alias("precision_at_1"), F.avg(scanned).alias("frames_scanned"))
        # one row each
        reports.append(rate.crossJoin(best).crossJoin(regret).crossJoin(quality).withColumn("variant", F.lit(name)))
    return functools.reduce(DataFrame.unionByName, reports)


def query_cache(entries: DataFrame, queries: DataFrame, k: int, config: Config = Config()) -> DataFrame:
    """The ``k`` best entries of each cache for each query, after their similarity to it is set; embeddings aren't returned.

    ``queries`` has ``query_embedding`` and columns that tell queries apart, which
    come back; without such columns equal vectors are one query. Queries with a
    ``video_id`` ask the cache of that video alone.
    """
    if "video_id" in queries.columns:
        met = entries.drop("query_similarity").join(queries.distinct(), "video_id")
        scored = met.withColumn("query_similarity", clip01(cosine("embedding", "query_embedding"))).withColumn("keep_score", keep_score(F.col("counter"), config))
        keys = [c for c in queries.columns if c != "query_embedding"]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("keep_score"), "position"))
        return scored.drop("embedding", "query_embedding").withColumn("rank", rank).filter(F.col("rank") <= k)
    signals = weights(config)

    def scores(tile: pa.Table, cosine: np.ndarray) -> list[np.ndarray]:
        similarity, number = np.clip(cosine, 0, 1), lambda c: tile.column(c).to_numpy()
        recency = np.maximum(0.0, 1 - (number("counter") - number("admitted_at")) / np.maximum(number("counter"), 1))
        # as keep_score adds them
        kept = sum((w * (similarity if c == "query_similarity" else number(c)) for c, w in signals.items()), config.l1_w_recency * recency)
        return [similarity, kept]

    given = entries.drop("query_similarity")
    return best_of_videos(given, queries, k, [c for c in given.columns if c != "embedding"], ["query_similarity", "keep_score"], scores, "position")


def salient_fact(frame_idx: Column, timestamp: Column, residual: Column, score: Column) -> Column:
    """A frame's sentence for the fact set, scores to four decimals."""
    # values halfway between two decimals go up whatever their last bits
    r4 = lambda c: fixed(F.round(c + 1e-9, 4), 4)
    return F.concat(F.lit("Frame "), frame_idx.cast("string"), F.lit(" at "), fixed(timestamp, 2), F.lit("s depicts salient visual cues (residual energy "), r4(residual), F.lit(", action score "), r4(score), F.lit(")"))


def update_pagerank(entries: DataFrame, scores: DataFrame) -> DataFrame:
    """``entries`` with the scores of those present; others keep theirs, unknown frames are ignored."""
    new = scores.select("video_id", "frame_idx", F.col("pagerank_score").alias("_new"))
    return entries.join(new, ["video_id", "frame_idx"], "left").withColumn("pagerank", F.coalesce("_new", "pagerank")).drop("_new")


def counters(entries: DataFrame, capacity: int) -> DataFrame:
    found = entries.groupBy("video_id").agg(F.max("hits").alias("hits"), F.max("misses").alias("misses"), F.count("*").alias("size"))
    return found.withColumn("is_full", F.col("size") >= capacity)


def display_text() -> Column:
    # Fixed value: the layout of a frame's block.
    caption = F.coalesce(F.when(F.col("caption") != "", F.col("caption")), F.lit(CAPTION_FAILED))
    lit = F.lit
    text = F.concat(lit("Frame "), F.col("frame_idx").cast("string"), lit("\nTimestamp: "), fixed(F.col("timestamp_sec"), 1), lit("s\n\nCaption:\n"), caption, lit("\n\nAction Score:\n"), fixed(F.col("action_score"), 2), lit("\n\nPersistence:\n"), fixed(F.col("persistence_value"), 2))
    return F.concat(text, F.when(F.col("is_peak"), "\n\nSelection Reason:\nTop peak after NMS.").otherwise(""))


def context_text(frames: DataFrame, order: str = "position") -> DataFrame:
    """One text for each video: its frames' blocks in cache order."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order), display_text().alias("block"))))
    return frames.groupBy("video_id").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def nli_fact(frame_idx: Column, timestamp: Column, caption: Column) -> Column:
    """The caption as a sentence; null where it's missing, failed, or left over from a demo clip."""
    bad = caption.isNull() | (caption == "") | (caption == CAPTION_FAILED) | F.lower(caption).rlike("rabbit|meadow")
    return F.when(~bad, F.concat(F.lit("Frame "), frame_idx.cast("string"), F.lit(" at "), fixed(timestamp, 2), F.lit("s: "), caption, F.lit(".")))


def token_count(text: Column) -> Column:
    """Words between white space, the default where no tokenizer is plugged in."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")).cast("long")


def tokens_by(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """A token count by a tokenizer's ``encode``, to be given wherever :func:`token_count` is the default."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return count


def resolve_budgets(budgets: dict[str, int] | None = None) -> dict[str, int]:
    given = budgets or {}
    if unknown := sorted(set(given) - set(DEFAULT_BUDGETS)):
        raise ValueError(f"unknown budget sets: {', '.join(unknown)}")
    if low := sorted(k for k, v in given.items() if v < 0):
        raise ValueError(f"negative budgets: {', '.join(low)}")
    return DEFAULT_BUDGETS | given


def add_system(rows: DataFrame, budget: int = DEFAULT_BUDGETS["system"], strict: bool = True, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Trimmed distinct system texts in order, with their running tokens; over budget is an error if strict."""
    trimmed = rows.withColumn("text", F.trim("text")).filter("text <> ''")
    first = trimmed.groupBy("set_id", "text").agg(F.min("seq").alias("seq"))
    total = F.sum((count or token_count)(F.col("text"))).over(Window.partitionBy("set_id").orderBy("seq"))
    out = first.withColumn("tokens", total).withColumn("over_budget", F.col("tokens") > budget)
    if strict and not out.filter("over_budget").isEmpty():
        raise ValueError("system texts exceed their budget")
    return out


def upsert_facts(rows: DataFrame) -> DataFrame:
    """(set_id, text, score, seq): the latest score of each fact, at the place where it first came."""
    return rows.groupBy("set_id", "text").agg(F.max_by("score", "seq").alias("score"), F.min("seq").alias("seq"))


def trim_facts(facts: DataFrame, budget: int = DEFAULT_BUDGETS["facts"], count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Facts left after the lowest scores are dropped until the rest fits, two at least.

    It trims once, after all facts of a set are in; a set that is trimmed after
    every fact can keep others where a later score is lower than an earlier one.
    """
    w = Window.partitionBy("set_id").orderBy(F.desc("score"), F.desc("seq"))
    ranked = facts.withColumn("_rank", F.row_number().over(w)).withColumn("_tokens", F.sum((count or token_count)(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter((F.col("_tokens") <= budget) | (F.col("_rank") <= MIN_FACTS)).drop("_rank", "_tokens")


class _Facts:
    """One set's facts in order of entry, and a heap of their scores.

    An update leaves the fact's old heap entry behind; such entries are passed
    over when they come up, and the heap is built anew once they outnumber the facts.
    """

    def __init__(self, budget: int, least: int):
        self.budget, self.least, self.used, self.entered = budget, least, 0, 0
        self.facts: dict[str, tuple[float, int, int, int]] = {}  # text to score, turn of entry, seq of entry, tokens
        self.heap: list[tuple[float, int, str]] = []

    def add(self, text: str, score: float, seq: int, tokens: int) -> None:
        known = self.facts.get(text)
        if known is None:
            self.used += tokens
            self.entered += 1
            known = (score, self.entered, seq, tokens)
        self.facts[text] = (score, *known[1:])
        heapq.heappush(self.heap, (score, known[1], text))
        while self.used > self.budget and len(self.facts) > self.least:
            score, turn, text = heapq.heappop(self.heap)
            if (found := self.facts.get(text)) and found[:2] == (score, turn):
                self.used -= found[3]
                del self.facts[text]
        if len(self.heap) > 2 * len(self.facts) + 16:
            self.heap = [(f[0], f[1], t) for t, f in self.facts.items()]
            heapq.heapify(self.heap)


def replay_facts(rows: DataFrame, budget: int = DEFAULT_BUDGETS["facts"], least: int = MIN_FACTS, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """(set_id, text, score, seq, position): the facts a set holds after all of ``rows`` (set_id, seq, text, score) came in turn.

    A text that is there takes the new score and keeps its place; after each row
    the lowest scores go, the earliest of equals first, until the set fits its
    budget or has ``least`` facts. ``seq`` tells when a fact came in. Rows of one
    seq go by text and score; a null text or score is left out. One pass over
    sorted rows, with one set's facts in memory.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("set_id", "seq")}
    clean = rows.filter("text is not null and score is not null").select("set_id", "seq", "text", F.col("score").cast("double").alias("score"))
    given = clean.withColumn("tokens", (count or token_count)(F.col("text")).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, facts, types = None, None, None

        def held() -> pa.RecordBatch:
            found = [(own, t, f[0], f[2], k) for k, (t, f) in enumerate(facts.facts.items())]
            columns = zip(*found, strict=True) if found else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (types[0], pa.string(), pa.float64(), types[1], pa.int64()), strict=True)], names=["set_id", "text", "score", "seq", "position"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in ("set_id", "seq")]
            for set_id, seq, text, score, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if facts is None or set_id != own:
                    if facts is not None:
                        yield held()
                    own, facts = set_id, _Facts(budget, least)
                facts.add(text, score, seq, tokens)
        if facts is not None:
            yield held()

    ordered = in_order(given, ["set_id"], "seq", "text", "score")
    return ordered.mapInArrow(run, f"set_id {kinds['set_id']}, text string, score double, seq {kinds['seq']}, position long")


def trim_fifo(rows: DataFrame, budget: int, label: str | None, default: str = "", count: Callable[[Column], Column] | None = None) -> DataFrame:
    """The newest entries (set_id, seq, label, text) whose lines together fit the budget; without a label the text is the line."""
    clean = rows.withColumn("text", F.trim("text")).filter("text <> ''")
    if label:
        clean = clean.withColumn(label, F.coalesce(F.when(F.trim(label) != "", F.trim(label)), F.lit(default)))
    line = F.concat_ws(": ", label, "text") if label else F.col("text")
    newest = Window.partitionBy("set_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    return clean.withColumn("_tokens", F.sum((count or token_count)(line)).over(newest)).filter(F.col("_tokens") <= budget).drop("_tokens")


def add_history(rows: DataFrame, budget: int = DEFAULT_BUDGETS["history"], count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Turns (set_id, seq, role, text) that the history keeps; ``count`` counts a line's tokens (default: words)."""
    return trim_fifo(rows, budget, "role", "user", count)


def add_tools(rows: DataFrame, budget: int = DEFAULT_BUDGETS["tools"], count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Results (set_id, seq, tool_name, text) that the tool set keeps."""
    return trim_fifo(rows, budget, "tool_name", "tool", count)


def add_scratch(rows: DataFrame, budget: int = DEFAULT_BUDGETS["scratch"], count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Unverified texts (set_id, seq, text) that the scratch set keeps."""
    return trim_fifo(rows, budget, None, count=count)


def flush_scratch(kept: DataFrame) -> DataFrame:
    """All scratch texts of each set in order, as one list, for verification; the set is empty afterwards."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return kept.groupBy("set_id").agg(F.transform(ordered, lambda x: x["text"]).alias("flushed"))


def route_set(verb: Column, subject: Column) -> Column:
    """Speech verbs go to history, tool subjects to tools, the rest to facts; words match anywhere."""
    return F.when(F.lower(verb).rlike("|".join(SPEECH_WORDS)), "history").when(F.lower(subject).rlike("|".join(TOOL_WORDS)), "tools").otherwise("facts")


def triple_text() -> Column:
    """A triple as text: its parts, a mark of negation, its anchors, its condition."""
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    base = F.concat(F.when(F.col("is_negated"), "NOT: ").otherwise(""), F.concat_ws(" ", filled("subject"), filled("verb"), filled("object")))
    anchors = F.when(F.size("temporal_anchors") > 0, F.concat(F.lit(" ["), F.array_join("temporal_anchors", ", "), F.lit("]"))).otherwise("")
    return F.concat(base, anchors, F.coalesce(F.concat(F.lit(" (if "), filled("condition"), F.lit(")")), F.lit("")))


def rerank_facts(facts: DataFrame, query: str, similarity: Column, alpha: float = 0.4) -> DataFrame:
    """Facts (text, temporal_anchors, score) without those of other years than the query's, scores blended and penalised."""
    asked = lambda p: F.array_distinct(F.regexp_extract_all(F.lit(query), F.lit(p), 0))
    everything = F.concat_ws(" ", F.col("text"), F.array_join("temporal_anchors", " "))
    rows = facts.withColumns({"_fy": F.array_distinct(F.regexp_extract_all(everything, F.lit(YEAR), 0)), "_fn": F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER), 0)), "_qy": asked(YEAR), "_qn": asked(NUMBER)})
    other_year = (F.size("_qy") > 0) & (F.size("_fy") > 0) & ~F.arrays_overlap("_fy", "_qy")
    general = (F.size("_qy") == 0) & (F.size("_qn") == 0)
    penalty = F.when(general & ((F.size("_fy") > 0) | (F.size("_fn") > 0)), 0.6).when(~general & (F.size(F.array_except("_fn", "_qn")) > 0), 0.4).otherwise(1.0)
    return rows.filter(~other_year).withColumn("score", (alpha * F.col("score") + (1 - alpha) * similarity) * penalty).drop("_fy", "_fn", "_qy", "_qn")


# Order and headings of the sets in a context.
SECTIONS = (("system", "System Instructions:"), ("tools", "Active Tool Results:"), ("facts", "Fact Cache:"), ("history", "Conversation History:"), ("scratch", "Unverified Scratch (Dirty):"))


def context_lines(rows: DataFrame) -> DataFrame:
    """(set_id, set_name, seq, line) as one text for each set_id, sections in fixed order with headings."""
    number = F.coalesce(*[F.when(F.col("set_name") == n, i) for i, (n, _) in enumerate(SECTIONS)])
    heading = F.coalesce(*[F.when(F.col("set_name") == n, t) for n, t in SECTIONS])
    sections = rows.groupBy("set_id", number.alias("section"), heading.alias("heading")).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    text = F.concat_ws("\n", "heading", F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    whole = sections.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("section", text.alias("text")))).alias("parts"))
    return whole.select("set_id", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("context"))
