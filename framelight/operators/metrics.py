"""Run metrics, ablations and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.operators.retrieval import uniform_sample_count

#: The four ablation conditions: whether frames are gated, and whether entailment runs.
CONDITIONS = (("baseline", False, False), ("ablation_1", True, False), ("ablation_2", False, True), ("full", True, True))
RATES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
#: Illustrative price of one frame in a model call.
COST = 0.0015


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def run_ratios(tiered: DataFrame) -> DataFrame:
    """video_id, skipped_ratio, reduction, peaks: of tiered and scored frames."""
    kept = F.col("tier") != "SKIP"
    n = tiered.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(kept & F.col("is_peak")).alias("peaks"))
    return n.select("video_id", ratio(F.col("total") - F.col("kept"), F.col("total")).alias("skipped_ratio"), ratio(F.col("total"), F.col("kept")).alias("reduction"), "peaks")


def validation_report(gated: DataFrame, captions: DataFrame, caches: DataFrame | None = None) -> DataFrame:
    """One row: verdict counts over all runs, the share of captions that succeeded, and, given the ``counters`` of caches, their sums and how many are full."""
    verdicts = gated.agg(F.sum("verified").alias("verified"), F.sum("rejected").alias("rejected"), F.sum("unverifiable").alias("unverifiable"))
    rate = captions.agg(ratio(F.count_if("success"), F.count("*")).alias("caption_success_rate"))
    if caches is None:
        return verdicts.crossJoin(rate)
    sums = caches.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"cache_{c}") for c in ("hits", "misses", "size")), F.count_if("is_full").alias("full_caches"))
    return verdicts.crossJoin(rate).crossJoin(sums)  # one row each


def ablation_conditions(spark) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, "condition string, gating boolean, nli boolean")


def ablation_metrics(conditions: DataFrame, frames: DataFrame, gated: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Frames kept, skip ratio and verdict counts by condition; ``gated`` holds verdict counts by nli flag.

    ``timings`` (condition, ms) of runs add their mean as latency_ms, null for a condition that wasn't timed.
    """
    n = frames.agg(F.count("*").alias("total"), F.count_if(F.col("tier") != "SKIP").alias("passed"))
    kept = F.when(F.col("gating"), F.col("passed")).otherwise(F.col("total"))
    joined = conditions.crossJoin(n).join(gated, "nli", "left")
    found = joined.select("condition", kept.alias("frames_kept"), ratio(F.col("total") - kept, F.col("total")).alias("skip_ratio"), *(F.coalesce(v, F.lit(0)).alias(v) for v in ("verified", "rejected", "unverifiable")))
    if timings is None:
        return found
    return found.join(timings.groupBy("condition").agg(F.avg("ms").alias("latency_ms")), "condition", "left")


def stage_profile(timings: DataFrame) -> DataFrame:
    """stage, mean_ms, share and rank of (stage, ms) timings."""
    mean = timings.groupBy("stage").agg(F.avg("ms").alias("mean_ms"))
    whole = Window.partitionBy()
    return mean.select("stage", "mean_ms", ratio(F.col("mean_ms") * 100, F.sum("mean_ms").over(whole)).alias("share"), F.row_number().over(Window.orderBy(F.desc("mean_ms"), "stage")).alias("rank"))


def search_pool(counts: DataFrame) -> DataFrame:
    """One row (total, candidates, peaks, retrieved) with reductions in percent."""
    cut = lambda a, b: (100 * ratio(F.col(a) - F.col(b), F.col(a))).alias(f"{b}_reduction")
    return counts.select("*", cut("total", "candidates"), cut("candidates", "peaks"), cut("total", "retrieved"))


def fps_sweep(videos: DataFrame) -> DataFrame:
    """(video_id, total, fps) at every rate: frames a uniform sample takes."""
    rated = videos.select("*", F.explode(F.array(*map(F.lit, RATES))).alias("rate"))
    return rated.select("video_id", "rate", uniform_sample_count(F.col("total"), F.col("fps"), F.col("rate")).alias("frames"))


def baseline_compare(videos: DataFrame) -> DataFrame:
    """(video_id, total, fps, kept) against a uniform sample of one frame a second."""
    base = videos.withColumn("uniform", uniform_sample_count(F.col("total"), F.col("fps"), F.lit(1.0)))
    return base.select(
        "video_id", "uniform", "kept", ratio(F.col("total"), F.col("uniform")).alias("uniform_reduction"), ratio(F.col("total"), F.col("kept")).alias("reduction"),
        (F.col("uniform") * COST).alias("uniform_cost"), (F.col("kept") * COST).alias("cost"), (100 * ratio(F.col("uniform") - F.col("kept"), F.col("uniform"))).alias("savings_pct"),
    )


def determinism_compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: rows that only one of two runs has, repeated rows as often as they are too many; each run is made once."""
    both = first.withColumn("_n", F.lit(1)).unionByName(second.withColumn("_n", F.lit(-1)))
    over = both.groupBy(*first.columns).agg(F.sum("_n").alias("_over"))
    more = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).cast("long")
    counts = over.agg(more(F.col("_over")).alias("only_first"), more(-F.col("_over")).alias("only_second"))
    return counts.withColumn("identical", (F.col("only_first") == 0) & (F.col("only_second") == 0))


# How the fallback text that reports a failure begins, and its word.
FALLBACK, FAILED = "Based on the video analysis, I processed", "failed"


def generation_succeeded(answer: Column) -> Column:
    """0 if the answer is the fallback text that reports a failure, else 1."""
    return F.when(answer.startswith(FALLBACK) & F.lower(answer).contains(FAILED), 0.0).otherwise(1.0)
