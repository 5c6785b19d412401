"""Scenes, adaptive thresholds, tiers and candidate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.config import Config
from framelight.functions import ranks

#: Percentiles and floors of the salient and candidate thresholds, and the fixed fallback of each.
SALIENT = (0.95, 0.002, 0.35)
CANDIDATE = (0.90, 0.001, 0.08)


def scene_segment(frames: DataFrame) -> DataFrame:
    """``frames`` with scene_id: a scene starts at every key frame and at frame 0."""
    start = (F.col("key_frame") | (F.col("frame_idx") == 0)).cast("int")
    running = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("scene_id", F.sum(start).over(running).cast("int")).withColumn("scene_start", start == 1)


def scene_thresholds(scened: DataFrame) -> DataFrame:
    """video_id, scene_id, salient_thresh, candidate_thresh, source of the percentiles.

    A scene without inner frames takes the video's; a video without any takes fixed values.
    """
    shares = {"salient": SALIENT[0], "candidate": CANDIDATE[0]}
    # a row for each energy of a scene's inner frames, and one for each of the video's, whose scene is null
    of_scene = F.when(~F.col("scene_start"), F.struct(F.col("scene_id").alias("scene"), F.col("residual_energy").alias("energy")))
    of_video = F.when(~F.col("key_frame"), F.struct(F.lit(None).cast("int").alias("scene"), F.col("residual_energy").alias("energy")))
    energies = scened.select("video_id", F.explode(F.array_compact(F.array(of_scene, of_video))).alias("e")).select("video_id", "e.*")
    found = ranks.quantiles(energies, ["video_id", "scene"], "energy", shares)
    scene, video = (found.filter(f"scene is {kind}").select(F.col("video_id").alias(f"video_{s}"), F.col("scene").alias(f"scene_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in shares)) for kind, s in (("not null", "own"), ("null", "all")))
    scenes = scened.select("video_id", "scene_id").distinct()
    joined = scenes.join(scene, F.col("video_id").eqNullSafe(F.col("video_own")) & (F.col("scene_id") == F.col("scene_own")), "left").join(video, F.col("video_id").eqNullSafe(F.col("video_all")), "left")

    def threshold(name: str, floor: float, fixed: float) -> Column:
        return F.when(F.col(f"{name}_own").isNotNull(), F.greatest(F.lit(floor), f"{name}_own")).when(F.col(f"{name}_all").isNotNull(), F.greatest(F.lit(floor), f"{name}_all")).otherwise(F.lit(fixed))

    source = F.when(F.col("salient_own").isNotNull(), "scene").when(F.col("salient_all").isNotNull(), "video").otherwise("fixed")
    return joined.select("video_id", "scene_id", threshold("salient", *SALIENT[1:]).alias("salient_thresh"), threshold("candidate", *CANDIDATE[1:]).alias("candidate_thresh"), source.alias("source"))


def reported_thresholds(thresholds: DataFrame) -> DataFrame:
    return thresholds.groupBy("video_id").agg(F.min("salient_thresh").alias("salient_thresh"), F.min("candidate_thresh").alias("candidate_thresh"))


def with_thresholds(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """``frames`` with scene and thresholds, adaptive or fixed by the settings."""
    scened = scene_segment(frames)
    if not config.adaptive:
        return scened.withColumn("salient_thresh", F.lit(config.salient_thresh)).withColumn("candidate_thresh", F.lit(config.candidate_thresh))
    return scened.join(scene_thresholds(scened).drop("source"), ["video_id", "scene_id"])


def is_tier_peak(order: int = 3) -> Column:
    """Strictly above every frame within ``order`` on both sides, and at the scene's salient floor."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    e = F.col("residual_energy")
    above = (e > F.max(e).over(w.rowsBetween(-order, -1))) & (e > F.max(e).over(w.rowsBetween(1, order)))
    return F.coalesce(above & (e >= F.col("salient_thresh")), F.lit(False))


def classify_tiers(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """``frames`` with thresholds, tier_peak and tier."""
    e = F.col("residual_energy")
    tier = F.when(F.col("key_frame"), "I_FRAME").when(F.col("tier_peak"), "PEAK").when(e > F.col("salient_thresh"), "SALIENT").when(e >= F.col("candidate_thresh"), "CANDIDATE").otherwise("SKIP")
    return with_thresholds(frames, config).withColumn("tier_peak", is_tier_peak(config.peak_order)).withColumn("tier", tier)


def filter_skip(tiered: DataFrame) -> DataFrame:
    return tiered.filter("tier <> 'SKIP'")


def tier_stats(tiered: DataFrame) -> DataFrame:
    """Frames in total and of each tier, by video."""
    return tiered.groupBy("video_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("I_FRAME", "PEAK", "SALIENT", "CANDIDATE", "SKIP")))


def candidates(scored: DataFrame, strategy: str, k: int = 5) -> DataFrame:
    """The frames to index, by strategy; others than the three named keep all."""
    if strategy == "peak_only":
        return scored.filter("is_peak")
    if strategy == "top_k_action":
        rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("action_score"), "frame_idx"))
        return scored.withColumn("_rank", rank).filter(F.col("_rank") <= 3 * k).drop("_rank")
    if strategy == "peak_neighbors":
        # each peak names the frames within 2 of it, so the band join is an equality join
        near = scored.filter("is_peak").select("video_id", F.explode(F.sequence(F.col("frame_idx") - 2, F.col("frame_idx") + 2)).alias("frame_idx"))
        return scored.join(near, ["video_id", "frame_idx"], "left_semi")
    return scored


def viewer_filter(tiered: DataFrame, tier: str = "ALL") -> DataFrame:
    return tiered if tier == "ALL" else tiered.filter(F.col("tier") == tier)


def filter_sort(frames: DataFrame, label: str | None = None, by: str = "frame_idx", ascending: bool = True) -> DataFrame:
    """Rows of one tier label (all if None), ordered by a numeric column."""
    if by not in ("frame_idx", "action_score", "persistence_value"):
        raise ValueError(f"cannot sort by {by}")
    chosen = frames if label is None else frames.filter(F.col("tier") == label)
    return chosen.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), "video_id", "frame_idx")
