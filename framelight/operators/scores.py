"""Action scores, peaks, persistence and suppression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.config import Config
from framelight.functions import ranks
from framelight.functions.arrays import clip01
from framelight.functions.ordered import over_videos

#: Videos with at least so many frames are normalised between percentiles 2 and 98.
ROBUST_FROM = 50


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def robust_normalize(frames: DataFrame, columns: list[str]) -> DataFrame:
    """``frames`` with ``n_<column>`` in 0..1, by video; a flat signal becomes 0, rows without a video are a video of their own."""
    stacked = frames.select("video_id", F.explode(F.array(*(F.struct(F.lit(i).alias("signal"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for i, c in enumerate(columns)))).alias("s")).select("video_id", "s.*")
    found = ranks.quantiles(stacked, ["video_id", "signal"], "value", {"least": 0.0, "low": 0.02, "high": 0.98, "most": 1.0})
    robust = F.col("n") >= ROBUST_FROM
    low, high = F.when(robust, F.col("low")).otherwise(F.col("least")), F.when(robust, F.col("high")).otherwise(F.col("most"))
    of = lambda i, bound: F.max(F.when(F.col("signal") == i, bound))
    bounds = found.groupBy(F.col("video_id").alias("_video")).agg(*(of(i, bound).alias(f"{name}_{c}") for i, c in enumerate(columns) for name, bound in (("lo", low), ("hi", high))))

    def scaled(c: str) -> Column:
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(width < 1e-8, 0.0).otherwise(clip01((F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"lo_{c}")) / width))

    return frames.join(bounds, F.col("video_id").eqNullSafe(F.col("_video"))).select(*frames.columns, *(scaled(c).alias(f"n_{c}") for c in columns))


def action_score(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """``frames`` with action_score: the weighted mean of the normalised signals."""
    weights = {"residual_energy": config.residual_weight, "motion_magnitude": config.motion_weight, "entropy": config.entropy_weight}
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("signal weights must have a positive sum")
    normalised = robust_normalize(frames, list(weights))
    blend = sum((F.lit(w) * F.col(f"n_{c}") for c, w in weights.items()), F.lit(0.0)) / total
    return normalised.withColumn("action_score", clip01(blend)).drop(*(f"n_{c}" for c in weights))


def find_peaks(scored: DataFrame) -> DataFrame:
    """video_id, frame_idx, height of strict local maxima; a plateau stands at its middle, ends never count."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    changed = F.coalesce((F.col("action_score") != F.lag("action_score").over(w)).cast("int"), F.lit(1))
    runs = scored.select("video_id", "frame_idx", "action_score", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = runs.groupBy("video_id", "run").agg(F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"), F.first("action_score").alias("height"))
    by_run = Window.partitionBy("video_id").orderBy("run")
    sides = runs.withColumn("before", F.lag("height").over(by_run)).withColumn("after", F.lead("height").over(by_run))
    return sides.filter("height > before and height > after").select("video_id", F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("frame_idx"), "height")


def spaced(places: np.ndarray, order: np.ndarray, gap: int) -> np.ndarray:
    """Which of the places stay when, in the given order, one nearer than ``gap`` to one that stays is dropped.

    Those that stay lie ``gap`` apart, so each stretch of that length holds one
    at most and only three stretches are looked at.
    """
    stays = np.zeros(len(places), dtype=bool)
    if gap <= 1:
        stays[:] = True
        return stays
    taken: dict[int, int] = {}
    for i in order.tolist():
        at = int(places[i])
        stretch = at // gap
        if all(abs(taken.get(stretch + d, at - gap) - at) >= gap for d in (-1, 0, 1)):
            taken[stretch], stays[i] = at, True
    return stays


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of the peaks (positions in ``x``) above the higher of the two minima up to the next strictly higher value on each side.

    A stack of falling values with the least value since each one gives a
    side's minima in one walk.
    """
    floors = []
    for values, wanted in ((x, peaks), (x[::-1], len(x) - 1 - peaks)):
        floor, stack = np.zeros(len(x)), []
        for i, v in enumerate(values.tolist()):
            least = v
            while stack and stack[-1][0] <= v:
                least = min(least, stack.pop()[1])
            stack.append((v, least))
            floor[i] = least
        floors.append(floor[wanted])
    return x[peaks] - np.maximum(*floors)


def local_peaks(frame: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and heights of strict local maxima, as :func:`find_peaks` defines them."""
    starts = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)
    ends = np.append(starts[1:], len(x)) - 1
    height = x[starts]
    inner = np.zeros(len(starts), dtype=bool)
    inner[1:-1] = (height[1:-1] > height[:-2]) & (height[1:-1] > height[2:])
    return (frame[starts[inner]] + frame[ends[inner]]) // 2, height[inner]


def _highest_first(at: np.ndarray, height: np.ndarray) -> np.ndarray:
    return np.lexsort((-at, -height))


def peak_distance(peaks: DataFrame, distance: int) -> DataFrame:
    """Peaks left when, from the highest down, those nearer than ``distance`` to one kept are dropped; of equals the later goes first."""
    return spaced_peaks(peaks, distance)


def spaced_peaks(peaks: DataFrame, gap: int, later_first: bool = True) -> DataFrame:
    """Peaks (frame_idx, height) left when, from the highest down, those nearer than ``gap`` to one kept are dropped."""

    def keep(at: np.ndarray, height: np.ndarray) -> list[np.ndarray]:
        return [spaced(at, np.lexsort((-at if later_first else at, -height)), gap)]

    return over_videos(peaks, ["frame_idx", "height"], [_field("stays", T.BooleanType())], keep).filter("stays").drop("stays")


def peak_prominence(peaks: DataFrame, scored: DataFrame) -> DataFrame:
    """``peaks`` with prominence: height above the higher of the two minima up to the next strictly higher frame on each side."""

    def measure(x: np.ndarray, height: np.ndarray) -> list[np.ndarray]:
        found, at = np.full(len(x), np.nan), np.flatnonzero(~np.isnan(height))
        found[at] = prominences(x, at)
        return [found]

    signal = scored.select("video_id", "frame_idx", "action_score").join(peaks.select("video_id", "frame_idx", F.col("height").cast("double").alias("height")), ["video_id", "frame_idx"], "left")
    measured = over_videos(signal, ["action_score", "height"], [_field("prominence", T.DoubleType())], measure)
    return measured.filter("height is not null").select("video_id", "frame_idx", "height", "prominence")


def score_frames(frames: DataFrame, config: Config = Config()) -> DataFrame:
    """``frames`` with action_score, persistence_value and is_peak; peaks are found in one walk over each video."""
    top = config.max_prominence

    def mark(frame: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        at, height = local_peaks(frame, x)
        at = at[spaced(at, _highest_first(at, height), config.peak_distance)]
        place = np.searchsorted(frame, at)
        place = place[frame[place] == at]  # the middle of a plateau may be a frame that's missing
        found = prominences(x, place)
        place, found = place[found >= config.peak_prominence], found[found >= config.peak_prominence]
        value = np.zeros(len(x))
        value[place] = np.minimum(found / top, 1.0) if top > 1e-8 else 0.0
        return [value, value >= config.persistence_threshold]

    return over_videos(action_score(frames, config), ["frame_idx", "action_score"], [_field("persistence_value", T.DoubleType()), _field("is_peak", T.BooleanType())], mark)


def persistence(peaks: DataFrame, config: Config = Config()) -> DataFrame:
    """``peaks`` with persistence_value: prominence over its calibrated maximum, 1 at most."""
    top = config.max_prominence
    value = F.lit(0.0) if top <= 1e-8 else F.least(F.col("prominence") / top, F.lit(1.0))
    return peaks.withColumn("persistence_value", value)


def nms(scored: DataFrame, window: int | None = 10) -> DataFrame:
    """``scored`` with is_peak cleared for peaks within ``window`` of a higher one that stays."""
    if not window or window <= 0:
        return scored

    def clear(frame: np.ndarray, x: np.ndarray, peak: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(peak.astype(bool))
        out = np.zeros(len(x), dtype=bool)
        out[at[spaced(frame[at], np.lexsort((frame[at], -x[at])), window + 1)]] = True
        return [out]

    given = scored.withColumn("is_peak", F.coalesce("is_peak", F.lit(False)))
    return over_videos(given, ["frame_idx", "action_score", "is_peak"], [_field("is_peak", T.BooleanType())], clear).select(*scored.columns)


def nms_parents(scored: DataFrame, suppressed: DataFrame, window: int = 10) -> DataFrame:
    """Suppressed peaks with the highest peak within the window that stayed."""
    was, stays = scored.filter("is_peak").select("video_id", "frame_idx", "action_score"), suppressed.filter("is_peak").select("video_id", F.col("frame_idx").alias("parent"), F.col("action_score").alias("s"))
    gone = was.join(stays, (was["video_id"] == stays["video_id"]) & (was["frame_idx"] == stays["parent"]), "left_anti")
    # parents lie in the same stretch of the window's length or a neighbouring one
    near = gone.withColumn("stretch", F.explode(F.array(*(F.floor(F.col("frame_idx") / window) + d for d in (-1, 0, 1)))))
    met = near.join(stays.withColumn("stretch", F.floor(F.col("parent") / window)), ["video_id", "stretch"]).filter(F.abs(F.col("frame_idx") - F.col("parent")) <= window)
    return met.groupBy("video_id", "frame_idx").agg(F.min(F.struct((-F.col("s")).alias("s"), "parent")).alias("best")).select("video_id", "frame_idx", F.col("best.parent").alias("nms_parent"))


def top_frames(scored: DataFrame, n: int, peaks_only: bool = False) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("action_score"), "frame_idx"))
    return (scored.filter("is_peak") if peaks_only else scored).withColumn("rank", rank).filter(F.col("rank") <= n)


def rolling_features(frames: DataFrame, size: int = 30) -> DataFrame:
    """Means of the signals over the last ``size`` frames."""
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(1 - size, 0)
    return frames.select("video_id", "frame_idx", F.count("*").over(w).alias("buffered"), *(F.avg(c).over(w).alias(f"mean_{c}") for c in ("residual_energy", "motion_magnitude", "entropy")))
