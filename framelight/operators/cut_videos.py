"""Peaks, prominence and suppression of videos cut into ranges of frames.

The walks of ``scores`` hold one open video in a task. Here a video is cut into
ranges of ``size`` frames that are worked on by themselves; each leaves a small
summary, and only summaries are walked over in order, one row a range:

- a range's first and last run of equal values, from which plateaus that cross
  cuts are put together;
- for prominence, the falling steps of maxima that can be seen from a range's
  end with the least value after each, and the peaks whose walk left the range;
- suppression looks at a range with its neighbours and tells what is certain
  whatever lies beyond. A video in which a chain of peaks outruns a neighbouring
  range goes to the one-task walk.

Results equal those of ``scores``.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.config import Config
from framelight.functions.ordered import in_order
from framelight.operators import scores

SIZE = 4096


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _range(size: int):
    return F.floor(F.col("frame_idx") / size)


def _walk(summaries: DataFrame, order: list[str], step: Callable[[dict | None, dict], tuple[dict, list[tuple]]], names: list[str], schema: str) -> DataFrame:
    """Summary rows in order, key by key, with a state: ``step`` gets the state (None for a new key) and a row, and returns the next state and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kinds = None, None, None
        for batch in batches:
            kinds = kinds or batch.schema.field("video_id").type
            found: list[tuple] = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in order[:-1])
                state, rows = step(state if own == key else None, row)
                found += rows
                key = own
            columns = list(zip(*found, strict=True)) or [[] for _ in names]
            types = [kinds, *([pa.int32()] if names[1] == "frame_idx" else []), *[pa.float64()] * (len(names) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return in_order(summaries, order[:-1], order[-1]).mapInArrow(run, schema)


def find_peaks(scored: DataFrame, size: int = SIZE) -> DataFrame:
    """As :func:`scores.find_peaks`."""
    video = _kind(scored, "video_id")
    edge = ["first_start", "first_end", "last_start", "last_end"]
    heights = ["first", "second", "before_last", "last"]

    def runs(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        frame, x = rows.column("frame_idx").to_numpy(), rows.column("action_score").to_numpy()
        starts = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)
        ends, h = np.append(starts[1:], len(x)) - 1, x[starts]
        inner = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])) + 1
        peaks = (frame[starts[inner]] + frame[ends[inner]]) // 2
        n, more = len(inner), len(h) > 1
        ints = [frame[starts[0]], frame[ends[0]], frame[starts[-1]], frame[ends[-1]]]
        reals = [h[0], h[1] if more else math.nan, h[-2] if more else math.nan, h[-1]]
        columns = {
            "video_id": pa.array([key[0].as_py()] * (n + 1), type=rows.schema.field("video_id").type),
            "at": np.full(n + 1, key[1].as_py()),
            "frame_idx": pa.array([*peaks.tolist(), None], type=pa.int32()),
            "height": np.append(h[inner], math.nan),
            "many": np.full(n + 1, more),
            **{c: np.full(n + 1, v, dtype=np.int64) for c, v in zip(edge, ints, strict=True)},
            **{c: np.full(n + 1, v) for c, v in zip(heights, reals, strict=True)},
        }
        return pa.table(columns)

    def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
        found = []

        def settle(start: int, end: int, height: float, before: float | None, after: float) -> None:
            if before is not None and height > before and height > after:
                found.append((row["video_id"], (start + end) // 2, height))

        run = {"start": row["first_start"], "end": row["first_end"], "height": row["first"], "before": None}
        if state is not None:
            if state["height"] == row["first"]:
                run |= {"start": state["start"], "before": state["before"]}
            else:
                settle(state["start"], state["end"], state["height"], state["before"], row["first"])
                run["before"] = state["height"]
        if row["many"]:
            settle(run["start"], run["end"], run["height"], run["before"], row["second"])
            run = {"start": row["last_start"], "end": row["last_end"], "height": row["last"], "before": row["before_last"]}
        return run, found

    schema = ", ".join([f"video_id {video}, at long, frame_idx int, height double, many boolean", *(f"{c} long" for c in edge), *(f"{c} double" for c in heights)])
    surveyed = scored.select("video_id", "frame_idx", F.col("action_score").cast("double").alias("action_score"), _range(size).alias("at")).groupBy("video_id", "at").applyInArrow(runs, schema)
    # inner peaks and summaries come from one pass; a range's summary is its row without a peak
    across = _walk(surveyed.filter("frame_idx is null"), ["video_id", "at"], step, ["video_id", "frame_idx", "height"], f"video_id {video}, frame_idx int, height double")
    return surveyed.filter("frame_idx is not null").select("video_id", "frame_idx", "height").union(across)


def certain(places: np.ndarray, order: np.ndarray, gap: int, low: float, high: float) -> np.ndarray:
    """What is sure of :func:`scores.spaced` when peaks outside [low, high) can't be seen: 1 stays, 0 goes, -1 can't be told.

    ``places`` are in order; ``order`` tells which of them goes first.
    """
    status, seen = np.full(len(places), -1), np.zeros(len(places), dtype=bool)
    for i in order.tolist():
        a, b = np.searchsorted(places, [places[i] - gap + 1, places[i] + gap])
        ahead = status[a:b][seen[a:b]]
        if (ahead == 1).any():
            status[i] = 0
        elif not (ahead == -1).any() and places[i] - gap + 1 >= low and places[i] + gap - 1 < high:
            status[i] = 1
        seen[i] = True
    return status


def suppress(peaks: DataFrame, gap: int, later_first: bool, size: int = SIZE) -> DataFrame:
    """The rows of ``peaks`` (video_id, frame_idx, height) that stay when, from the highest down, those nearer than ``gap`` to one that stays go."""
    if gap <= 1:
        return peaks
    size = max(size, 4 * gap)
    slim = peaks.select("video_id", "frame_idx", "height", _range(size).alias("own"))
    dealt = slim.withColumn("at", F.explode(F.array(*(F.col("own") + d for d in (-1, 0, 1)))))

    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        at = key[1].as_py()
        places, height, own = (rows.column(c).to_numpy() for c in ("frame_idx", "height", "own"))
        order = np.lexsort((-places if later_first else places, -height))
        sure = certain(places, order, gap, (at - 1) * size if at > 0 else -math.inf, (at + 2) * size)
        core = own == at
        return pa.table([rows.column("video_id").filter(pa.array(core)), pa.array(places[core].astype(np.int32)), pa.array(height[core]), pa.array(sure[core].astype(np.int32))], names=["video_id", "frame_idx", "height", "sure"])

    judged = dealt.groupBy("video_id", "at").applyInArrow(judge, f"video_id {_kind(peaks, 'video_id')}, frame_idx int, height double, sure int")
    chains = judged.filter("sure = -1").select("video_id").distinct()
    walked = scores.spaced_peaks(slim.select("video_id", "frame_idx", "height").join(chains, "video_id", "left_semi"), gap, later_first)
    return judged.filter("sure = 1").select("video_id", "frame_idx", "height").join(chains, "video_id", "left_anti").unionByName(walked)


def peak_distance(peaks: DataFrame, distance: int, size: int = SIZE) -> DataFrame:
    """As :func:`scores.peak_distance`."""
    return suppress(peaks, distance, True, size)


def floors(x: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Going left from each wanted place up to the next strictly higher value: the least value passed, and whether the walk left the array."""
    floor, left, stack = np.zeros(len(x)), np.zeros(len(x), dtype=bool), []
    for i, v in enumerate(x.tolist()):
        least = v
        while stack and stack[-1][0] <= v:
            least = min(least, stack.pop()[1])
        left[i], floor[i] = not stack, least
        stack.append((v, least))
    return floor[wanted], left[wanted]


def steps_seen(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maxima that can be seen from the right end, from left to right, and the least value after each."""
    after = np.append(np.maximum.accumulate(x[::-1])[::-1][1:], -math.inf)
    least = np.append(np.minimum.accumulate(x[::-1])[::-1][1:], math.inf)
    tops = x > after
    return x[tops], least[tops]


def peak_prominence(peaks: DataFrame, scored: DataFrame, size: int = SIZE) -> DataFrame:
    """As :func:`scores.peak_prominence`."""
    video = _kind(scored, "video_id")
    marks = peaks.select("video_id", "frame_idx", F.col("height").cast("double").alias("height"))
    signal = scored.select("video_id", "frame_idx", F.col("action_score").cast("double").alias("action_score")).join(marks, ["video_id", "frame_idx"], "left").withColumn("at", _range(size))

    def survey(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_idx")
        frame, x = rows.column("frame_idx").to_numpy(), rows.column("action_score").to_numpy()
        wanted = np.flatnonzero(rows.column("height").is_valid().to_numpy())
        out = []
        for side, (values, places) in enumerate(((x, wanted), (x[::-1], len(x) - 1 - wanted))):
            floor, left = floors(values, places)
            tops, least = steps_seen(values)
            at = key[1].as_py() if side == 0 else -key[1].as_py()
            lists = [c.tolist() for c in (frame[wanted], x[wanted], floor, left)]
            out.append((key[0].as_py(), side, at, float(x.min()), tops.tolist(), least.tolist(), *lists))
        names = ["video_id", "side", "at", "low", "tops", "least", "frames", "heights", "floors", "left"]
        kinds = [rows.schema.field("video_id").type, pa.int32(), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 2, pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 2, pa.list_(pa.bool_())]
        return pa.table([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
        tops, least, low = (state["tops"], state["least"], state["low"]) if state else ([], [], math.inf)
        found = []
        for frame, height, floor, left in zip(row["frames"], row["heights"], row["floors"], row["left"], strict=True):
            if left:  # the walk goes on over the ranges before
                above = bisect.bisect_left(tops, -height, key=lambda v: -v)  # how many of the falling steps are higher
                floor = min(floor, least[above - 1] if above else low)
            found.append((row["video_id"], frame, height, floor))
        most = max(row["tops"])
        kept = len(tops)
        while kept and tops[kept - 1] <= most:
            kept -= 1
        least = [min(v, row["low"]) for v in least[:kept]]
        return {"tops": tops[:kept] + row["tops"], "least": least + row["least"], "low": min(low, row["low"])}, found

    schema = f"video_id {video}, side int, at long, low double, tops array<double>, least array<double>, frames array<int>, heights array<double>, floors array<double>, left array<boolean>"
    surveyed = signal.groupBy("video_id", "at").applyInArrow(survey, schema)
    sides = _walk(surveyed, ["video_id", "side", "at"], step, ["video_id", "frame_idx", "height", "floor"], f"video_id {video}, frame_idx int, height double, floor double")
    return sides.groupBy("video_id", "frame_idx", "height").agg((F.col("height") - F.max("floor")).alias("prominence"))


def score_frames(frames: DataFrame, config: Config = Config(), size: int = SIZE) -> DataFrame:
    """As :func:`scores.score_frames`."""
    acted, top = scores.action_score(frames, config), config.max_prominence
    kept = peak_distance(find_peaks(acted, size), config.peak_distance, size)
    measured = peak_prominence(kept, acted, size).filter(F.col("prominence") >= config.peak_prominence)
    value = F.least(F.col("prominence") / top, F.lit(1.0)) if top > 1e-8 else F.lit(0.0)
    joined = acted.join(measured.select("video_id", "frame_idx", value.alias("persistence_value")), ["video_id", "frame_idx"], "left").withColumn("persistence_value", F.coalesce("persistence_value", F.lit(0.0)))
    return joined.select(*acted.columns, "persistence_value", (F.col("persistence_value") >= config.persistence_threshold).alias("is_peak"))


def nms(scored: DataFrame, window: int | None = 10, size: int = SIZE) -> DataFrame:
    """As :func:`scores.nms`."""
    if not window or window <= 0:
        return scored
    kept = suppress(scored.filter("is_peak").select("video_id", "frame_idx", F.col("action_score").cast("double").alias("height")), window + 1, False, size)
    joined = scored.drop("is_peak").join(kept.select("video_id", "frame_idx", F.lit(True).alias("is_peak")), ["video_id", "frame_idx"], "left")
    return joined.withColumn("is_peak", F.coalesce("is_peak", F.lit(False))).select(*scored.columns)
