"""Structured Streaming variants: residuals, caches and feature buffers with per-video state, and windowed run ratios.

An extension; batch queries stay the reference for results that need a whole
video (percentiles, normalisation).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelight.config import Config
from framelight.operators.cache import SIGNALS, _Replay

RESIDUAL = "video_id long, event_id long, ts timestamp, residual_energy double"


def stream_residuals(events: DataFrame) -> DataFrame:
    """Residual of each event (video_id, event_id, ts, value) against the video's last one, kept as state.

    Within a micro-batch the rows of a video are put in order of (ts, event_id);
    the source must deliver micro-batches in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one video's rows of one micro-batch
        before = rows["value"].shift()
        before.iloc[0] = last
        residual = ((rows["value"] - before.astype(float)).abs() / 600).fillna(1.0)
        state.update((float(rows["value"].iloc[-1]),))
        yield pd.DataFrame({"video_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "residual_energy": residual})

    keyed = events.select("video_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value").groupBy("video_id")
    return keyed.applyInPandasWithState(step, RESIDUAL, "last double", "append", GroupStateTimeout.NoTimeout)


_ENTRY = ["frame_idx", *SIGNALS, "admitted_at"]
_CACHE = f"hits long, misses long, counter long, entries array<struct<frame_idx: int, {', '.join(f'{c}: double' for c in SIGNALS)}, admitted_at: long>>"


def stream_evictions(arrivals: DataFrame, capacity: int, config: Config = Config()) -> DataFrame:
    """(video_id, arrival, frame_idx, victim, keep_score): evictions as arrivals (video_id, arrival, frame_idx and the signals) come in.

    The state of a video is its counters and its entries in order, at most
    ``capacity``. Within a micro-batch a video's rows are put in order of arrival;
    the source must deliver micro-batches in order. As in the batch operator.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = _Replay(capacity, config)
        if state.exists:
            cache.hits, cache.misses, cache.counter, entries = state.get
            cache.entries = {e[0]: {"video_id": key[0], **dict(zip(_ENTRY, e, strict=True))} for e in entries}
        out = []
        for row in pd.concat(list(batches)).sort_values("arrival").to_dict("records"):
            if gone := cache.arrive(row):
                out.append((key[0], row["arrival"], row["frame_idx"], *gone))
        state.update((cache.hits, cache.misses, cache.counter, [tuple(e[c] for c in _ENTRY) for e in cache.entries.values()]))
        yield pd.DataFrame(out, columns=["video_id", "arrival", "frame_idx", "victim", "keep_score"])

    keyed = arrivals.select("video_id", "arrival", "frame_idx", *SIGNALS).groupBy("video_id")
    return keyed.applyInPandasWithState(step, "video_id long, arrival long, frame_idx int, victim int, keep_score double", _CACHE, "append", GroupStateTimeout.NoTimeout)


_MEANS = ("residual_energy", "motion_magnitude", "entropy")
_FEATURES = ", ".join(f"{c} double" for c in _MEANS)


def stream_features(frames: DataFrame, late: str = "10 minutes", size: int = 30) -> DataFrame:
    """video_id, frame_idx, buffered and the signals' means over the last ``size`` frames, in the order of (ts, frame_idx) however rows arrive.

    A frame waits in the state of its video until the watermark has passed it,
    when data or an event-time timer wakes the video; frames later than ``late``
    are dropped. The state is a ring of the last ``size`` signals and the frames
    that wait. Null signals don't count in a mean; null times never get past the
    watermark and are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["micros", "frame_idx", *_MEANS]
        ring, waiting = state.get if state.exists else ([], [])
        come = [b[names] for b in batches]
        rows = pd.concat([pd.DataFrame([tuple(w) for w in waiting], columns=names), *come]).sort_values(["micros", "frame_idx"], kind="stable")
        passed = state.getCurrentWatermarkMs() * 1000
        due, stay = rows[rows["micros"] <= passed], rows[rows["micros"] > passed]
        values = np.concatenate([np.array([tuple(r) for r in ring], dtype=float).reshape(-1, len(_MEANS)), due[list(_MEANS)].to_numpy(dtype=float)])
        keep = lambda table: [tuple(None if np.isnan(v) else float(v) for v in row) for row in table]
        held = [(int(m), int(i), *signals) for m, i, signals in zip(stay["micros"], stay["frame_idx"], keep(stay[list(_MEANS)].to_numpy(dtype=float)), strict=True)]
        state.update((keep(values[-size:]), held))
        if held:
            state.setTimeoutTimestamp(-(-held[0][0] // 1000))
        padded = np.concatenate([np.full((size, len(_MEANS)), np.nan), values])
        windows = np.lib.stride_tricks.sliding_window_view(padded, size, axis=0)[1 + len(values) - len(due) :]
        known = (~np.isnan(windows)).sum(2)
        means = np.divide(np.nansum(windows, axis=2), known, out=np.full(known.shape, np.nan), where=known > 0)
        buffered = np.minimum(np.arange(len(ring), len(values)) + 1, size)
        yield pd.DataFrame({"video_id": key[0], "frame_idx": due["frame_idx"].to_numpy(), "buffered": buffered, **{f"mean_{c}": means[:, k] for k, c in enumerate(_MEANS)}})

    timed = frames.select("video_id", "frame_idx", F.col("ts").cast("timestamp").alias("ts"), *(F.col(c).cast("double").alias(c) for c in _MEANS)).withWatermark("ts", late)
    keyed = timed.filter("ts is not null").withColumn("micros", F.unix_micros("ts")).groupBy("video_id")
    kept = f"ring array<struct<{_FEATURES}>>, waiting array<struct<micros: long, frame_idx: int, {_FEATURES}>>".replace(" double", ": double")
    means = ", ".join(f"mean_{c} double" for c in _MEANS)
    return keyed.applyInPandasWithState(step, f"video_id long, frame_idx int, buffered long, {means}", kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_ratios(tiered: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Share of skipped frames in tumbling windows of (ts, tier); rows later than ``late`` are dropped."""
    windowed = tiered.withWatermark("ts", late).groupBy(F.window("ts", width))
    n = windowed.agg(F.count("*").alias("total"), F.count_if(F.col("tier") == "SKIP").alias("skipped"))
    return n.select("window.start", "total", (F.col("skipped") / F.col("total")).alias("skipped_ratio"))
