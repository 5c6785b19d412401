"""Frame signals: residuals, entropies and the geometry of motion fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 16


def residual_energy(planes: DataFrame) -> DataFrame:
    """video_id, plane_id, residual_energy: mean absolute change of luma over 255; 1 for a video's first plane."""
    previous = F.lag("luma").over(Window.partitionBy("video_id").orderBy("plane_id"))
    change = F.aggregate(F.zip_with("luma", "previous", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    return planes.withColumn("previous", previous).select("video_id", "plane_id", F.coalesce(change / F.size("luma") / 255, F.lit(1.0)).alias("residual_energy"))


def entropy_bits(counts: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """Shannon entropy of the counts of each key."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(*key))
    return counts.withColumn("p", share).groupBy(*key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def luma_entropy(planes: DataFrame) -> DataFrame:
    """plane_id, entropy: of the 256-bin histogram, over 8 bits."""
    bins = planes.select("plane_id", F.explode("luma").alias("bin")).groupBy("plane_id", "bin").agg(F.count("*").alias("n"))
    return entropy_bits(bins, ["plane_id"]).select("plane_id", (F.col("entropy") / 8).alias("entropy"))


def motion_magnitude(frames: DataFrame, vectors: DataFrame) -> DataFrame:
    """frame_key, motion_magnitude: mean length of a frame's vectors, 0 without any."""
    mean = vectors.groupBy("frame_key").agg(F.avg(F.sqrt(F.col("motion_x") ** 2 + F.col("motion_y") ** 2)).alias("mean"))
    return frames.join(mean, "frame_key", "left").select("frame_key", F.coalesce("mean", F.lit(0.0)).alias("motion_magnitude"))


def _grid_size(width: int, height: int) -> tuple[int, int]:
    return max(1, width // CELL), max(1, height // CELL)


def _cell_lists(vectors: DataFrame, width: int, height: int) -> DataFrame:
    """frame_key and its cells that hold vectors, as structs of place c, u, v: only these are shuffled."""
    across, down = _grid_size(width, height)
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(F.col(c) / CELL), F.lit(n - 1))).cast("int")
    means = vectors.groupBy("frame_key", at("dst_x", across).alias("gx"), at("dst_y", down).alias("gy")).agg(F.avg("motion_x").alias("u"), F.avg("motion_y").alias("v"))
    return means.groupBy("frame_key").agg(F.collect_list(F.struct((F.col("gy") * across + F.col("gx")).alias("c"), "u", "v")).alias("cells"))


def motion_grid(vectors: DataFrame, width: int, height: int) -> DataFrame:
    """frame_key, gx, gy, u, v: the mean vector of every cell of 16 pixels; 0 where a cell has none."""
    across, down = _grid_size(width, height)
    cells = _cell_lists(vectors, width, height).select("frame_key", F.map_from_entries(F.transform("cells", lambda x: F.struct(x["c"], F.struct(x["u"].alias("u"), x["v"].alias("v"))))).alias("cells"))
    dense = cells.select("frame_key", "cells", F.explode(F.sequence(F.lit(0), F.lit(across * down - 1))).alias("c"))
    value = lambda f: F.coalesce(F.col("cells")[F.col("c")][f], F.lit(0.0)).alias(f)
    return dense.select("frame_key", (F.col("c") % across).alias("gx"), F.floor(F.col("c") / across).cast("int").alias("gy"), value("u"), value("v"))


def gradient(column: str, axis: str) -> Column:
    """Central difference along ``gx`` or ``gy``, one-sided at the edges, 0 on a grid of one cell that way."""
    other = "gy" if axis == "gx" else "gx"
    w = Window.partitionBy("frame_key", other).orderBy(axis)
    before, after, here = F.lag(column).over(w), F.lead(column).over(w), F.col(column)
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - here).when(before.isNotNull(), here - before).otherwise(0.0)


def motion_fields(vectors: DataFrame, width: int, height: int) -> DataFrame:
    """The grid with magnitude m and all first and second derivatives, in one shuffle by frame."""
    grid = motion_grid(vectors, width, height).withColumn("m", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2))
    flat = min(width // CELL, height // CELL) <= 1
    grad = (lambda c, axis: F.lit(0.0)) if flat else gradient
    first = grid.select("*", *(grad(c, f"g{a}").alias(f"{c}_{a}") for c in "uvm" for a in "xy"))
    return first.select("*", *(grad(f"m_{a}", f"g{b}").alias(f"m_{a}{b}") for a in "xy" for b in "xy"))


GEOMETRY = ["divergence", "curl", "jacobian_frobenius", "hessian_max_eigenvalue", "motion_entropy"]


def grid_geometry(u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """The measures of ``GEOMETRY`` for a stack of grids (frame, gy, gx)."""
    m = np.sqrt(u * u + v * v)

    def slopes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if min(x.shape[1:]) <= 1:
            return np.zeros_like(x), np.zeros_like(x)
        along_y, along_x = np.gradient(x, axis=(1, 2))
        return along_x, along_y

    mean = lambda x: x.mean(axis=(1, 2))
    (u_x, u_y), (v_x, v_y), (m_x, m_y) = slopes(u), slopes(v), slopes(m)
    (m_xx, m_xy), (m_yx, m_yy) = slopes(m_x), slopes(m_y)
    root = np.sqrt(np.maximum(0.0, (m_xx - m_yy) ** 2 + 4 * m_yx * m_xy))
    top = m.max(axis=(1, 2))
    moving = top > 1e-5
    bins = np.minimum(np.floor(m / np.where(moving, top, 1)[:, None, None] * 10), 9).astype(np.int64).reshape(len(m), -1)
    share = np.stack([(bins == b).mean(axis=1) for b in range(10)], axis=1)
    bits = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(axis=1)
    return [mean(u_x + v_y), mean(np.abs(v_x - u_y)), mean(np.sqrt(u_x**2 + u_y**2 + v_x**2 + v_y**2)), mean((np.abs(m_xx + m_yy) + root) / 2), np.where(moving, bits, 0.0)]


def motion_geometry(frames: DataFrame, vectors: DataFrame, width: int, height: int) -> DataFrame:
    """frame_key, divergence, curl, jacobian_frobenius, hessian_max_eigenvalue, motion_entropy; zeros without vectors or size.

    A frame's grid is one small array, so its derivatives need no windows: stacks
    of grids of bounded size are measured in Arrow batches.
    """
    if width <= 0 or height <= 0:
        return frames.select("frame_key", *(F.lit(0.0).alias(n) for n in GEOMETRY))
    across, down = _grid_size(width, height)
    most = max(1, (1 << 20) // (across * down))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, most):
                batch = whole.slice(low, most)
                lists = batch.column(1)
                frame = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                c, u, v = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                grids = np.zeros((2, len(lists), down * across))
                grids[0, frame, c], grids[1, frame, c] = u, v
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, grid_geometry(*grids.reshape(2, len(lists), down, across)))], names=["frame_key", *GEOMETRY])

    kind = vectors.schema["frame_key"].dataType.simpleString()
    measured = _cell_lists(vectors, width, height).mapInArrow(measure, ", ".join([f"frame_key {kind}", *(f"{n} double" for n in GEOMETRY)]))
    joined = frames.join(measured, "frame_key", "left")
    return joined.select("frame_key", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in GEOMETRY))


def frame_type(pict_type: Column, key_frame: Column) -> Column:
    """The picture type by name, else I for key frames and P for others."""
    return F.coalesce(pict_type, F.when(key_frame, F.lit("I")).otherwise(F.lit("P")))


def timestamp_resolve(time: Column, pts: Column, time_base: Column) -> Column:
    return F.coalesce(time, pts * time_base, F.lit(0.0))


def join_scores(output: DataFrame, scores: DataFrame) -> DataFrame:
    """Output frames with their scores; 0 and false where there is none."""
    slim = scores.select("video_id", "frame_idx", "action_score", "is_peak", "persistence_value")
    joined = output.join(slim, ["video_id", "frame_idx"], "left")
    return joined.withColumns({"action_score": F.coalesce("action_score", F.lit(0.0)), "is_peak": F.coalesce("is_peak", F.lit(False)), "persistence_value": F.coalesce("persistence_value", F.lit(0.0))})
