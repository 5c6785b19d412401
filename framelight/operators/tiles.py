"""All pairs of a video's nodes, tile by tile.

A video's nodes are cut by frame into tiles of at most ``2 * size - 1`` nodes.
The upper triangle of tiles is dealt out by (video, tile, tile), so one video's
pairs are made by as many tasks as it has tile pairs, a task holds two tiles at a
time, and each pair of tiles is a matrix product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 256


def tiled(nodes: DataFrame, size: int = TILE) -> DataFrame:
    """``nodes`` with tile, tiles and the lowest and highest score (low, high) of their video.

    Frames are counted in stretches of ``size``; tiles are whole stretches, so
    only one row a stretch is put in order. Frame numbers are unique in a video.
    """
    stretch = F.floor(F.col("frame_idx") / size)
    counts = nodes.groupBy("video_id", stretch.alias("stretch")).agg(F.count("*").alias("n"), F.min("action_score").alias("least"), F.max("action_score").alias("most"))
    video = Window.partitionBy("video_id")
    before = F.sum("n").over(video.orderBy("stretch")) - F.col("n")
    placed = counts.withColumn("tile", F.floor(before / size).cast("int"))
    placed = placed.select("video_id", "stretch", "tile", (F.max("tile").over(video) + 1).alias("tiles"), F.min("least").over(video).alias("low"), F.max("most").over(video).alias("high"))
    return nodes.withColumn("stretch", stretch).join(placed, ["video_id", "stretch"]).drop("stretch")


def pairs(nodes: DataFrame, columns: list[str], measure: Callable[[pa.Table, pa.Table], np.ndarray], name: str, size: int = TILE) -> DataFrame:
    """video_id, src, dst and ``name`` for all pairs of a video's nodes, src < dst.

    ``measure`` gets two tiles (frame_idx, low, high and ``columns``) and returns
    the matrix of their values; not-a-number becomes null.
    """
    cut = tiled(nodes.select("video_id", "frame_idx", *columns), size)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = cut.withColumn("other", other).withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")}).drop("other", "tiles")
    kinds = {f.name: f.dataType for f in nodes.schema}
    schema = T.StructType([T.StructField("video_id", kinds["video_id"]), T.StructField("src", kinds["frame_idx"]), T.StructField("dst", kinds["frame_idx"]), T.StructField(name, T.DoubleType())])

    def both(key: tuple, rows: pa.Table) -> pa.Table:
        tile = rows.column("tile").to_numpy()
        sides = []
        for wanted in (key[1].as_py(), key[2].as_py()):
            side = rows.filter(pa.array(tile == wanted))
            sides.append(side.sort_by("frame_idx"))
        a, b = sides
        src, dst = a.column("frame_idx").to_numpy(), b.column("frame_idx").to_numpy()
        i, j = np.nonzero(src[:, None] < dst[None, :])
        values = measure(a, b)[i, j]
        found = [pa.array([key[0].as_py()] * len(i), type=rows.schema.field("video_id").type), pa.array(src[i]), pa.array(dst[j]), pa.array(values, from_pandas=True)]
        return pa.table(found, names=["video_id", "src", "dst", name])

    return dealt.groupBy("video_id", "first", "second").applyInArrow(both, schema)


def _numbers(tile: pa.Table, name: str) -> np.ndarray:
    return tile.column(name).to_numpy().astype(float)


def coherences(a: pa.Table, b: pa.Table) -> np.ndarray:
    """One minus the score difference over the video's score range; 1 on a flat video."""
    low, high = _numbers(a, "low")[:1], _numbers(a, "high")[:1]
    apart = np.abs(_numbers(a, "action_score")[:, None] - _numbers(b, "action_score")[None, :])
    width = high - low
    return np.ones_like(apart) if len(width) and width[0] == 0 else 1 - apart / width


def unit_rows(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings at length 1, padded with zeros, and their lengths; a null has length -1."""
    lists = tile.column("embedding").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    rows = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)))
    inside = np.arange(rows.shape[1])[None, :] < sizes[:, None]
    rows[inside] = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0), sizes


def products(x: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Cosines of what :func:`unit_rows` gave; 0 with a zero vector or vectors of different lengths, not-a-number with a null."""
    d = min(x.shape[1], y.shape[1])
    out = np.where(x_size[:, None] == y_size[None, :], x[:, :d] @ y[:, :d].T, 0.0)
    out[x_size < 0, :] = np.nan
    out[:, y_size < 0] = np.nan
    return out


def cosines(a: pa.Table, b: pa.Table) -> np.ndarray:
    """The cosines of two tiles' embeddings."""
    return products(*unit_rows(a), *unit_rows(b))
