"""Video sources: binary files decoded by a plug-in, container facts, uploads, frame files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "array<struct<src_x: int, src_y: int, dst_x: int, dst_y: int, motion_x: double, motion_y: double>>"
DECODED = f"path string, frame_idx int, pict_type string, key_frame boolean, time double, pts long, time_base double, width int, height int, luma array<int>, motion_vectors {VECTORS}"
SUFFIXES = ("mp4", "mov", "avi", "mkv", "webm")
DEFAULT_FPS = 25.0


def read_video(spark: SparkSession, path: str, decoder: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Frames of all files under ``path``. The decoder yields a dict for each frame (fields of ``DECODED``
    but the path), with empty vectors for I frames, and raises if a file has no video stream."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DECODED.replace(VECTORS, "vectors").split(", ")]
        for files in batches:
            for file in files.itertuples():
                rows = []
                for frame in decoder(bytes(file.content)):
                    rows.append({**dict.fromkeys(names), "motion_vectors": [], **frame, "path": file.path})
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(decode, DECODED)


def video_stats(meta: DataFrame, frames: DataFrame) -> DataFrame:
    """video_id, frames, fps, duration_sec; what the container doesn't tell is counted from the frames."""
    counted = frames.groupBy("video_id").agg(F.count("*").alias("_n"), F.max("timestamp_sec").alias("_end"))
    return meta.join(counted, "video_id", "left").select(
        "video_id", F.coalesce("meta_frames", "_n", F.lit(0)).alias("frames"), F.coalesce("fps", F.lit(DEFAULT_FPS)).alias("fps"), F.coalesce("duration_sec", "_end", F.lit(0.0)).alias("duration_sec")
    )


def upload_accepted(name: Column, question: Column) -> Column:
    """Whether a request has a known suffix and a question."""
    return F.lower(name).rlike(rf"\.({'|'.join(SUFFIXES)})$") & (F.trim(question) != "")


def read_frames_json(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a JSON array file, images included."""
    return spark.read.option("multiLine", True).json(path)


def frame_list(frames: DataFrame) -> DataFrame:
    """Frames without their images, for listing."""
    return frames.drop("image_b64")


def frame_image(frames: DataFrame, frame_idx: int) -> DataFrame:
    """The image of one frame; no row if there is none."""
    return frames.filter(F.col("frame_idx") == frame_idx).select("frame_idx", "image_b64")
