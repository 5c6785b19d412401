"""Sinks: run logs, reports, thumbnails, payloads, and image files by a plug-in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run_log(runs: DataFrame, path: str) -> None:
    """Append runs (with ``run_date``) as JSON, a folder for each day."""
    runs.write.mode("append").partitionBy("run_date").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def thumbnail_rows(frames: DataFrame) -> DataFrame:
    """Kept frames (frame_key, image, mv) with the image as text and the count and mean length of vectors."""
    length = F.aggregate("mv", F.lit(0.0), lambda s, v: s + F.sqrt(v["motion_x"] ** 2 + v["motion_y"] ** 2))
    n = F.size("mv")
    return frames.select("frame_key", F.base64("image").alias("image_b64"), n.cast("long").alias("mv_count"), F.when(n > 0, F.round(length / n, 4)).otherwise(0.0).alias("mv_magnitude"))


def write_images(frames: DataFrame, render: Callable[[dict], None]) -> None:
    """Hand every row to a renderer that writes its image."""
    frames.foreachPartition(lambda rows: [render(r.asDict(recursive=True)) for r in rows] and None)


def to_payload(rows: DataFrame) -> DataFrame:
    """Every row as one JSON text."""
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("json"))
