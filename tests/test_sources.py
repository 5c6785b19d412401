"""Sources and sinks: decoding by plug-in, frame files, logs, payloads."""

import json

import pytest
from pyspark.sql import functions as F

from framelight.sources import sinks, video


def decoder(content):
    """Frames of a toy file: one for each line."""
    if content.startswith(b"!"):
        raise ValueError("no video stream")
    for i, line in enumerate(content.decode().split()):
        yield {"frame_idx": i, "key_frame": i == 0, "width": 2, "height": 1, "luma": [len(line), 0], "motion_vectors": [] if i == 0 else [{"src_x": 0, "src_y": 0, "dst_x": 1, "dst_y": 1, "motion_x": 1.0, "motion_y": 0.0}]}


def test_read_video(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x yy zzz")
    out = video.read_video(spark, str(tmp_path), decoder).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["luma"], len(r["motion_vectors"])) for r in out] == [(0, [1, 0], 0), (1, [2, 0], 1), (2, [3, 0], 1)]
    (tmp_path / "b.mp4").write_bytes(b"!")
    with pytest.raises(Exception, match="no video stream"):
        video.read_video(spark, str(tmp_path), decoder).count()


def test_frames_json(spark, tmp_path):
    path = tmp_path / "frames.json"
    path.write_text(json.dumps([{"frame_idx": 1, "tier": "PEAK", "image_b64": "aa"}, {"frame_idx": 2, "tier": "SKIP", "image_b64": "bb"}]))
    frames = video.read_frames_json(spark, str(path))
    assert "image_b64" not in video.frame_list(frames).columns
    assert video.frame_image(frames, 2).first()["image_b64"] == "bb" and video.frame_image(frames, 9).count() == 0


def test_logs_and_reports(spark, tmp_path):
    runs = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "run_date string, n int")
    for _ in range(2):
        sinks.write_run_log(runs, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_report(runs, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    assert json.loads(sinks.to_payload(runs).first()["json"]) == {"run_date": "2024-01-01", "n": 1}


def test_thumbnails_and_images(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(b"hi"), [(3.0, 4.0)]), (2, bytearray(b""), [])], "frame_key long, image binary, mv array<struct<motion_x: double, motion_y: double>>")
    out = {r["frame_key"]: r for r in sinks.thumbnail_rows(rows).collect()}
    assert (out[1]["image_b64"], out[1]["mv_count"], out[1]["mv_magnitude"]) == ("aGk=", 1, 5.0) and out[2]["mv_magnitude"] == 0.0
    folder = str(tmp_path)

    def render(row):
        with open(f"{folder}/frame_{row['frame_key']}.png", "wb") as f:
            f.write(bytes(row["image"]))

    sinks.write_images(rows, render)
    assert (tmp_path / "frame_1.png").read_bytes() == b"hi"


def test_uploads(spark):
    rows = spark.createDataFrame([("A.MP4", "q"), ("a.txt", "q"), ("b.mov", "  ")], "name string, question string")
    assert [r[0] for r in rows.select(video.upload_accepted(F.col("name"), F.col("question"))).collect()] == [True, False, False]
