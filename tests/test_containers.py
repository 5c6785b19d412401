"""A container read in splits, and files that are committed once."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from framelight.sources.containers import FileSink, FileWriter, VideoContainer
from tests.conftest import ROOT


def container(path, groups):
    bodies = [json.dumps(g).encode() for g in groups]
    path.write_bytes(json.dumps([[len(b), len(g)] for b, g in zip(bodies, groups, strict=True)]).encode() + b"\n" + b"".join(bodies))


def frames(n, start=0):
    return [{"key_frame": k == 0, "time": (start + k) / 25, "pts": start + k, "luma": [start + k, 1], "motion_vectors": [] if k == 0 else [{"src_x": k, "src_y": 0, "dst_x": 1, "dst_y": 2, "motion_x": 0.5, "motion_y": -0.5}]} for k in range(n)]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    groups, at = [], 0
    for n in (5, 1, 9, 4, 7, 3):
        groups.append(frames(n, at))
        at += n
    container(tmp_path / "a.grp", groups)
    container(tmp_path / "empty.grp", [])
    spark.dataSource.register(VideoContainer)
    found = spark.read.format("video_container").option("split_bytes", 600).load(str(tmp_path))
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) >= 4
    assert sorted((r["frame_idx"], r["pts"], r["luma"][0], r["key_frame"], len(r["motion_vectors"])) for r in rows) == sorted((f["pts"], f["pts"], f["luma"][0], f["key_frame"], len(f["motion_vectors"])) for g in groups for f in g)
    whole = spark.read.format("video_container").load(str(tmp_path / "a.grp"))
    assert whole.rdd.getNumPartitions() == 1 and sorted(map(str, whole.collect())) == sorted(map(str, found.collect()))
    few = spark.read.format("video_container").schema("frame_idx int, time double").load(str(tmp_path)).orderBy("frame_idx").collect()
    assert [tuple(r) for r in few] == [(k, k / 25) for k in range(29)]


def test_files_are_committed_and_replaced(spark, tmp_path):
    spark.dataSource.register(FileSink)
    rows = spark.range(0, 20, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    rows.write.format("committed_files").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"f{k}" for k in range(20)) and (tmp_path / "out/f7").read_bytes() == b"7"
    rows.filter("name = 'f3'").write.format("committed_files").mode("overwrite").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["f3"]
    with pytest.raises(Exception, match="not a file name"):
        rows.select(F.lit("../x").alias("name"), "content").write.format("committed_files").mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["f3"]


def test_only_attempts_that_count_are_moved(tmp_path):
    writer = FileWriter(str(tmp_path), False)
    writer.write(iter([Row(name="a", content=b"lost attempt"), Row(name="b", content=b"lost")]))
    writer.commit([writer.write(iter([Row(name="a", content=b"kept")])), None])
    assert os.listdir(tmp_path) == ["a"] and (tmp_path / "a").read_bytes() == b"kept"
    writer.write(iter([Row(name="c", content=b"never")]))
    writer.abort([])
    assert os.listdir(tmp_path) == ["a"]


RETRY = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from framelight.sources.containers import FileSink

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.dataSource.register(FileSink)

def fail_once(batches):
    for rows in batches:
        yield rows
    if TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")

rows = spark.range(0, 30, 1, 3).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit("x").cast("binary").alias("content"))
rows.mapInPandas(fail_once, "name string, content binary").write.format("committed_files").mode("append").save(sys.argv[1])
"""


def test_a_task_that_fails_once_leaves_one_copy(tmp_path):
    subprocess.run([sys.executable, "-c", RETRY, str(tmp_path / "out")], check=True, timeout=240, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True)
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"f{k}" for k in range(30))
