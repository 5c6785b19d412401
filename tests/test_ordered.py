"""Rows of a video stay together whatever the plan beneath does."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.functions.ordered import over_videos


def test_a_union_of_joins_that_become_broadcasts_keeps_videos_whole(spark):
    rows = spark.range(4000).select((F.col("id") % 400).alias("video_id"), F.floor(F.col("id") / 400).cast("int").alias("frame_idx"))

    def part(odd):  # grouped by another key, so that the join has to deal rows anew
        return rows.filter(F.col("frame_idx") % 2 == odd).groupBy("video_id", "frame_idx").agg(F.count("*").alias("n"))

    # a small table whose size the planner can't tell, as it comes out of tasks
    few = rows.groupBy("video_id").applyInArrow(lambda t: t.slice(0, 1).select(["video_id"]), "video_id long").distinct()
    union = part(0).union(part(1)).join(few, "video_id", "left_semi")
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        found = over_videos(union, ["frame_idx"], [T.StructField("size", T.LongType())], lambda at: [np.full(len(at), len(at))])
        assert found.groupBy("size").count().collect() == [(10, 4000)]
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
