"""Streams agree with batch over several ordered micro-batches."""

import datetime

from pyspark.sql import functions as F

from framelight.config import Config
from framelight.operators import cache, scores
from framelight.plans.evidence_queries import arrivals
from framelight.sources import tables
from framelight.streaming.frames import stream_evictions, stream_features, stream_ratios, stream_residuals
from tests.conftest import SF


def test_residual_stream(spark, tmp_path):
    events = tables.table(spark, SF, "events").select(F.col("user_id").alias("video_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    by_time = events.orderBy("ts").collect()
    for k in range(3):  # files in time order, one micro-batch each
        part = by_time[k * len(by_time) // 3 : (k + 1) * len(by_time) // 3]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_residuals(stream).writeStream.format("memory").queryName("residuals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    got = {r["event_id"]: round(r["residual_energy"], 9) for r in spark.table("residuals").collect()}
    expected = {r["event_id"]: round(r["residual_energy"], 9) for r in tables.frames(spark, SF).collect()}
    assert got == expected


def test_ratio_stream(spark, tmp_path):
    rows = tables.table(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", "SKIP").otherwise("PEAK").alias("tier"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = stream_ratios(stream).writeStream.format("memory").outputMode("complete").queryName("ratios").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert spark.table("ratios").agg(F.sum("total")).first()[0] == rows.count()


def test_eviction_stream_equals_the_batch_however_it_is_cut(spark, tmp_path):
    rows = arrivals(spark, SF).select("video_id", F.col("arrival").cast("long").alias("arrival"), "frame_idx", *cache.SIGNALS).cache()
    expected = sorted(map(tuple, cache.evictions(rows, Config(), 8).collect()))
    assert expected
    last = rows.agg(F.max("arrival")).first()[0] + 1
    for cuts in ([0, last // 3, last // 2, last], [0, 9, last]):
        folder = tmp_path / str(len(cuts))
        for low, high in zip(cuts, cuts[1:]):
            rows.filter(f"arrival >= {low} and arrival < {high}").coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        name = f"evictions_{len(cuts)}"
        run = stream_evictions(stream, 8).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
        run.awaitTermination(300)
        assert sorted(map(tuple, spark.table(name).collect())) == expected


def test_feature_stream_puts_late_frames_in_order(spark, tmp_path):
    """Frames up to half an hour out of order, in two ways of cutting the stream, give the batch means; a frame that is later is dropped."""
    times = tables.table(spark, SF, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = tables.frames(spark, SF).join(times, "event_id").select("video_id", "frame_idx", "ts", "residual_energy", F.when(F.col("frame_idx") % 5 > 0, F.col("motion_magnitude")).alias("motion_magnitude"), "entropy").cache()
    expected = {tuple(r[:3]): [v if v is None else round(v, 9) for v in r[3:]] for r in scores.rolling_features(rows, 7).collect()}
    jumbled = rows.orderBy(F.unix_micros("ts") + F.pmod(F.xxhash64("video_id", "frame_idx"), F.lit(1800)) * 1000000).collect()
    end = max(r["ts"] for r in jumbled)
    day = datetime.timedelta(days=1)
    tail = [(-1, 0, end + day, 0.0, 0.0, 0.0)], [(-1, 1, end + 2 * day, 0.0, 0.0, 0.0), (jumbled[0]["video_id"], 999, end - day, 9.0, 9.0, 9.0)], [(-1, 2, end + 3 * day, 0.0, 0.0, 0.0)]
    for parts in (2, 5):
        folder = tmp_path / str(parts)
        for rows_of_part in (*(jumbled[k * len(jumbled) // parts : (k + 1) * len(jumbled) // parts] for k in range(parts)), *tail):
            spark.createDataFrame(rows_of_part, rows.schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        name = f"features_{parts}"
        run = stream_features(stream, "1 hour", 7).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
        run.awaitTermination(300)
        got = {tuple(r[:3]): [v if v is None else round(v, 9) for v in r[3:]] for r in spark.table(name).filter("video_id >= 0").collect()}
        assert got == expected
