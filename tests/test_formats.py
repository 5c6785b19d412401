"""Numbers in texts are rounded as C's printf rounds them."""

import duckdb
from pyspark.sql import functions as F

from framelight.functions.formats import fixed
from framelight.operators import cache

#: Halves that are exact, and decimals whose binary value lies below or above a half.
TIES = [0.125, 0.375, 0.25, 0.75, 1.005, 2.675, 0.05, 0.15, 0.35, 12.345, 1234567.125, 0.0, -0.125, 3.0, 99.995]


def test_fixed_equals_printf(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*TIES, None])], "k int, x double")
    for digits in (1, 2, 4):
        got = [r[0] for r in rows.orderBy("k").select(fixed(F.col("x"), digits)).collect()]
        assert got == [duckdb.sql(f"SELECT printf('%.{digits}f', {x}::DOUBLE)").fetchall()[0][0] for x in TIES] + [None]


def test_facts_and_blocks_round_halves_to_even(spark):
    rows = spark.createDataFrame([(7, 0.125, 0.125, 0.375, "a dog", False)], "frame_idx int, timestamp_sec double, action_score double, persistence_value double, caption string, is_peak boolean")
    c = F.col
    fact, salient, block = rows.select(
        cache.nli_fact(c("frame_idx"), c("timestamp_sec"), c("caption")),
        cache.salient_fact(c("frame_idx"), c("timestamp_sec"), c("action_score"), c("persistence_value")),
        cache.display_text(),
    ).collect()[0]
    assert fact == "Frame 7 at 0.12s: a dog."
    assert salient == "Frame 7 at 0.12s depicts salient visual cues (residual energy 0.1250, action score 0.3750)"
    assert block == "Frame 7\nTimestamp: 0.1s\n\nCaption:\na dog\n\nAction Score:\n0.12\n\nPersistence:\n0.38"
