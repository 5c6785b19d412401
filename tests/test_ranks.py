"""Quantiles by counted buckets equal those of sorted lists, to the last bit."""

import math

import numpy as np
import pytest

from framelight.functions import ranks
from framelight.operators import scores

SHARES = {"p0": 0.0, "p2": 0.02, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def plain(values, share):
    at = (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("seed", [0, 1])
def test_quantiles_equal_those_of_sorted_lists(spark, seed):
    rng, groups = np.random.default_rng(seed), {}
    groups["even"], groups["ties"], groups["same"], groups["one"] = rng.random(777), rng.integers(0, 4, 500) / 4, np.full(300, 0.1), np.array([-2.5])
    groups["signs"] = rng.normal(size=400) * 10.0 ** rng.integers(-12, 12, 400)
    groups["ends"] = np.array([0.0, -0.0, 5e-324, -5e-324, 1e-310, 1e308, -1e308, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 2.0])
    groups[None] = rng.random(51)
    rows = [(k, int(j), float(v)) for k, x in groups.items() for j, v in enumerate(x)] + [("even", 1, None), ("none", 1, None)]
    table = spark.createDataFrame(rows, "k string, j int, v double").repartition(5)
    found = {r["k"]: r for r in ranks.quantiles(table, ["k"], "v", SHARES).collect()}
    assert set(found) == set(groups)
    for k, x in groups.items():
        values = sorted(float(v) for v in x)
        assert found[k]["n"] == len(values)
        assert [found[k][s] for s in SHARES] == [plain(values, p) for p in SHARES.values()]


def test_rows_without_a_video_are_normalised_too(spark):
    rows = [(None if k % 5 == 0 else 1, k, float(k)) for k in range(21)]
    out = scores.robust_normalize(spark.createDataFrame(rows, "video_id long, frame_idx int, e double"), ["e"]).collect()
    assert len(out) == 21 and sorted(r["n_e"] for r in out if r["video_id"] is None) == [0.0, 0.25, 0.5, 0.75, 1.0]


def test_empty_tables_have_no_quantiles(spark):
    assert ranks.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", SHARES).count() == 0
