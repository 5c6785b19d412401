"""The router of the nearest-neighbour index is fitted in a task, in bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np

from framelight.llm import ann


def test_graph_keeps_no_block():
    unit = ann._unit(np.random.default_rng(1).normal(size=(4096, 8)))
    tracemalloc.start()
    graph = ann.neighbour_graph(unit, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # all similarities take 134 MB
    near = unit[1000] @ unit.T
    assert set(graph[1000]) == set(np.argsort(-near)[1:11])


def test_router_is_fitted_outside_the_driver(spark, monkeypatch):
    vectors = np.random.default_rng(2).normal(size=(300, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, vector array<double>")
    expected = ann.fit_sample(vectors, 4)
    monkeypatch.setattr(ann, "balanced_parts", None)
    net = ann.fit(table, 4)
    assert all(np.allclose(a, b) for a, b in zip(net, expected, strict=True))
    assert ann.fit(table.filter("false"), 4) is None
