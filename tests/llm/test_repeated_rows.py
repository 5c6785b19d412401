"""Operators over tables whose rows are repeated."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from framelight.llm import ann, line_dedup
from tests.llm.test_llm import brute_lines


def test_line_dedup_repeated_rows_equal_brute_force(spark):
    rng, rows, table = random.Random(3), [], []
    for i in range(300):
        words = [f"w{i}x{j}" for j in range(20)]
        near = words[2:] + [f"v{i}x{j}" for j in range(2)]
        rng.shuffle(near)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
        table += [rows[-2]] * (1 + i % 2) + [rows[-1]] * (1 + i // 2 % 3)
    want = brute_lines(rows)
    assert all(not want[2 * i + 1] for i in range(300))
    out = line_dedup.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted((i, want[i]) for i, _ in table)


def test_line_dedup_joins_texts_once(spark):
    # texts that lose lines and those that the bit set lets through in vain went through a join each
    table = spark.createDataFrame([(1, "one two three\nfour five"), (2, "Three two one\nsix"), (3, None)], "doc_id long, text string")
    out = line_dedup.dedup_lines(table, counts=True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(map(tuple, out.collect())) == [(1, "one two three\nfour five", 2, 0), (2, "six", 2, 1), (3, None, 0, 0)]


def test_line_dedup_sorts_and_compares_cheaply(spark, monkeypatch):
    # ranks that could be null by type were sorted as objects; every mention of the intersection worked it out anew
    plans, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, **how: plans.setdefault(name, df) is None or write(df, name, **how))
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 20))) for i in range(6)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(rows)
    assert not plans["line-firsts"].schema["prefix"].dataType.containsNull
    assert plans["similar-lines"]._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1


def test_nearest_repeated_rows(spark):
    same = [(1, [1.0, 2.0])] * 9 + [(i, [1.0, 2.0]) for i in range(2, 7)]
    table = spark.createDataFrame([(0, [1.0, 2.1]), *same], "vec_id long, embedding array<double>")
    out = ann.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in out] == [(i, i) for i in range(1, 6)]


def test_nearest_ids_with_several_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(0, rng.normal(size=4).tolist())]
    near = [(1, (np.array(rows[0][1]) + rng.normal(0, 0.01, 4)).tolist()) for _ in range(8)]
    rows += near * 3 + [(i, rng.normal(size=4).tolist()) for i in range(2, 40)]
    best = {}
    for i, v in rows[1:]:
        s = np.dot(v, rows[0][1]) / np.linalg.norm(v) / np.linalg.norm(rows[0][1])
        best[i] = max(best.get(i, -2), s)
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, cover=1.0).orderBy("rank").collect()
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r["vec_id"], round(r["score"], 9)) for r in out] == [(i, round(s, 9)) for i, s in want]
