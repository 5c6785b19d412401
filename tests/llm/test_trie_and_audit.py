"""Prefix trie and filter audit against brute force, with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from framelight.llm import filter_audit, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def remainder(a: int, b: int) -> int:
    return a - b * int(a / b)


def brute_trie(rows):
    """Every node by its whole path."""
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in found.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - remainder(c, 100), [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def conversations(seed: int):
    rng, rows = random.Random(seed), []
    for conv in [*range(-3, 12), *range(98, 106), 200, 205, 301, 999, -150]:
        if conv == 200 and seed % 2:
            continue  # a family without its base
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["é", "ab", "", "long words here"])))
    # equal turns are ordered by a checksum, so only equal rows share one here
    rows += [(7, None, None, None), (7, None, "", ""), (None, 3, "user", "lost"), (4, 50, "user", "tie"), (4, 50, "user", "tie")]
    rows += [(500 + k, 0, "system", "same first turn") for k in range(40)] + [(500 + k, 1, "user", f"own {k % 3}") for k in range(40)]
    rows += [(c, t, "user", f"t{t}") for c in (600, 601, 702) for t in range(30 - c % 7)]
    return rows


@pytest.mark.parametrize("seed, segment", [(1, 1024), (2, 5), (3, 6), (4, 7)])
def test_trie_equals_brute_force_at_any_segment_size(spark, seed, segment):
    table = spark.createDataFrame(conversations(seed), TURNS).repartition(5).withColumn("y", F.lit("clash")).withColumn("base", F.lit(1))
    assert as_rows(prefix_trie.prefix_trie(table, segment)) == brute_trie(conversations(seed))


def test_short_segments_are_refused(spark):
    with pytest.raises(ValueError, match="5 turns"):
        prefix_trie.prefix_trie(spark.createDataFrame([], TURNS), 4)


def test_trie_of_nothing_and_of_null_ids(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


def test_equal_turns_are_ordered_the_same_in_any_layout(spark):
    rows = [(c, 0, "user", f"text {k}") for c in (1, 2, 3) for k in range(20)]
    found = [as_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(n), 5)) for n in (1, 6)]
    assert found[0] == found[1]


def test_many_ends_at_one_node(spark):
    n = 3 * prefix_trie.IDS_IN_PIECE + 5
    table = spark.range(0, n, 1, 7).select((F.col("id") * 100).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    node = next(r for r in prefix_trie.prefix_trie(table).collect() if r["depth"] == 1)
    assert node["ends_sha256"] == hashlib.sha256(",".join(str(100 * k) for k in range(n)).encode()).hexdigest() and node["n_convs"] == n


def brute_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in range(2))
    rows = []
    for doc_id, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [i for i, other, _ in docs if (other or "") == t and i is not None]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and min(same) < doc_id,
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, removed_in = [], collections.Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                x, before = order[step - 1], set(order[: step - 1])
                mine = [r for r in rows if r[0] == part]
                here = [r for r in mine if not r[1] & before and x in r[1]]
                removed_in[part, x] += len(here)
                out.append([part, order, step, sum(not r[1] & (before | {x}) for r in mine), len(here), sum(bool(r[1] & before) and x in r[1] for r in mine), sum(r[1] == {x} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)])
    return sorted((*r, removed_in[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark):
    rng, docs = random.Random(3), []
    texts = [None, "", " \n", "Ab cd", "x " * 300, "é" * 700, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(199)), " ".join(f"W{k}" for k in range(230)), "a|b " + " ".join(f"w{k}" for k in range(240)), "word " * 20000]
    for k in range(150):
        own = " ".join(rng.choice(["alpha", "Beta", "g$", "delta", f"n{rng.randrange(400)}"]) for _ in range(rng.choice([3, 150, 220, 400])))
        docs.append((rng.choice([k, k, 7, None]), rng.choice([*texts, own, own, own]), rng.choice(["aa", "bb", "", None])))
    docs += docs[:10]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(6).withColumn("fails", F.lit(3)).withColumn("id", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    found = sorted(tuple(r[c] for c in AUDIT) for r in filter_audit.filter_interactions(table, marks).collect())
    assert found == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(none, marks).count() == 0
    one = filter_audit.filter_interactions(spark.createDataFrame([(1, None, None)], none.schema), marks).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and all(r["good_lost"] == 0 for r in one)


def test_blocks_hold_each_part_once_and_sum_up(spark):
    rows = spark.range(0, 25000, 1, 3).select(F.concat(F.lit("p"), (F.col("id") % 70).cast("string")).alias("part"), (F.col("id") % 32).cast("int").alias("fails"), (F.col("id") % 4).cast("int").alias("marks"))
    blocks = filter_audit.index(rows)
    assert all(len(set(r["parts"])) == len(r["parts"]) for r in blocks.select("parts").collect())
    counts = {(r["part"], r["subset"]): r["kept"] for r in filter_audit.subset_counts(blocks).collect()}
    plain = collections.Counter((f"p{k % 70}", s) for k in range(25000) for s in range(32) if not k % 32 & s)
    assert {k: v for k, v in counts.items() if v} == dict(plain)
