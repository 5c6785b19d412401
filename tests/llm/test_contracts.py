"""Ids with several texts, null ids, clashing column names, languages without a label, and plain versions of learned scores."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelight.llm import ann, jaccard_join, line_dedup, mixing, quality, queries, token_counts, toxicity
from tests.conftest import SF
from tests.llm.test_llm import AWKWARD, WORDS, docs

LONG = [" ".join(f"{w}{k}" for w in WORDS) for k in range(3)]
A, B = LONG[0], LONG[1]


def test_one_id_joins_the_classes_of_all_its_texts(spark):
    table = spark.createDataFrame([(1, A), (5, A), (5, B), (9, B), (7, LONG[2]), (None, A)], "doc_id long, text string")
    out = jaccard_join.near_duplicates(table, 4, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out if r["doc_id"]) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]
    kept = jaccard_join.keep_one(table, 4, 85).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, A), (5, B), (7, LONG[2]), (0, A)])


#: Names that the operators use inside.
INSIDE = ["row", "id", "key", "turn", "touched", "removed", "lines", "place", "label", "part", "at", "before", "maybe", "n", "copy", "rate", "target", "size", "rated", "_key", "_touched", "_removed", "_mix_copy", "_mix_rate", "_first", "n_removed"]


def test_inner_names_come_back_equal(spark):
    rows = [(i, f"{LONG[i % 3]}\n{LONG[i % 2]}\nown line number {i} here", "s") for i in range(6)] * 2
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INSIDE})
    for op in (line_dedup.dedup_lines, mixing.emit, lambda d: jaccard_join.keep_one(d, 5, 80)):
        out = op(table)
        assert out.columns == table.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in INSIDE)
    counted = line_dedup.dedup_lines(table.withColumn("n_lines", F.lit("x")), counts=True)
    assert all(r["n_lines"] == 3 and r["key"] == f"key{r['doc_id']}" for r in counted.collect())


@pytest.mark.parametrize("ids, text", [("null", "distinct"), ("null", "equal"), ("same", "distinct"), ("same", "equal")])
def test_mixes_come_near_targets_whatever_the_ids(spark, ids, text):
    rows = spark.range(0, 6000, 1, 5).select(
        (F.lit(None).cast("long") if ids == "null" else F.lit(3).cast("long")).alias("doc_id"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"),
        (F.concat(F.lit("four words with "), F.col("id").cast("string")) if text == "distinct" else F.lit("these are four words")).alias("text"),
    )
    for r in mixing.mix(rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.05)
    again = [sorted(map(str, mixing.emit(rows).groupBy("source", "text").count().collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_turns_number_copies(spark):
    rows = spark.range(0, 90, 1, 4).select((F.col("id") % 3).alias("id"), F.lit("t").alias("text")).union(spark.createDataFrame([(None, "t"), (7, "u")], "id long, text string"))
    found = collections.defaultdict(list)
    for r in mixing.with_turns(rows).collect():
        found[r["id"]].append(r["turn"])
    assert {i: sorted(x) for i, x in found.items()} == {0: [*range(1, 31)], 1: [*range(1, 31)], 2: [*range(1, 31)], None: [1], 7: [1]}


def test_token_counts_equal_an_encoder(spark):
    import base64

    import tiktoken

    path = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoder = tiktoken.Encoding("check", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = {r["doc_id"]: len(encoder.encode_ordinary(r["text"] or "")) for r in texts}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op7_token_counts(spark, SF).collect()} == expected


def plain_js(p, q):
    keys = set(p) | set(q)
    kl = lambda a, m: sum(a[k] * math.log2(a[k] / m[k]) for k in a if a[k])
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in keys}
    return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def character_class(c):
    if len(c.encode()) > 1:
        return 7
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:!?'\"()-", "#*$%&|<>"]
    return next((k for k, members in enumerate(kinds) if c in members), 6)


def shares(counts):
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()} if total else {}


def test_divergence_equals_plain_version(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    lowered = lambda t: re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    refs = {}
    for lang in {r["lang"] for r in table if r["lang"]}:
        own = [r["text"] for r in table if r["lang"] == lang]
        counted = collections.Counter(w for t in own for w in lowered(t))
        often = {w for w, n in counted.items() if n >= quality.COMMON * counted.total()}
        words = shares({**{w: counted[w] for w in often}, None: counted.total() - sum(counted[w] for w in often)})
        refs[lang] = often, words, shares(collections.Counter(character_class(c) for t in own for c in t or ""))
    out = {r["doc_id"]: r for r in queries.op5_quality(spark, SF).collect()}
    for r in table:
        words, text = lowered(r["text"]), r["text"] or ""
        by_class, by_word, best = len(text) >= quality.MIN_CHARS, len(words) >= quality.MIN_WORDS, math.inf
        for often, share, classes in refs.values():
            d_class = plain_js(shares(collections.Counter(map(character_class, text))), classes) if by_class else 0
            d_word = plain_js(shares(collections.Counter(w if w in often else None for w in words)), share) if by_word else 0
            best = min(best, (d_class + d_word) / max(by_class + by_word, 1))
        assert out[r["doc_id"]]["divergence"] == pytest.approx(best, abs=1e-6)
        assert out[r["doc_id"]]["kept"] == (not out[r["doc_id"]]["base_failed"] and best <= quality.MAX_DIVERGENCE)


def plain_logit(net, text):
    """The forward pass word by word."""
    column = pa.array([text])
    hashes, _ = toxicity.text_words(column)
    vectors = [sum(net.embedding[b] for b in row) for row in toxicity.buckets(hashes)]
    pooled = []
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            acts = [net.bias[k * toxicity.FILTERS + f] + sum(float(vectors[i + j] @ net.filters[k][j][:, f]) for j in range(width)) for i in range(len(vectors) - width + 1)]
            pooled.append(max([0.0, *acts]))
    return float(np.dot(pooled, net.weights) + net.offset)


def toxic_rows(n, languages=("en",)):
    rng, rows, marks = random.Random(5), [], []
    for i in range(n):
        words = [rng.choice(WORDS) + languages[i % len(languages)] + rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "nasty"])
        rows.append((" ".join(words), languages[i % len(languages)]))
        marks.append(int(i % 3 == 0))
    return rows, marks


def test_forward_pass_equals_plain_version():
    rows, marks = toxic_rows(300)
    texts = [t for t, _ in rows]
    net = toxicity.train(pa.array(texts), np.array(marks, dtype=np.float32), np.array(["en"] * len(rows)))
    some = [*texts[:20], "", "one", "two words", "vile " * 3000]
    got = toxicity.logits(net, *toxicity.text_words(pa.array(some)))
    assert got == pytest.approx([plain_logit(net, t) for t in some], abs=1e-3)
    assert (toxicity.scores(net, pa.array(["", "  12 ", None])) < 0.5).all()


def test_a_language_without_a_label_takes_the_pooled_cut():
    rows, marks = toxic_rows(600, ("en", "de"))
    marks = [0 if lang == "de" else m for (_, lang), m in zip(rows, marks, strict=True)]
    net = toxicity.train(pa.array([t for t, _ in rows]), np.array(marks, dtype=np.float32), np.array([lang for _, lang in rows]))
    assert len(net.thresholds) == 2 and net.thresholds[0] != 0.0  # names in order: de, en


def test_long_ids_are_learned_from(spark):
    rows, marks = toxic_rows(600)
    name = lambda i: f"{i:04d}" + "x" * 90
    table = spark.createDataFrame([(name(i), t, lang) for i, (t, lang) in enumerate(rows)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(name(i), m) for i, m in enumerate(marks)], "doc_id string, toxic int")
    out = toxicity.assess(table, labels).collect()
    held = [(r["predicted"], marks[int(r["doc_id"][:4])]) for r in out if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_registered_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()}
    out = queries.op9_toxicity(spark, sf).collect()
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in toxic]
    right = sum(a == b for a, b in held) / len(held)
    recall = sum(a for a, b in held if b) / max(1, sum(b for _, b in held))
    print(f"held out: {len(held)} rows, accuracy {right:.3f}, recall {recall:.3f}")
    # measured: 0.973 and 0.825; calling nothing toxic would be right for 0.88 of the rows
    assert right >= 0.95 and recall >= 0.75


def test_queries_with_few_candidates_visit_every_part(spark, monkeypatch):
    """A router that sends queries to one part alone still finds k neighbours."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] + rng.normal(0, 0.01, 8)]) for i in range(40)]
    monkeypatch.setattr(ann, "fit", lambda vectors, parts: [np.eye(8) * 60, np.zeros(8), np.eye(8, parts), np.zeros(parts)])
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=20, cover=0.5).collect()
    assert collections.Counter(r["query_id"] for r in out) == {0: 20, 10: 20, 20: 20, 30: 20}


def test_awkward_rows_keep_their_number(spark):
    table = docs(spark, AWKWARD)
    assert mixing.mix(table).count() == len(AWKWARD)
    assert line_dedup.dedup_lines(table).count() == len(AWKWARD)
