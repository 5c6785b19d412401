"""Models are learned from every training row, whole."""

from __future__ import annotations

import random
import zlib

from framelight.llm import toxicity

CALM, BAD = [f"calm{k}" for k in range(60)], ["vile", "awful", "hateful"]


def marked_rows(n, words):
    rng, docs, marks = random.Random(1), [], []
    for i in range(n):
        said = [rng.choice(CALM) for _ in range(words(i))]
        if i % 3 == 0:
            said[rng.randrange(len(said))] = rng.choice(BAD)
        docs.append((i, " ".join(said), "en"))
        marks.append((i, int(i % 3 == 0)))
    return docs, marks


def held_right(spark, docs, marks):
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    held = [(r["predicted"], marks[r["doc_id"]][1]) for r in toxicity.assess(table, labels).collect() if r["held_out"]]
    return sum(a == b for a, b in held) / len(held)


def test_toxicity_learns_from_long_texts(spark):
    # every toxic text is longer than the 40,000 code points at which training once stopped
    docs, marks = marked_rows(240, lambda i: 7000 if i % 3 == 0 else 300)
    docs = [(i, " ".join(["calm1"] * (0 if m else 1)) + t, lang) for (i, t, lang), (_, m) in zip(docs, marks, strict=True)]
    assert min(len(t) for (_, t, _), (_, m) in zip(docs, marks, strict=True) if m) > toxicity.LONGEST_SAMPLED
    assert held_right(spark, docs, marks) >= 0.9


def test_toxicity_learns_from_every_part(spark, monkeypatch):
    docs, marks = marked_rows(900, lambda i: 30)
    read = spark.sparkContext.accumulator(0)
    learn = toxicity.Trainer.learn

    def counted(self, texts, labels):
        read.add(len(labels))
        learn(self, texts, labels)

    monkeypatch.setattr(toxicity, "PART_BYTES", 20_000)  # seven parts
    monkeypatch.setattr(toxicity.Trainer, "learn", counted)
    assert held_right(spark, docs, marks) >= 0.95


def test_toxicity_moves_no_text_without_a_label(spark, tmp_path):
    docs = [(i, "some words", "en") for i in range(4000)]
    marks = [(i, i % 2) for i in range(0, 4000, 20)]
    path, table = str(tmp_path / "docs"), spark.createDataFrame(docs, "doc_id long, text string, lang string")
    table.write.parquet(path)
    learned = toxicity.learned_rows(spark.read.parquet(path), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert learned.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in marks)
    plan = learned._jdf.queryExecution().executedPlan()
    learned.collect()  # the final plan has its metrics
    nodes, sent = [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan], []
    while nodes:
        node = nodes.pop()
        if "ShuffleQueryStage" in node.nodeName() and "text" in node.output().mkString(" "):
            sent.append(node.plan().metrics().apply("shuffleRecordsWritten").value())
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert sent and max(sent) < 400, sent  # 200 labels; before, all 3,200 texts outside the held-out fold, or a broadcast of the labels


def test_weights_are_fitted_on_every_training_document(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from framelight.llm import context_mixing as cm

    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(CALM) for _ in range(9000 if i % 50 == 0 else 20))) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    kept = [t for i, t in docs if zlib.crc32(str(i).encode()) % cm.FOLDS != cm.HELD_OUT]
    assert len(kept) > 500 and max(map(len, kept)) > 40_000  # fitting once stopped at 400 documents of 40,000 characters
    given = {}
    settle = cm.settled
    monkeypatch.setattr(cm, "settled", lambda model, n, ones: given.update(n=n, ones=ones) or settle(model, n, ones))
    model, _ = cm.fit(table)
    s = cm.read(pa.array(kept))
    *_, bits, _ = cm.decisions(cm.pairs_of(s), np.arange(len(s.data)), model[1:4])
    assert (given["n"].sum(), given["ones"].sum()) == (len(bits), bits.sum())
