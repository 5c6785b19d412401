"""No language is left out, however many there are."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from framelight.llm import langid, quality, toxicity
from tests.llm.test_llm import docs


def letters(k):
    return chr(0x4E00 + 2 * k) + chr(0x4E01 + 2 * k)


def test_references_and_models_of_every_language(spark):
    rows = [(100 * k + i, " ".join(random.Random(i).choice(letters(k)) * 3 for _ in range(8)), f"l{k:02}", "a") for k in range(70) for i in range(4)]
    table = docs(spark, rows)
    names = [f"l{k:02}" for k in range(70)]
    assert sorted(quality.references(table)) == names
    stats = langid.fit(table)
    model = langid.compile_model(stats)
    assert model.languages == names
    text = np.frombuffer((letters(69) * 4).encode(), dtype=np.uint8)
    assert langid.code_lengths(model, text, np.array([0, len(text)]))[0].argmin() == 69


def test_common_words_are_not_capped(spark):
    table = docs(spark, [(1, " ".join(f"w{i}" for i in range(100)) + " w1", "en", "a")])
    assert len(quality.references(table)["en"]["keys"]) == 100


def test_long_and_null_texts_do_not_thin_a_language(spark):
    rows = [(i, None if i % 2 else "x" * 30, "en", "a") for i in range(4000)] + [(10_000 + i, "good text", "en", "a") for i in range(20)]
    table = docs(spark, rows)
    sample = langid.training_sample(table, "doc_id", "text", "lang", 5, 20)
    assert [r["_text"] for r in sample.collect()] == ["good text"] * 5


def test_toxicity_guesses_every_language():
    texts = [f"{letters(k)} {letters(k)}" for k in range(40) for _ in range(4)]
    net = toxicity.train(pa.array(texts), np.array([0, 1] * 80, dtype=np.float32), np.array([f"l{k:02}" for k in range(40) for _ in range(4)]))
    assert net.languages.shape[1] == len(net.thresholds) == 40
    assert toxicity.guess_language(net, *toxicity.text_words(pa.array([letters(39)]))).tolist() == [39]
