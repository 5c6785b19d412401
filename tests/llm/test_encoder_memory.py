"""The encoder's memory, and what leaves its tasks."""

from __future__ import annotations

import tracemalloc

from framelight.llm import bpe, queries

PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"


def test_words_are_held_once():
    """A group's memory goes with its distinct words, not with every word of its texts."""
    encoder = bpe.Encoder(PATH)
    texts = [" ".join(f"word{k % 50}" for k in range(i, i + 1000)) for i in range(300)]
    expected = encoder.encode_batch(texts)
    tracemalloc.start()
    encoded = encoder.encode_lists(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # the strings of the 600,000 pieces of words alone take more than 30 MB
    assert encoded.to_pylist() == expected


def test_starts_anew_past_its_words(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_CACHE", 3)
    forgetful, texts = bpe.Encoder(PATH), ["one two", "two three <|endoftext|>", "", "four five six", "one ONE"]
    assert [i for t in texts for i in forgetful.encode_batch([t])] == bpe.Encoder(PATH).encode_batch(texts)


def test_texts_stay_in_encoding_tasks(spark):
    table = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    out = bpe.encode(table, PATH, keep_text=False)
    assert out.columns == ["doc_id", "ids"]
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {1: bpe.Encoder(PATH).encode_batch(["one two"])[0], 2: []}
