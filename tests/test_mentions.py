"""Typed mentions against brute force and hand-made cases."""

import random
import re

import pytest

from framelight.operators import mentions

WORDS = re.compile(r"[A-Za-z0-9-]+")


def brute(text, terms):
    """Leftmost longest terms by trying every end at every word's start."""
    found, free = [], 0
    for m in WORDS.finditer(text):
        if m.start() < free:
            continue
        ends = [e.end() for e in WORDS.finditer(text) if e.end() > m.start() and text[m.start() : e.end()].lower() in terms]
        if ends:
            free = max(ends)
            found.append((m.start(), free, text[m.start() : free], terms[text[m.start() : free].lower()]))
    return found


def given(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def gazetteer(spark, terms):
    return spark.createDataFrame(list(terms), "term string, label string")


def found(df):
    out = {}
    for r in df.orderBy("id", "start").collect():
        out.setdefault(r["id"], []).append((r["start"], r["end"], r["mention"], r["label"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["new", "York", "city", "Hall", "of", "x-1", "é"])
    terms = {" ".join(word().lower() for _ in range(rng.randint(1, 4))): rng.choice("abc") for _ in range(12)}
    terms = {t: label for t, label in terms.items() if "é" not in t}
    texts = ["".join(word() + rng.choice([" ", " ", " ", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = found(mentions.find_mentions(given(spark, texts), gazetteer(spark, terms.items())))
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t, terms))}


def test_mentions_of_odd_rows(spark):
    terms = gazetteer(spark, [("New  York", "GPE"), ("new york", "LOC"), ("york", None), ("", "x"), (None, "x")])
    texts = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "in New York", 0), (3, "in New York", 0), (None, "York", 0), (5, "york " * 5000, 0)], "id long, text string, label int")
    rows = mentions.find_mentions(texts, terms).collect()
    assert sorted((r["id"] or 0, r["start"], r["mention"], r["label"]) for r in rows if r["id"] != 5) == [(0, 0, "York", None), (3, 3, "New York", "GPE")]
    assert sum(r["id"] == 5 for r in rows) == 5000
    assert mentions.find_mentions(texts, terms.limit(0)).count() == 0 and mentions.find_mentions(texts.limit(0), terms).count() == 0


def test_values_equal_all_pairs(spark):
    rng = random.Random(3)
    terms = {"acme": "org", "new york": "gpe", "7": "date"}
    texts = ["".join(rng.choice(["Acme", "New York", "ran", "7", "12 km", "3.5%", "far"]) + rng.choice([" ", " ", ". ", "? "]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    df = given(spark, texts)
    named = mentions.find_mentions(df, gazetteer(spark, terms.items()))
    got = sorted((r["id"], r["at"], r["value"], r["mention"]) for r in mentions.values_of_mentions(df, named).collect())
    want = []
    for i, text in enumerate(texts):
        cuts = [0, *(m.start() for m in re.finditer(mentions.SENTENCE_END, text)), len(text)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            inside = [m for m in brute(text, terms) if m[0] >= low and m[1] <= high]
            for number in re.finditer(mentions.VALUE, text[low:high]):
                at = low + number.start()
                if inside:
                    near = min(inside, key=lambda m: min(abs(m[0] - at), abs(m[1] - at)))[2]
                    if near.lower() != number[0].strip().lower():
                        want.append((i, at, number[0], near))
    assert got == sorted(want) and len(want) > 40


def test_typed_triples(spark):
    texts = given(spark, ["Acme opened in Paris 12 years ago. Sam left.", "Insufficient data on Acme.", None])
    terms = gazetteer(spark, [("acme", "ORG"), ("paris", "GPE"), ("sam", "PERSON")])
    got = [tuple(r)[1:] for r in mentions.typed_triples(texts, terms).orderBy("at", "verb").collect()]
    assert got == [(0, "Acme", "is", "org"), (0, "Acme", "related to", "Paris"), (15, "Paris", "is", "gpe"), (21, "Paris", "has value", "12 years")]


def test_guard_by_place_labels(spark):
    pairs = spark.createDataFrame([(1, 0, "It is in Paris", "It is in Rome", "entailment"), (1, 1, "Paris is big", "paris grew", "entailment"), (1, 2, "Sam left", "It left", "entailment"), (1, 3, "Paris", "Rome", "contradiction")], "run_id long, pos int, claim string, fact string, label string")
    claims = pairs.selectExpr("run_id", "pos", "claim as text")
    terms = gazetteer(spark, [("paris", "GPE"), ("sam", "PERSON")])
    named = mentions.find_mentions(claims, terms, ["run_id", "pos"])
    got = {r["pos"]: r["label"] for r in mentions.guard_places(pairs, named).collect()}
    assert got == {0: "neutral", 1: "entailment", 2: "entailment", 3: "contradiction"}
