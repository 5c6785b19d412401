"""Typed mentions: terms of a gazetteer found in texts with their labels and offsets.

Runs of one to as many words as the longest term has, joined by single blanks,
meet the gazetteer by an equality join, which Spark broadcasts only while the
gazetteer is small enough for it; of overlapping hits the leftmost longest stay.
Words are runs of ASCII letters, digits and hyphens; case doesn't matter; offsets
count code points.

Defined results: null and empty texts have no mentions; a term listed with
several labels has the least of them, null labels count only if there is no other;
an empty gazetteer finds nothing; rows of one key and text give their mentions once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelight.operators.verify import SENTENCE_END, geo_guard

# Labels that make statements, labels of places, and the units of values.
STATED_LABELS = ("org", "gpe", "loc", "work_of_art", "event", "date")
PLACE_LABELS = ("gpe", "loc")
VALUE = r"(?i)\d+\.?\d*\s*(?:%|million|billion|thousand|tonnes|kg|km|years?|days?)|\b\d+\b"
WORD = re.compile(r"[A-Za-z0-9-]+")


#: Runs of words that leave a task in one batch.
BATCH = 50_000


def _runs_of_words(keys: Sequence[str], longest: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            rows, starts, ends, said = zip(*found, strict=True)
            own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
            return pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(said, pa.string())], names=[*keys, "start", "end", "mention"])

        for batch in batches:
            found: list[tuple] = []
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                spans = [m.span() for m in WORD.finditer(text)]
                for i, (start, end) in enumerate(spans):
                    for j in range(i, min(i + longest, len(spans))):
                        if j > i and text[end : spans[j][0]] != " ":
                            break
                        end = spans[j][1]
                        found.append((row, start, end, text[start:end]))
                    if len(found) >= BATCH:
                        yield packed(batch, found)
                        found = []
            if found:
                yield packed(batch, found)

    return find


def _leftmost(keys: Sequence[str]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free = None, 0
        for batch in batches:
            stays = []
            for *own, start, end in zip(*(batch.column(c).to_pylist() for c in (*keys, "start", "end")), strict=True):
                if own != key:
                    key, free = own, 0
                stays.append(start >= free)
                free = end if start >= free else free
            yield batch.filter(pa.array(stays, pa.bool_()))

    return keep


def find_mentions(texts: DataFrame, gazetteer: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """``keys``, start, end, mention, label for (term, label) rows of the gazetteer in the column ``text``."""
    key = F.lower(F.trim(F.regexp_replace("term", r"\s+", " ")))
    terms = gazetteer.select(key.alias("key"), "label").filter("key <> ''").groupBy("key").agg(F.min("label").alias("label"))
    longest = terms.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 1  # one number
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    runs = texts.filter("text <> ''").select(*keys, "text").mapInArrow(_runs_of_words(keys, longest), f"{kinds}, start int, end int, mention string")
    hits = runs.withColumn("key", F.lower("mention")).join(terms, "key").select(*keys, "start", "end", "mention", "label")
    in_order = hits.repartition(*keys).sortWithinPartitions(*keys, "start", F.desc("end"))
    return in_order.mapInArrow(_leftmost(keys), hits.schema)


def _values():
    """Numbers with their units, their places, and the bounds of their sentences."""

    @F.pandas_udf("array<struct<at: int, value: string, low: int, high: int>>")
    def find(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            text, low, found = text or "", 0, []
            for high in [*(m.start() for m in re.finditer(SENTENCE_END, text)), len(text)]:
                found += [{"at": low + m.start(), "value": m[0], "low": low, "high": high} for m in re.finditer(VALUE, text[low:high])]
                low = high
            return found

        return texts.map(one)

    return find


def values_of_mentions(texts: DataFrame, mentions: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """``keys``, at, value, mention: every number with the nearest mention of its sentence, the earlier of two; none is given itself.

    Mentions don't overlap, so the nearest is the last that starts at or before
    the number or the first after it: two windows over a text, no pairs.
    """
    numbers = texts.select(*keys, F.explode(_values()("text")).alias("v")).select(*keys, F.col("v.at").alias("place"), F.col("v").alias("number"), F.lit(None).alias("near"))
    spans = mentions.select(*keys, F.col("start").alias("place"), F.lit(None).alias("number"), F.struct("start", "end", "mention").alias("near"))
    line = Window.partitionBy(*keys).orderBy("place", F.col("number").isNotNull())
    before = F.last("near", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("near", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    met = spans.unionByName(numbers).withColumns({"before": before, "after": after}).filter("number is not null")
    inside = lambda c: F.when((F.col(f"{c}.start") >= F.col("number.low")) & (F.col(f"{c}.end") <= F.col("number.high")), F.col(c))
    met = met.withColumn("before", inside("before")).withColumn("after", inside("after"))
    gap = lambda c: F.least(F.abs(F.col(f"{c}.start") - F.col("place")), F.abs(F.col(f"{c}.end") - F.col("place")))
    nearest = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after"))
    found = met.select(*keys, F.col("place").alias("at"), F.col("number.value").alias("value"), nearest["mention"].alias("mention"))
    return found.filter("mention is not null and lower(trim(mention)) <> lower(trim(value))")


def typed_triples(texts: DataFrame, gazetteer: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """``keys``, at, subject, verb, object: what each stated mention is, the first two related, and values of the nearest mentions.

    ``at`` is the place of the subject's mention, or of the number.
    """
    usable = texts.filter(~F.upper("text").contains("INSUFFICIENT DATA")).select(*keys, "text")
    mentions = find_mentions(usable, gazetteer, keys)
    stated = mentions.filter(F.lower("label").isin(*STATED_LABELS))
    line = Window.partitionBy(*keys).orderBy("start")
    numbered = stated.select(*keys, F.col("start").alias("at"), F.col("mention").alias("subject"), F.lower("label").alias("label"), F.row_number().over(line).alias("rn"), F.lead("mention").over(line).alias("other"))
    typed = numbered.select(*keys, "at", "subject", F.lit("is").alias("verb"), F.col("label").alias("object"))
    related = numbered.filter("rn = 1 and other is not null").select(*keys, "at", "subject", F.lit("related to").alias("verb"), F.col("other").alias("object"))
    valued = values_of_mentions(usable, mentions, keys).select(*keys, "at", F.col("mention").alias("subject"), F.lit("has value").alias("verb"), F.col("value").alias("object"))
    return typed.unionByName(related).unionByName(valued)


def guard_places(labelled: DataFrame, mentions: DataFrame) -> DataFrame:
    """``labelled`` pairs (run_id, pos, fact, label) after the guard of places, by mentions (run_id, pos) labelled as places."""
    named = mentions.filter(F.lower("label").isin(*PLACE_LABELS)).groupBy("run_id", "pos").agg(F.collect_set(F.lower("mention")).alias("_places"))
    met = labelled.join(named, ["run_id", "pos"], "left")
    return met.withColumn("label", geo_guard(F.coalesce("_places", F.array().cast("array<string>")))).drop("_places")
