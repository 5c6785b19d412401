"""Interaction of filters in every order, from packed bitmaps.

Each block of rows keeps one bit a row for each filter it fails, each label it
bears and each part it belongs to, packed into 64-bit words. What is left after
a set of filters is an AND-NOT of bitmaps and its size a popcount; the 32
prefix sets of five filters answer all 120 orders, so nothing is counted twice.
Blocks are counted where they lie and only their counts are summed.

Filters fail a text (null: empty) as follows. A: under 200 words. B: under half
of its words are distinct. C: over 3 % of its code points are A-Z. D: it holds
one of ``#$%&*|``. E: a row with a smaller id has the same text.

Defined results: null ids neither fail E nor make others fail it, and bear no
label; rows with one id and one text don't fail E by each other; every repeated
row counts; an id with several labels bears each; labels without a document
count nowhere; a null part is the empty string and one with it; an empty table
gives an empty result. Columns beyond those used are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.llm import text as tx
from framelight.llm.storage import materialize

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: By the size of a set: how many orders put exactly its filters before a given other one.
ORDERS_WITH_PREFIX = [math.factorial(k) * math.factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))] + [0]

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#$%&*|", np.uint8)] = True
_POINT = (np.arange(256) & 0xC0) != 0x80


def _per_row(flags: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(flags[data], out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


def failures(texts: pa.Array) -> np.ndarray:
    """A bit mask of the filters A to D that each text fails."""
    data, offsets, _ = tx.buffers(texts)
    hashes, begins = tx.words(data, offsets)
    n = np.diff(begins)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=len(n))
    points = _per_row(_POINT, data, offsets)
    tests = (n < 200, 100 * distinct < 50 * n, 100 * _per_row(_CAPITAL, data, offsets) > 3 * points, _per_row(_SYMBOL, data, offsets) > 0)
    return sum(t.astype(np.int32) << k for k, t in enumerate(tests))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.slices(whole, 2):
            texts = batch.column(2)
            digest = b"".join(hashlib.blake2b(t.as_buffer() or b"", digest_size=16).digest() for t in texts)
            pair = np.frombuffer(digest, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(failures(texts)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["id", "part", "fails", "t1", "t2"])


def flag(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, marks) of every row: bit masks of the filters failed and of the labels quality and toxic.

    Texts are read once and go on as checksums. Only texts that occur again
    make a table to join with, so a text that a third of the rows share meets
    one row there, and such a join may be split wherever it is uneven.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(slim.mapInArrow(_survey, f"id {kind}, part string, fails int, t1 long, t2 long"), "audit-rows")
    again = rows.groupBy("t1", "t2").agg(F.min("id").alias("first_id"), F.count("id").alias("n")).filter("n > 1").drop("n")
    bears = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg((bears("quality") + 2 * bears("toxic")).alias("marks")).filter("id is not null and marks > 0")
    found = rows.join(materialize(again, "audit-texts"), ["t1", "t2"], "left").join(materialize(marks, "audit-marks"), "id", "left")
    repeated = F.coalesce((F.col("id") > F.col("first_id")).cast("int"), F.lit(0))
    return found.select("part", (F.col("fails") + 16 * repeated).alias("fails"), F.coalesce("marks", F.lit(0)).alias("marks"))


def pack(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, the last one filled with zeros."""
    words = np.zeros(-(-len(bits) // 64) * 8, dtype=np.uint8)
    packed = np.packbits(bits, bitorder="little")
    words[: len(packed)] = packed
    return words.view(np.uint64)


def index(flagged: DataFrame) -> DataFrame:
    """The bitmap index of (part, fails, marks): a row a block, with its part names and its bitmaps of filters, labels and parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes, fails, marks = coded.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            columns = (
                [pack(fails >> k & 1 != 0).tobytes() for k in range(len(FILTERS))],
                [pack(marks >> k & 1 != 0).tobytes() for k in range(2)],
                coded.dictionary.to_pylist(),
                [pack(codes == k).tobytes() for k in range(len(coded.dictionary))],
            )
            yield pa.RecordBatch.from_arrays([pa.array([c], type=t) for c, t in zip(columns, _INDEX.values(), strict=True)], names=list(_INDEX))

    return flagged.mapInArrow(run, "filters array<binary>, labels array<binary>, parts array<string>, part_bits array<binary>")


_INDEX = {"filters": pa.list_(pa.binary()), "labels": pa.list_(pa.binary()), "parts": pa.list_(pa.string()), "part_bits": pa.list_(pa.binary())}


def count_block(filters: list[np.ndarray], labels: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """For each set of filters: rows of the part that pass them all; then for each filter, rows of those that fail it, and how many of these bear each label."""
    out = np.zeros((SUBSETS, 1 + 3 * len(FILTERS)), dtype=np.int64)
    left = [part]
    for subset in range(SUBSETS):
        if subset:
            top = subset.bit_length() - 1
            left.append(left[subset ^ (1 << top)] & ~filters[top])
        alive = left[subset]
        out[subset, 0] = np.bitwise_count(alive).sum()
        for k, failed in enumerate(filters):
            lost = alive & failed
            out[subset, 1 + k] = np.bitwise_count(lost).sum()
            for m, mark in enumerate(labels):
                out[subset, 1 + (m + 1) * len(FILTERS) + k] = np.bitwise_count(lost & mark).sum()
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = lambda x: [np.frombuffer(b, dtype=np.uint64) for b in x]
    for batch in batches:
        for filters, labels, parts, part_bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            f, m = words(filters), words(labels)
            counts = np.concatenate([count_block(f, m, p) for p in words(part_bits)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(parts, dtype=object), SUBSETS)), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(parts))), *(pa.array(c) for c in counts.T)],
                names=["part", "subset", *_COUNTS],
            )


_COUNTS = ["kept", *(f"{what}_{x}" for what in ("removed", "good", "toxic") for x in FILTERS)]


def subset_counts(indexed: DataFrame) -> DataFrame:
    """The counts of every (part, set of filters) over all blocks."""
    each = indexed.mapInArrow(_count, ", ".join(["part string", "subset int", *(f"{c} long" for c in _COUNTS)]))
    return each.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def audit(indexed: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step in it."""
    by_filter = [F.array(*(F.col(f"{what}_{x}") for x in FILTERS)).alias(what) for what in ("removed", "good", "toxic")]
    # 32 sets a part, so a part's row has a fixed size
    sets = subset_counts(indexed).select("part", "subset", "kept", *by_filter).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", "removed", "good", "toxic"))).alias("sets"))
    orders = ",".join("".join(p) for p in itertools.permutations(FILTERS))
    steps = sets.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.expr("ascii(substring(filter_order, step, 1)) - 65")
    prefix = F.expr("aggregate(sequence(1, step), 0, (m, k) -> IF(k < step, m + shiftleft(1, ascii(substring(filter_order, k, 1)) - 65), m))")
    placed = steps.withColumn("f", letter).withColumn("prefix", prefix)
    weights = F.array(*map(F.lit, ORDERS_WITH_PREFIX))
    # sets that hold the filter remove nothing by it, so they add nothing
    shapley = F.aggregate("sets", F.lit(0).cast("long"), lambda s, x: s + F.get(weights, F.bit_count(x["subset"])) * F.get(x["removed"], F.col("f")))
    here = lambda name: F.get(F.get("sets", F.col("prefix"))[name], F.col("f"))
    bit = F.expr("shiftleft(1, f)")
    return placed.select(
        "part",
        "filter_order",
        "step",
        F.get("sets", F.col("prefix") + bit)["kept"].alias("kept"),
        here("removed").alias("removed"),
        (F.get(F.get("sets", F.lit(0))["removed"], F.col("f")) - here("removed")).alias("redundant"),
        F.get(F.get("sets", F.lit(SUBSETS - 1) - bit)["removed"], F.col("f")).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of documents with columns doc_id, text, lang and labels with doc_id, quality, toxic."""
    return audit(materialize(index(flag(docs, labels)), "audit-index"))
