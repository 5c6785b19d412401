"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows get global numbers in the order of (doc_id, size, checksum), a balanced
Feistel network with cycle walking permutes 0..n-1, and row number i goes to
shard ``p(i) mod shards`` at slot ``p(i) div shards``. Shard and slot of a row
number can be computed without the data. Law: ``rows``, counts of shards differ
by one at most.

Defined results: null text counts as empty (size 1, checksum 0); null doc_id
sorts first; repeated rows get numbers of their own, and since such rows are
equal in all that is returned the result is the same whichever comes first; an
empty table gives an empty result. Equal texts aren't held together, as one
group of copies may be larger than a shard. Columns beyond those used are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.llm.storage import materialize
from framelight.llm.text import mix

ROUNDS = 8


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The image of each of ``numbers`` under the keyed permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        return (left << np.uint64(half)) | right

    out = network(numbers.astype(np.uint64))
    while (walking := out >= np.uint64(n)).any():  # each walk stays on one cycle, so it comes back below n
        out[walking] = network(out[walking])
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with gapless global numbers in the given order, and how many rows it has.

    Only a count for each sorted partition comes to the driver.
    """
    placed = materialize(
        df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered"
    )
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    starts = np.zeros(max(first, default=0) + 1, dtype=np.int64)
    starts[list(first)] = list(first.values())
    shared = df.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def number(part: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(shared.value[part.to_numpy()] + (at.to_numpy() & ((1 << 33) - 1)))

    return placed.select(*df.columns, number("_part", "_at").alias(name)), total


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, n = number_rows(slim, ["doc_id", "size", "text_crc32"])

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), n, seed))

    placed = numbered.withColumn("place", place("row_number"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
