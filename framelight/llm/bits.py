"""Bit sets of fixed size that spare rows a shuffle, in DataFrame functions only.

Past a few million hashes nearly all bits are set: the filter then lets all rows
through and the exact join behind it does the work, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelight.llm.storage import materialize

#: 64-bit words of a bit set.
BIT_WORDS = 1 << 16


def bit_set(hashes: DataFrame, column: str) -> Column:
    """A bit set over a column of 64-bit hashes, as a scalar."""
    word = F.pmod(F.shiftright(column, 6), F.lit(BIT_WORDS)).cast("int")
    set_bits = hashes.select(word.alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = hashes.sparkSession.range(BIT_WORDS, numPartitions=1).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = set_bits.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return materialize(whole.agg(F.transform(listed, lambda x: x["bits"]).alias("bits")), "bits").scalar()


def maybe_in(bits: Column, column: str) -> Column:
    """False only where the hash is surely not in the bit set."""
    word = F.get(bits, F.pmod(F.shiftright(column, 6), F.lit(BIT_WORDS)).cast("int"))
    return word.bitwiseAND(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")) != 0
