"""Mixing sources to target weights by repetition rates.

Sizes are words. Sources share the total size by weight; a target stops at
``limit`` times its source's size and the excess goes to the others by weight.
A document is emitted floor(rate) times plus once more with probability equal
to the fraction, by a draw seeded with its id and text, so reruns agree.

Defined results: null text has size 0; null is a source of its own, last in
order; a null id draws as the text "null" and its own text; rows equal in id and
text are numbered by source and what else they hold, and draw each by itself, so
results don't depend on how rows lie; sources of size 0 have target and rate 0 (their documents hold no words); an empty table
gives an empty result. Extra columns are kept by :func:`emit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.llm.bits import bit_set, maybe_in
from framelight.llm.storage import materialize

#: A word is a run of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
LIMIT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target and rate of each source of (source, size) rows.

    Filling goes by the level at which a source is full, ``limit * size / weight``:
    those below the common level stop, the others get level times weight. It
    orders one row for each source, after aggregation.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    full = (F.lit(limit) * F.col("source_size")).cast("double")
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double"))
        .withColumn("full", full)
        .withColumn("full_at", F.col("full") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("total_left", F.col("total") - F.sum("full").over(by_level) + F.col("full"))
        .withColumn("level_here", F.col("total_left") / F.col("weights_left"))
        # the first source that isn't full at its own level sets the level for all after it
        .withColumn("level", F.min(F.when(F.col("level_here") <= F.col("full_at"), F.struct("full_at", "level_here"))).over(everything)["level_here"])
    )
    target = F.least(F.col("full"), F.coalesce(F.col("level") * F.col("weight"), F.col("full")))
    return filled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def draw(id_col: Column, text: Column, turn: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of id, text and turn."""
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws("/", F.coalesce(id_col.cast("string"), F.lit("null")), body, turn.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_turns(rows: DataFrame) -> DataFrame:
    """``rows`` with column turn, which numbers from 1 those that share their (id, text), by source and then by ``order`` if there is one.

    Nearly all rows are alone and aren't moved. The others are numbered over
    sorted ranges, so a large group of copies is spread over tasks; which of two
    rows equal in all of this comes first can't be told from the result.
    """
    columns = [c for c in rows.columns if c != "order"]
    order = [c for c in ("key", "source", "order", "tie") if c in (*rows.columns, "key", "tie")]
    keyed = rows.withColumn("key", F.xxhash64(F.col("id").cast("string"), F.lit(0), "text"))
    repeated = keyed.groupBy("key").count().filter("count > 1").select("key")
    keyed = keyed.withColumn("maybe", maybe_in(bit_set(repeated, "key"), "key"))
    again = materialize(keyed.filter("maybe").drop("maybe"), "repeated-rows")
    placed = again.withColumn("tie", F.monotonically_increasing_id()).orderBy(*order)
    placed = materialize(placed.select(*columns, "key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "repeated-in-order")
    # a row a partition: its first place in all
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.join(F.broadcast(parts), "part").withColumn("place", F.col("before") + F.col("at"))
    starts = materialize(numbered.groupBy("key").agg(F.min("place").alias("start")), "repeated-starts")
    numbered = numbered.join(starts, "key").withColumn("turn", F.col("place") - F.col("start") + 1)
    columns = [*columns, "turn"]
    return keyed.filter("not maybe").withColumn("turn", F.lit(1).cast("long")).select(*columns).union(numbered.select(*columns))


def copies() -> Column:
    """Copies of a row (id, text, turn, rate)."""
    whole = F.floor("rate")
    return (whole + (draw(F.col("id"), F.col("text"), F.col("turn")) < F.col("rate") - whole).cast("long")).cast("long")


def _with_rates(rows: DataFrame) -> DataFrame:
    """Rows (source, text, ...) with size, source_size, target and rate."""
    size = word_count(F.col("text")).alias("size")
    # one row a source: written first, so its true size decides whether it is broadcast
    rates = materialize(source_targets(rows.select("source", size)).withColumnRenamed("source", "rated"), "rates")
    return rows.select("*", size).join(rates, F.col("source").eqNullSafe(F.col("rated"))).drop("rated")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken, n_copies for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = _with_rates(with_turns(rows)).withColumn("n_copies", copies())
    return counted.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")


def emit(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns."""
    # whole rows go as one column, so their names can't clash with those in use here
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.xxhash64(F.to_json(row)).alias("order"))
    taken = _with_rates(with_turns(rows)).select("row", copies().cast("int").alias("n"))
    repeated = taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy"))
    return repeated.select(*(F.col("row")[c].alias(c) for c in docs.columns))
