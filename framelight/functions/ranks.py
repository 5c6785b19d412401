"""Exact quantiles of large groups, by counting before sorting.

Values are counted by fixed buckets whose order is that of the values: the sign
and the 64ths of an octave. Running counts say which buckets hold the wanted
ranks, and only the distinct values of those are put in order. A group is spread
over tasks by its buckets, its counts are made before anything is shuffled, and
no list of values is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 64


def _bucket(value: Column) -> Column:
    # values of an order of magnitude below 1e-300 share one bucket with zero on either side
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-300))) * STEPS).cast("long") + 2000 * STEPS
    return F.when(value < 0, -size).otherwise(size)


def quantiles(values: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """``keys``, n and a column for each name of ``shares``: the interpolated value at (n - 1) * share of the non-null values.

    Groups without a value are left out; null keys are groups like others.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    given = values.filter(F.col(column).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(column).cast("double").alias("_v"))
    counted = given.groupBy(*names, _bucket(F.col("_v")).alias("_bucket"), "_v").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*names)
    buckets = counted.groupBy(*names, "_bucket").agg(F.sum("_n").alias("_all"))
    buckets = buckets.withColumns({"_before": F.sum("_all").over(group.orderBy("_bucket")) - F.col("_all"), "n": F.sum("_all").over(group)})
    at = {name: (F.col("n") - 1) * F.lit(share) for name, share in shares.items()}
    ends = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    wanted = [(rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_all")) for rank in ends]
    holding = buckets.filter(F.greatest(*(w.cast("int") for w in wanted)) == 1).select(*(F.col(k).alias(f"{k}_t") for k in names), F.col("_bucket").alias("_bucket_t"), "_before", "n")
    same = F.col("_bucket") == F.col("_bucket_t")
    for k in names:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_t"))
    inside = counted.join(holding, same)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*names, "_bucket").orderBy("_v"))
    placed = inside.withColumn("_upto", upto)
    holds = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col("_v")))
    picked = placed.groupBy(*names).agg(F.max("n").alias("n"), *(holds(f(x)).alias(f"_{name}_{f.__name__}") for name, x in at.items() for f in (F.floor, F.ceil)))
    between = {name: F.col(f"_{name}_floor") + (F.col(f"_{name}_ceil") - F.col(f"_{name}_floor")) * (x - F.floor(x)) for name, x in at.items()}
    return picked.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "n", *(b.alias(name) for name, b in between.items()))
