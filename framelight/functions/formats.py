"""Numbers as text, as C's printf writes them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """A double with so many decimals, rounded by its exact binary value, halves to even; null stays null.

    Java's formatter, which ``format_string`` uses, rounds the shortest decimal form
    half up instead: it writes 0.125 as 0.13 and 1.005 as 1.01.
    """

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.{digits}f}" for x in values.to_pylist()], type=pa.string())

    return run(value.cast("double"))
