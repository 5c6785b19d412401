"""Order-insensitive comparison of two results."""

from __future__ import annotations


def canonical(frame):
    columns = sorted(frame.columns)
    text = frame[columns].map(lambda v: 0.0 if isinstance(v, float) and v == 0 else v).astype(str)
    return columns, sorted(map(tuple, text.to_numpy().tolist()))


def assert_same(spark_df, duck_rel):
    got, expected = canonical(spark_df.toPandas()), canonical(duck_rel.df())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]
