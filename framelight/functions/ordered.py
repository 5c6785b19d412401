"""Columns computed video by video over frames in order, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``df`` with the rows of equal ``keys`` together in a partition, sorted by keys and ``order``.

    The rows are dealt by a hash of the keys, not by the keys: a plan that holds a
    union of joins by the same keys would leave the shuffle out, and its joins no
    longer deal by them once they turn out small enough to broadcast.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def over_videos(df: DataFrame, inputs: list[str], fields: list[T.StructField], compute: Callable[..., list[np.ndarray]]) -> DataFrame:
    """``df`` with ``fields``: ``compute`` gets the ``inputs`` of one video, ordered by frame_idx, as numpy arrays.

    One shuffle by video and a sort that may spill; a task holds one video's
    rows at a time, whatever the size of its partition.
    """
    names = [f.name for f in fields]
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    given = df.select(*keep, *(df[c].alias(f"_in_{c}") for c in inputs))

    def finish(held: list[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        columns = [table[f"_in_{c}"].to_numpy() for c in inputs]
        parts = [compute(*(c[a:b] for c in columns)) for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True)]
        added = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
        yield from pa.Table.from_arrays([*(table[c] for c in keep), *added], names=[*keep, *names]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, rows, last = [], np.zeros(0, dtype=np.int64), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index("video_id"))
            changes = np.flatnonzero(np.diff(ids.dictionary_encode("encode").indices.to_numpy(), prepend=-1))
            if held and ids[0].as_py() == last:
                changes = changes[1:]  # its first rows go on with the video that's held
            if held and len(changes):  # the last video may go on in the next batch
                yield from finish([*held, batch.slice(0, changes[-1])], np.append(starts, rows + changes[:-1]))
            elif len(changes) > 1:
                yield from finish([batch.slice(0, changes[-1])], changes[:-1])
            if len(changes):
                batch, held, starts, rows = batch.slice(changes[-1]), [], np.zeros(1, dtype=np.int64), 0
            held.append(batch)
            rows, last = rows + batch.num_rows, ids[-1].as_py()
        if held:
            yield from finish(held, starts)

    return in_order(given, ["video_id"], "frame_idx").mapInArrow(run, schema)
