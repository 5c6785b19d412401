"""Vectorised reading of text columns inside Arrow batches.

Words are runs of bytes outside ``\\x20\\x09-\\x0D``. Word hashes are 64-bit
polynomial hashes over random byte weights, taken from prefix sums, so a batch
is hashed without a Python loop over its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes hashed at once; longer texts are cut at white space into such pieces.
PIECE = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WEIGHT = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT_LOWER = _WEIGHT[LOWER]
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[start:end]``."""
    n = len(data)
    weights = (_WEIGHT_LOWER if lower else _WEIGHT)[data]
    weights *= _powers_of(_BASE, n)[:n]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(weights, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers_of(_INVERSE, n + 1)[starts])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, offsets (one more than rows) and the null mask of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], nulls


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``PIECE`` that end between rows, or at white space within a long row."""
    total, low = len(data), 0
    while low < total:
        high = low + PIECE
        if high >= total:
            yield low, total
            return
        row_end = offsets[np.searchsorted(offsets, high, side="right") - 1]
        if row_end <= low:  # the piece lies within one row
            while high < total and not SPACE[data[high]]:
                jump = SPACE[data[high : high + 65536]]
                high += int(jump.argmax()) if jump.any() else len(jump)
            row_end = min(high, offsets[np.searchsorted(offsets, low, side="right")])
        yield low, int(row_end)
        low = int(row_end)


def word_spans(data: np.ndarray, boundary: np.ndarray, letters: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``letters``; ``boundary`` holds positions where a row begins."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = letters[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[boundary[boundary <= n]] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch in order, and for each row where its words begin (one more than rows)."""
    hashes, begins = [], []
    for low, high in pieces(data, offsets):
        part = data[low:high]
        inner = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, side="right")] - low
        starts, ends = word_spans(part, inner, letters)
        hashes.append(span_hashes(part, starts, ends, lower))
        begins.append(starts + low)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive offsets; empty rows give 0."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.int64)
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts together have about ``most`` bytes, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = done = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(first, last - first)
        first, done = last, int(sizes[last - 1])


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list]],
    keep_text: bool = True,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``fields`` computed from its text, batch by batch.

    ``make`` runs once for each task and returns the function for one batch.
    A column of ``df`` whose name is one of the new fields is replaced; without
    ``keep_text`` the text itself is left out.
    """
    names = {f.name for f in fields}
    keep = [c for c in df.columns if c not in names or c == text_col]
    if text_col in names:
        raise ValueError(f"{text_col} cannot be both text and result")
    schema = T.StructType([*(df.schema[c] for c in keep if keep_text or c != text_col), *fields])
    sliced = isinstance(df.schema[text_col].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for batch in slices(whole, at) if sliced else [whole]:
                columns = [batch.column(i) for i in range(batch.num_columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*columns, *compute(batch.column(at))], names=schema.names)

    return df.select(*(f"`{c}`" for c in keep)).mapInArrow(run, schema)
