"""Token counts of documents in flat, unindexed token files.

A token file is a plain run of little-endian ids; an end-of-document id closes
each document, and nothing says where documents lie. Files are cut into blocks
that are read by themselves. A first pass searches each block for the separator
and reports how many it holds and where its last one is; a prefix scan over the
blocks of a file gives how many documents end before a block and where the open
document began; a second pass reads the blocks again and emits every document
that ends in them. Blocks are re-read rather than kept, so a task holds one
block and recovery needs only the file.

Defined results: ids after a file's last separator form a document of their
own; two separators in a row enclose an empty document; an empty file holds
none. When token files are made from a table, null text counts as empty, a
separator string inside a text is encoded as ordinary text, ids of any type come
back as they were, null ones too, and every row, repeated or not, is a document;
columns beyond id and text are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelight.llm.storage import materialize, new_path

#: Bytes of a block.
BLOCK = 8 << 20

# Fixed value: the word pattern of the byte-level tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def read_ids(uri: str, start: int, n: int, dtype: str) -> np.ndarray:
    """``n`` ids of a file from the ``start``-th on."""
    store, path = _open(uri)
    width = np.dtype(dtype).itemsize
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at(n * width, start * width), dtype=dtype)


def write_token_files(docs: DataFrame, ranks_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """Encode texts into flat token files, one for each task; returns (file, ordinal, doc_id, n_ids_in_file).

    Files are named anew at every attempt, so a task run again never meets its
    earlier file; only those named in the returned table count.
    """
    folder = new_path(docs.sparkSession, "tokens")
    id_type = docs.schema[id_col].dataType.simpleString()
    with open(ranks_path, "rb") as f:  # on the driver: executors needn't have the file
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, shared.value.splitlines())}
        encoder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name, ordinal, total, id_kind = f"{uuid.uuid4().hex}.ids", 0, 0, None
        rows = lambda ordinals, ids, n: pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(ids)), ordinals, ids, n], names=["file", "ordinal", "doc_id", "n_ids"])
        with store.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                for text in batch.column(1):
                    ids = np.array([*encoder.encode_ordinary(text.as_py() or ""), end_id], dtype=dtype)
                    out.write(ids.tobytes())
                    total += len(ids)
                n, id_kind = batch.num_rows, batch.column(0).type
                yield rows(pa.array(np.arange(ordinal, ordinal + n)), batch.column(0), pa.array(np.full(n, -1)))  # ids as they came
                ordinal += n
        if id_kind is not None:
            yield rows(pa.array([-1]), pa.nulls(1, id_kind), pa.array([total]))

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return materialize(slim.mapInArrow(write, f"file string, ordinal long, doc_id {id_type}, n_ids long"), "manifest")


def count_tokens(files: DataFrame, end_id: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in files given as (file, n_ids)."""
    spark: SparkSession = files.sparkSession
    step = block // np.dtype(dtype).itemsize
    blocks = files.filter("n_ids > 0").select("file", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ids") - 1, F.lit(step).cast("long"))).alias("start"))
    blocks = blocks.withColumn("n", F.least(F.lit(step), F.col("n_ids") - F.col("start")))

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                ends = np.flatnonzero(read_ids(r.file, r.start, r.n, dtype) == end_id)
                yield pd.DataFrame({"file": [r.file], "start": [r.start], "n": [r.n], "n_ids": [r.n_ids], "ended": [len(ends)], "last": [r.start + int(ends[-1]) if len(ends) else -1]})

    columns = "file string, start long, n long, n_ids long, ended long, last long"
    spread = spark.sparkContext.defaultParallelism * 4
    surveyed = materialize(blocks.repartition(spread, "file", "start").mapInPandas(survey, columns), "blocks")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stitched = surveyed.withColumn("first_ordinal", F.coalesce(F.sum("ended").over(before), F.lit(0))).withColumn("open_from", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                ends = np.flatnonzero(read_ids(r.file, r.start, r.n, dtype) == end_id) + r.start
                if r.start + r.n == r.n_ids and (not len(ends) or ends[-1] != r.n_ids - 1):
                    ends = np.append(ends, r.n_ids)  # the file ends within a document
                starts = np.append(r.open_from, ends[:-1] + 1)[: len(ends)]
                yield pd.DataFrame({"file": r.file, "ordinal": r.first_ordinal + np.arange(len(ends)), "start": starts, "n_tokens": ends - starts})

    return stitched.repartition(spread, "file", "start").mapInPandas(emit, "file string, ordinal long, start long, n_tokens long")


def count_documents(docs: DataFrame, ranks_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row, by way of flat token files."""
    manifest = write_token_files(docs, ranks_path, end_id, id_col, text_col)
    counted = count_tokens(manifest.filter("ordinal < 0").select("file", "n_ids"), end_id)
    # both sides grow with the documents, so neither is broadcast
    return manifest.filter("ordinal >= 0").select("file", "ordinal", "doc_id").join(counted.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
