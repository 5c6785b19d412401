"""PageRank of videos that are cut into ranges of equal scores' order.

``graph.pagerank`` holds one video in a task. Here a video's nodes are sorted by
score across tasks and cut into ranges of at most ``size`` nodes. In every round
a range sends one small row: the sums of its weights and of weights times score,
and the weighted sum of its unit vectors. These rows are added up by video, and
each range gets back the sums of the ranges below it and of all, which is what a
product with the complete graph's weights takes. No task holds more than a
range's nodes, or one small row for each range of a video.

Results equal those of ``graph.pagerank`` but for the order of additions. An
empty table gives an empty table; repeated frames are nodes of their own; a null
score counts 0; a null embedding leaves a node to its score.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelight.config import Config
from framelight.functions.ordered import in_order
from framelight.operators.graph import DAMPING, unit_columns

SIZE = 4096
KEYS = ["video_id", "block"]
#: What a range tells of itself, and in which order its lists come.
NUMBERS = ["low", "high", "seed", "moved", "loose"]
LISTS = ["sums", "pull", "x", "share", "below"]
SUMS = ", ".join(["n long", *(f"{c} double" for c in NUMBERS), "dims array<int>", *(f"{c} array<double>" for c in LISTS)])
#: Rows of a batch that leaves a task.
SENT = 1024


def _cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that the session names; a local session without one gets its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="framelight-"))
    held = df.persist()  # or else the checkpoint would run the plan twice
    kept = held.checkpoint()
    held.unpersist()
    return kept


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Sorted rows by their keys, one group at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.any([np.diff(c, prepend=c[:1] - 1) != 0 for c in codes], axis=0)).tolist()
        for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            part = batch.slice(low, high - low)
            key = tuple(part.column(k)[0].as_py() for k in keys)
            if held and key != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
            last = key
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as slices of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:-1])


class _Sent:
    """Rows as they leave a task, some at a time."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types, self.rows = names, types, []

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= SENT:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*self.rows, strict=True), self.types, strict=True)], names=self.names)
        self.rows = []


def ranges(nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """A row a range: video_id, block, and by rising score the frames, scores, which have an embedding, the unit vectors in a row, and the lengths of embeddings.

    Scores rise from block to block of a video, too.
    """
    rows = nodes.select("video_id", "frame_idx", F.coalesce(F.col("action_score").cast("double"), F.lit(0.0)).alias("score"), F.col("embedding").cast("array<double>").alias("embedding"))
    order = ["video_id", "score", "frame_idx"]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # sampled bounds must not be drawn anew once blocks are numbered
    fixed = _cut_lineage(numbered.withColumn("block", F.expr(f"at div {int(size)}")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = None
        for (video, block), group in _groups(batches, KEYS):
            if sent is None:
                sent = _Sent([*KEYS, "frames", "scores", "has", "unit", "dims"], [group.schema.field("video_id").type, pa.int64(), pa.list_(group.schema.field("frame_idx").type), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.float64()), pa.list_(pa.int32())])
            has = group.column("embedding").is_valid().to_numpy()
            vectors = [v for v, h in zip(_lists(group.column("embedding")), has, strict=True) if h]
            yield from sent.add(video, block, group.column("frame_idx").to_numpy(), group.column("score").to_numpy(), has, unit_columns(vectors, has).ravel(), sorted({len(v) for v in vectors} - {0}))
        if sent is not None:
            yield from sent.rest()

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("video_id", "frame_idx")}
    packed = in_order(fixed, KEYS, "at").mapInArrow(pack, f"video_id {kinds['video_id']}, block long, frames array<{kinds['frame_idx']}>, scores array<double>, has array<boolean>, unit array<double>, dims array<int>")
    return _cut_lineage(packed.repartition(*KEYS).sortWithinPartitions(*KEYS))


class Range:
    """A range's nodes, its sums for weights z, and its part of a product with the complete graph's weights."""

    def __init__(self, score: np.ndarray, has: np.ndarray, unit: np.ndarray, dims: np.ndarray, config: Config):
        self.score, self.has, self.dims = score, has.astype(bool), dims
        self.unit = unit.reshape(len(score), -1)
        self.alpha, self.beta = config.alpha, config.beta
        self.own = np.where(self.has, self.alpha * (self.unit * self.unit).sum(1) + self.beta, 1.0)

    def row(self, z: np.ndarray, seed: np.ndarray, moved: float = 0.0, loose: float = 0.0, x: np.ndarray = (), share: np.ndarray = ()) -> tuple:
        """In the order of ``SUMS``."""
        embedded = np.where(self.has, z, 0.0)
        sums = [z.sum(), z @ self.score, embedded.sum(), embedded @ self.score]
        pull = (self.unit.T @ embedded)[: int(self.dims.sum())]
        return len(z), self.score.min(), self.score.max(), seed.sum(), moved, loose, self.dims, sums, pull, x, share, []

    def times(self, z: np.ndarray, told: dict) -> np.ndarray:
        width, below, total = told["high"] - told["low"], told["below"], told["sums"]

        def coherent(w: np.ndarray, first: int) -> np.ndarray:
            if width == 0:
                return np.full(len(w), total[first])
            count = below[first] + np.cumsum(w)
            moment = below[first + 1] + np.cumsum(w * self.score)
            apart = self.score * (2 * count - total[first]) + total[first + 1] - 2 * moment
            return total[first] - apart / width

        embedded = np.where(self.has, z, 0.0)
        both = (self.beta - 1) * coherent(embedded, 2)
        if len(self.dims):
            pulls = dict(zip(told["dims"].tolist(), np.split(told["pull"], np.cumsum(told["dims"])[:-1]), strict=True))
            both = both + self.alpha * (self.unit @ np.concatenate([pulls[d] for d in self.dims.tolist()]))
        return coherent(z, 0) + np.where(self.has, both, 0.0) - self.own * z


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A video's range rows added up, with the sums of the ranges below each; x and share stay."""
    sent = None
    for (video,), group in _groups(batches, ["video_id"]):
        sent = sent or _Sent(group.schema.names, group.schema.types)
        column = {c: group.column(c).to_numpy() for c in ("block", "n", *NUMBERS)}
        lists = {c: _lists(group.column(c)) for c in ("dims", "sums", "pull", "x", "share")}
        sums = np.stack(lists["sums"])
        below = np.cumsum(sums, axis=0) - sums
        pulls: dict[int, np.ndarray] = {}
        for dims, pull in zip(lists["dims"], lists["pull"], strict=True):
            first = 0
            for d in dims.tolist():
                pulls[d] = pulls.get(d, 0) + pull[first : first + d]
                first += d
        dims = sorted(pulls)
        whole = [column["n"].sum(), column["low"].min(), column["high"].max(), *(column[c].sum() for c in ("seed", "moved", "loose"))]
        flat = np.concatenate([pulls[d] for d in dims]) if dims else np.zeros(0)
        for k, block in enumerate(column["block"].tolist()):
            yield from sent.add(video, block, *whole, dims, sums.sum(0), flat, lists["x"][k], lists["share"][k], below[k])
    if sent is not None:
        yield from sent.rest()


def _iterate(rows: DataFrame, config: Config, seeded: bool, rounds: int, tolerance: float | None) -> DataFrame:
    """The state of each range after the last round: its sums and x, the ranks of its nodes in order."""
    full = f"video_id {rows.schema['video_id'].dataType.simpleString()}, block long, {SUMS}"
    parts = ["scores", "has", "unit", "own_dims"]
    seeds = lambda own: own.score if seeded else np.zeros(len(own.score))

    def open_range(own: Range, told: dict) -> tuple:
        return own.row(np.ones(len(own.score)), seeds(own))

    def link(own: Range, told: dict) -> tuple:
        n = told["n"]
        total = own.times(np.ones(len(own.score)), told)
        linked = np.abs(total) > 1e-12 * n
        share = np.divide(1.0, total, out=np.zeros(len(total)), where=linked)
        x = np.full(len(total), 1 / n)
        return own.row(x * share, seeds(own), np.inf, x[~linked].sum(), x, share)

    def turn(own: Range, told: dict) -> tuple:
        x, share, seed = told["x"], told["share"], seeds(own)
        if tolerance is not None and told["moved"] < told["n"] * tolerance:
            new = x  # the video came to rest in an earlier round
        else:
            p = seed / told["seed"] if told["seed"] > 0 else np.full(len(x), 1 / told["n"])
            new = DAMPING * (own.times(x * share, told) + told["loose"] * p) + (1 - DAMPING) * p
        return own.row(new * share, seed, np.abs(new - x).sum(), new[share == 0].sum(), new, share)

    def each(step: Callable[[Range, dict], tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = [pa.int64(), pa.int64(), *[pa.float64()] * len(NUMBERS), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * len(LISTS)]
            for batch in batches:
                if not batch.num_rows:
                    continue
                sent = _Sent([*KEYS, "n", *NUMBERS, "dims", *LISTS], [batch.schema.field("video_id").type, *types])
                given = {f.name: _lists(c) if pa.types.is_list(f.type) else c.to_pylist() for f, c in zip(batch.schema, batch.columns, strict=True)}
                for k in range(batch.num_rows):
                    row = {c: v[k] for c, v in given.items()}
                    yield from sent.add(row["video_id"], row["block"], *step(Range(*(row[c] for c in parts), config), row))
                yield from sent.rest()

        return run

    own = rows.select(*KEYS, "scores", "has", "unit", F.col("dims").alias("own_dims"))

    def advance(state: DataFrame, step) -> DataFrame:
        told = in_order(state, ["video_id"], "block").mapInArrow(_add_up, full)
        return _cut_lineage(own.join(told, KEYS).mapInArrow(each(step), full))

    state = advance(own.mapInArrow(each(open_range), full), link)
    for _ in range(rounds):
        state = advance(state, turn)
        if tolerance is not None and _restless(state, tolerance).isEmpty():
            break
    return state


def _restless(state: DataFrame, tolerance: float) -> DataFrame:
    """video_id of the videos that still move and have seeds or not, as ``seed`` tells."""
    whole = state.groupBy("video_id").agg(F.sum("moved").alias("moved"), F.sum("n").alias("n"), F.sum("seed").alias("seed"))
    return whole.filter(F.col("moved") >= F.col("n") * tolerance).select("video_id", "seed")


def pagerank(nodes: DataFrame, config: Config = Config(), rounds: int = 100, tolerance: float | None = 1e-6, size: int = SIZE) -> DataFrame:
    """video_id, frame_idx, pagerank_score as ``graph.pagerank`` gives them, for videos of any length."""
    rows = ranges(nodes, size)
    state = _iterate(rows, config, True, rounds, tolerance).select(*KEYS, "x", "moved", "n", "seed")
    if tolerance is not None:
        # no convergence: again without seeds
        lost = _restless(state, tolerance).filter("seed > 0").select("video_id")
        if not lost.isEmpty():
            again = _iterate(rows.join(lost, "video_id", "left_semi"), config, False, rounds, None)
            state = state.join(lost, "video_id", "left_anti").select(*KEYS, "x").unionByName(again.select(*KEYS, "x"))
    ranked = rows.select(*KEYS, "frames").join(state.select(*KEYS, "x"), KEYS)
    return ranked.select("video_id", F.explode(F.arrays_zip("frames", "x")).alias("f")).select("video_id", F.col("f.frames").alias("frame_idx"), F.col("f.x").alias("pagerank_score"))
