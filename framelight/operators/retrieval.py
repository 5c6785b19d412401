"""Ranking and retrieval of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.config import Config
from framelight.functions.arrays import dot
from framelight.operators import tiles

#: Stands for a caption that no model could make.
CAPTION_FAILED = "[CAPTION_FAILED]"
#: Frames of a video and queries of a block whose cosines are one matrix, and queries that a task holds at once.
TILE = 2048
SLICE = 256
BLOCK = 4096
#: Rows that leave a task together.
SENT = 1 << 16


def _query_keys(queries: DataFrame) -> list[str]:
    return [c for c in queries.columns if c != "query_embedding"]


def best_places(score: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, rank) of the ``k`` highest of each row of a matrix, not-a-numbers last; of equals the lower ``tie`` leads."""
    score = np.where(np.isnan(score), -np.inf, score)
    n = score.shape[1]
    if n > 2 * k:
        q, i = np.nonzero(score >= np.partition(score, n - k, axis=1)[:, n - k, None])
    else:
        q, i = (x.ravel() for x in np.indices(score.shape))
    order = np.lexsort((tie[i], -score[q, i], q))
    q, i = q[order], i[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    return q[rank <= k], i[rank <= k], rank[rank <= k]


def best_of_videos(nodes: DataFrame, queries: DataFrame, k: int, returned: list[str], names: list[str], score: Callable[[pa.Table, np.ndarray], list[np.ndarray]], tie: str) -> DataFrame:
    """The ``k`` best nodes of each video for each query: the queries' keys, ``returned`` columns of nodes, ``names`` and rank.

    Queries are a table of ``query_embedding`` and any key columns; equal rows are
    one query. ``score`` gets some nodes of a video and the cosines (query, node)
    of some queries, 0 without an embedding, and returns the values of ``names``, by
    which the last ranks; of equals the lower ``tie`` leads.

    Videos are dealt to as many parts as shuffles have partitions. A task gets a
    part's nodes in order and, in front of them, a copy of the queries, ``BLOCK`` at a
    time; so nodes are shuffled once a block and queries once a part, never once a
    video. It holds a block and the best of one open video, however long that is, and
    what leaves it is the result.
    """
    spark, keys = nodes.sparkSession, _query_keys(queries)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.distinct().withColumn("_hash", F.xxhash64(*queries.columns))
    # one row: how many blocks there are
    number = asked.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("_blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kinds = {f.name: f.dataType for f in nodes.schema}
    own = list(dict.fromkeys(["video_id", "frame_idx", "embedding", tie, *nodes.columns]))
    absent = lambda columns, of: [F.lit(None).cast(of[c]).alias(f"{'' if of is kinds else '_q_'}{c}") for c in columns]
    key_kinds = {c: queries.schema[c].dataType for c in keys}
    blocked = asked.crossJoin(F.broadcast(number)).withColumn("_block", F.pmod("_hash", F.col("_blocks")).cast("int")).withColumn("_part", each(F.lit(parts)))
    sent = blocked.select("_part", "_block", F.lit(0).alias("_kind"), F.col("query_embedding").cast(kinds["embedding"]).alias("embedding"), *absent([c for c in own if c != "embedding"], kinds), *(F.col(c).alias(f"_q_{c}") for c in keys))
    dealt = nodes.crossJoin(F.broadcast(number)).withColumn("_block", each(F.col("_blocks"))).withColumn("_part", F.pmod(F.xxhash64("video_id"), F.lit(parts)).cast("int"))
    rows = dealt.select("_part", "_block", F.lit(1).alias("_kind"), *own, *absent(keys, key_kinds)).unionByName(sent)
    schema = T.StructType([*(T.StructField(c, key_kinds[c]) for c in keys), *(T.StructField(c, kinds[c]) for c in returned), *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("rank", T.IntegerType())])

    class Open:
        """The best of one video, for each slice of the queries in turn."""

        def __init__(self, slices: list):
            self.slices, self.found = slices, [None] * len(slices)

        def add(self, tile: pa.Table) -> None:
            unit = tiles.unit_rows(tile)
            for at, (block, by) in enumerate(self.slices):
                values = [np.broadcast_to(v, (block.num_rows, tile.num_rows)) for v in score(tile, np.nan_to_num(tiles.products(*by, *unit)))]
                q, i, rank = best_places(values[-1], tile.column(tie).to_numpy(), k)
                new = (q, tile.take(pa.array(i)).combine_chunks(), [v[q, i] for v in values], rank)
                self.found[at] = new if self.found[at] is None else self.merged(self.found[at], new)

        @staticmethod
        def merged(old: tuple, new: tuple) -> tuple:
            q, rows, values = np.concatenate([old[0], new[0]]), pa.concat_tables([old[1], new[1]]), [np.concatenate(v) for v in zip(old[2], new[2], strict=True)]
            order = np.lexsort((rows.column(tie).to_numpy(), -np.where(np.isnan(values[-1]), -np.inf, values[-1]), q))
            rank = np.arange(len(q)) - np.searchsorted(q[order], q[order]) + 1
            order, rank = order[rank <= k], rank[rank <= k]
            return q[order], rows.take(pa.array(order)).combine_chunks(), [v[order] for v in values], rank

        def rows(self) -> Iterator[pa.Table]:
            for (block, _), (q, rows, values, rank) in zip(self.slices, self.found, strict=True):
                columns = [*(block.column(f"_q_{c}").take(pa.array(q)) for c in keys), *(rows.column(c) for c in returned), *(pa.array(v, from_pandas=True) for v in values), pa.array(rank.astype(np.int32))]
                yield pa.table(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, blocks, slices, video, best, out, n_out = None, [], None, None, None, [], 0

        def closed() -> list[pa.Table]:
            return list(best.rows()) if best is not None else []

        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = [table.column(c).to_numpy() for c in ("_part", "_block", "_kind")]
            codes.append(table.column("video_id").combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(np.any([np.diff(c, prepend=c[:1] - 1) != 0 for c in codes], axis=0))
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                part = table.slice(low, high - low)
                here, given = tuple(int(c[low]) for c in codes[:2]), part.column("video_id")[0].as_py()
                if here != place or (codes[2][low] and given != video):
                    out += closed()
                    n_out, best = sum(t.num_rows for t in out), None
                if here != place:
                    place, blocks, slices = here, [], None
                if not codes[2][low]:
                    blocks.append(part)
                    continue
                if slices is None:  # the queries are all there once the first node comes
                    whole = pa.concat_tables(blocks).combine_chunks() if blocks else part.slice(0, 0)
                    slices = [(s, tiles.unit_rows(s)) for s in (whole.slice(x, SLICE) for x in range(0, whole.num_rows, SLICE))]
                if best is None:
                    best, video = Open(slices), given
                for x in range(0, part.num_rows, TILE):
                    best.add(part.slice(x, TILE).combine_chunks())
                if n_out >= SENT:
                    yield from pa.concat_tables(out).to_batches(max_chunksize=SENT)
                    out, n_out = [], 0
        out += closed()
        if out:
            yield from pa.concat_tables(out).to_batches(max_chunksize=SENT)

    order = ["_part", "_block", "_kind", "video_id", "frame_idx"]
    return rows.repartitionById(parts, F.col("_part")).sortWithinPartitions(*order).mapInArrow(run, schema)


def hybrid_retrieve(nodes: DataFrame, queries: DataFrame, k: int, config: Config = Config()) -> DataFrame:
    """The ``k`` best frames of each video for each query, with the three parts of their scores.

    ``queries`` has ``query_embedding`` and columns that tell queries apart, which
    come back; without such columns equal vectors are one query. Without an embedding on
    either side the semantic part is 0; of equal scores the earlier frame leads.
    """
    given = nodes.select("video_id", "frame_idx", "embedding", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("action_score", "persistence_value")))

    def parts(tile: pa.Table, cosine: np.ndarray) -> list[np.ndarray]:
        semantic = config.alpha * cosine
        action, persistence = (w * tile.column(c).to_numpy() for w, c in ((config.beta, "action_score"), (config.gamma, "persistence_value")))
        return [semantic, action, persistence, semantic + action + persistence]

    return best_of_videos(given, queries, k, ["video_id", "frame_idx"], ["semantic", "action", "persistence", "score"], parts, "frame_idx")


def fallback_rank(frames: DataFrame, k: int) -> DataFrame:
    """The ``k`` frames of each video with the highest score, then residual."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("action_score"), F.desc("residual_energy"), "frame_idx"))
    return frames.withColumn("rank", rank).filter(F.col("rank") <= k)


def query_action_score(videos: DataFrame, indexed: DataFrame) -> DataFrame:
    """The highest score among a video's indexed frames, 0.5 without any."""
    best = indexed.groupBy("video_id").agg(F.max("action_score").alias("best"))
    return videos.join(best, "video_id", "left").select("video_id", F.coalesce("best", F.lit(0.5)).alias("query_action_score"))


def zero_shot_label(frames: DataFrame, labels: DataFrame, fallback: str = "visual cues from the video") -> DataFrame:
    """The label (name, vector) with the largest dot product; ``labels`` is a vocabulary of bounded size."""
    met = frames.crossJoin(F.broadcast(labels)).withColumn("dot", dot("embedding", "vector"))
    best = met.groupBy("video_id", "frame_idx").agg(F.max(F.struct("dot", F.struct((-F.col("position")).alias("p"), "name"))).alias("best"))
    return frames.select("video_id", "frame_idx").join(best, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.coalesce("best.col2.name" if "col2" in best.schema["best"].dataType.fieldNames() else F.col("best")[best.schema["best"].dataType.fieldNames()[1]]["name"], F.lit(fallback)).alias("label"))


def embed(rows: DataFrame, column: str, model: Callable[[pd.Series], list], size: int = 512, out: str = "embedding") -> DataFrame:
    """``rows`` with unit vectors from a model plug-in; where a batch fails each of its rows is tried alone, and those that fail give zeros."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        import numpy as np

        def units(part: pd.Series) -> list:
            raw = np.array(model(part), dtype=float).reshape(len(part), -1)
            length = np.linalg.norm(raw, axis=1, keepdims=True)
            return list(np.divide(raw, length, out=np.zeros_like(raw), where=length > 0))

        try:
            return pd.Series(units(values))
        except Exception:  # the model is foreign code
            found = []
            for i in range(len(values)):
                try:
                    found += units(values.iloc[i : i + 1])
                except Exception:
                    found.append([0.0] * size)
            return pd.Series(found)

    return rows.withColumn(out, run(column))


def caption_chain(*captions: Column) -> Column:
    """The first caption there is, else the failure mark."""
    return F.coalesce(*captions, F.lit(CAPTION_FAILED))


def uniform_sample_count(total: Column, fps: Column, rate: Column) -> Column:
    """Frames that a uniform sample at ``rate`` a second takes: half-even rounding, 1 at least; all without fps."""
    return F.when(fps <= 0, total).otherwise(F.greatest(F.lit(1), F.bround(total / fps * rate, 0))).cast("long")
