"""Similarity graphs of frames, PageRank, and exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelight.config import Config
from framelight.operators import tiles

DAMPING = 0.85
#: Added before display rounding, so that values halfway between two decimals go up whatever their last bits.
TIE = 1e-9


def upsert_nodes(rows: DataFrame, order: str) -> DataFrame:
    """The latest row of each frame, missing values 0 and the default tensor [0]."""
    last = F.row_number().over(Window.partitionBy("video_id", "frame_idx").orderBy(F.desc(order)))
    nodes = rows.withColumn("_last", last).filter("_last = 1").drop("_last", order)
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("timestamp_sec", "residual_energy", "motion_magnitude", "entropy", "action_score", "persistence_value") if c in nodes.columns}
    return nodes.withColumns(zero).withColumn("tensor", F.coalesce("tensor", F.array(F.lit(0.0))) if "tensor" in nodes.columns else F.array(F.lit(0.0)))


def bulk_nodes(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Nodes from features and scores of the same frames."""
    return features.join(scores.select("video_id", "frame_idx", "action_score", "persistence_value"), ["video_id", "frame_idx"])


def enrich(nodes: DataFrame, found: DataFrame, strict: bool = False) -> DataFrame:
    """``nodes`` with the embedding and triples of ``found``; ids without a node are ignored, or an error if strict."""
    if strict and not (lost := found.join(nodes, ["video_id", "frame_idx"], "left_anti")).isEmpty():
        raise KeyError(f"no node for {lost.select('video_id', 'frame_idx').first()}")
    triples = [] if "triples" in found.columns else [F.array().cast("array<string>").alias("triples")]
    return nodes.join(found.select("*", *triples), ["video_id", "frame_idx"], "left")


def motion_coherence(nodes: DataFrame, size: int = tiles.TILE) -> DataFrame:
    """video_id, src, dst, coherence of all pairs of a video's nodes, src < dst."""
    return tiles.pairs(nodes, ["action_score"], tiles.coherences, "coherence", size)


def edge_weights(nodes: DataFrame, config: Config = Config(), size: int = tiles.TILE) -> DataFrame:
    """video_id, src, dst, weight of all pairs of a video's nodes, src < dst.

    Two nodes with embeddings mix cosine and coherence, others have their
    coherence; embeddings of different lengths have cosine 0; a null score gives
    a null weight.
    """

    def weigh(a: pa.Table, b: pa.Table) -> np.ndarray:
        alike, steady = tiles.cosines(a, b), tiles.coherences(a, b)
        return np.where(np.isnan(alike), steady, config.alpha * alike + config.beta * steady)

    return tiles.pairs(nodes, ["action_score", "embedding"], weigh, "weight", size)


def unit_columns(vectors: list, has: np.ndarray) -> np.ndarray:
    """Unit rows of the vectors where ``has`` says so; each length has columns of its own, so vectors of different lengths have product 0."""
    lengths = np.array([len(v) for v in vectors], dtype=np.int64)
    kinds = np.unique(lengths)
    unit, first = np.zeros((len(has), max(int(kinds.sum()), 1))), 0
    places = np.flatnonzero(has)
    for d in kinds.tolist():
        own = np.flatnonzero(lengths == d)
        if d:
            e = np.array([vectors[k] for k in own.tolist()], dtype=float)
            size = np.linalg.norm(e, axis=1, keepdims=True)
            unit[places[own], first : first + d] = np.divide(e, size, out=np.zeros_like(e), where=size > 0)
        first += d
    return unit


class CompleteGraph:
    """The weights of a video's complete graph, applied to vectors without being written out.

    The cosine part of a product is two products with the unit vectors, the
    coherence part prefix sums over the sorted scores; so a product takes time
    and memory in proportion to the nodes and their embeddings.
    """

    def __init__(self, score: np.ndarray, unit: np.ndarray, has: np.ndarray, alpha: float, beta: float):
        self.unit, self.has, self.alpha, self.beta = unit, has, alpha, beta
        self.order = np.argsort(score, kind="stable")
        self.sorted, self.width = score[self.order], score.max() - score.min()
        self.own = np.where(has, alpha * (unit * unit).sum(1) + beta, 1.0)

    def _coherent(self, z: np.ndarray) -> np.ndarray:
        """The sum over i of z_i times the coherence of i with each node."""
        if self.width == 0:
            return np.full(len(z), z.sum())
        w = z[self.order]
        below, moment = np.cumsum(w), np.cumsum(w * self.sorted)
        apart = self.sorted * (2 * below - below[-1]) + moment[-1] - 2 * moment
        out = np.empty(len(z))
        out[self.order] = below[-1] - apart / self.width
        return out

    def times(self, z: np.ndarray) -> np.ndarray:
        embedded = np.where(self.has, z, 0.0)
        both = self.alpha * (self.unit @ (self.unit.T @ embedded)) + (self.beta - 1) * self._coherent(embedded)
        return self._coherent(z) + np.where(self.has, both, 0.0) - self.own * z


def power_iteration(graph: CompleteGraph, seed: np.ndarray, rounds: int = 100, tolerance: float | None = 1e-6) -> np.ndarray:
    """Weighted PageRank; nodes without weight give their mass to the seeds."""
    n = len(seed)
    total = graph.times(np.ones(n))
    linked = np.abs(total) > 1e-12 * n
    share = np.divide(1.0, total, out=np.zeros(n), where=linked)
    p = seed / seed.sum() if seed.sum() > 0 else np.full(n, 1 / n)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = DAMPING * (graph.times(x * share) + x[~linked].sum() * p) + (1 - DAMPING) * p
        if tolerance is not None and np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    if tolerance is not None and seed.sum() > 0:  # no convergence: again without seeds
        return power_iteration(graph, np.zeros(n), rounds, None)
    return x


def pagerank(nodes: DataFrame, config: Config = Config(), rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """video_id, frame_idx, pagerank_score, personalised by action_score.

    The graph of a video is complete; neither its n * n edges are shuffled nor
    its matrix built. A group holds one video's nodes and embeddings.
    """

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx")
        score = rows["action_score"].fillna(0).to_numpy(dtype=float)
        has = rows["embedding"].notna().to_numpy()
        unit = unit_columns(list(rows["embedding"][has]), has)
        found = CompleteGraph(score, unit, has, config.alpha, config.beta)
        return pd.DataFrame({"video_id": rows["video_id"], "frame_idx": rows["frame_idx"], "pagerank_score": power_iteration(found, score, rounds, tolerance)})

    return nodes.select("video_id", "frame_idx", "action_score", "embedding").groupBy("video_id").applyInPandas(rank, "video_id long, frame_idx int, pagerank_score double")


def export_matrix(nodes: DataFrame) -> DataFrame:
    """video_id, frame_idx, row: eight scalars, then tensor and embedding padded to the video's longest."""
    w = Window.partitionBy("video_id")
    scalars = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("frame_idx", "timestamp_sec", "action_score", "persistence_value", "residual_energy", "motion_magnitude", "entropy", "pagerank_score")]
    tensor, embedding = F.coalesce("tensor", F.array(F.lit(0.0))), F.coalesce("embedding", F.array().cast("array<double>"))
    sized = nodes.withColumn("_t", F.max(F.size(tensor)).over(w)).withColumn("_e", F.max(F.size(embedding)).over(w))
    padded = lambda a, n: F.concat(a, F.array_repeat(F.lit(0.0), F.col(n) - F.size(a)))
    return sized.select("video_id", "frame_idx", F.concat(F.array(*scalars), padded(tensor, "_t"), padded(embedding, "_e")).alias("row"))


def sparse_rows(matrix: DataFrame) -> DataFrame:
    """The non-zero entries of matrix rows: video_id, frame_idx, col, value."""
    return matrix.select("video_id", "frame_idx", F.posexplode("row").alias("col", "value")).filter("value <> 0")


def payload_nodes(frames: DataFrame) -> DataFrame:
    """Rounded node rows for display."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    r4 = [F.round(F.coalesce(F.col(c), F.lit(0.0)) + TIE, 4).alias(c) for c in ("action_score", "persistence_value", "residual_energy", "entropy", "pagerank_score")]
    return frames.select(
        "video_id", F.col("frame_idx").cast("string").alias("id"), "frame_idx", F.round(F.coalesce("timestamp_sec", F.lit(0.0)), 3).alias("timestamp"), *r4,
        F.coalesce("is_peak", F.lit(False)).alias("is_peak"), F.coalesce(text("semantic_caption"), text("clip_label"), F.lit("—")).alias("caption"),
    )


def _display(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("video_id")
    s = F.round(F.col("action_score") + TIE, 4)
    width = F.greatest(F.max(s).over(w) - F.min(s).over(w), F.lit(1e-6))
    rank = F.row_number().over(w.orderBy("frame_idx"))
    return nodes.select("video_id", "frame_idx", s.alias("s"), width.alias("width"), rank.alias("rn"))


def adjacent_edges(nodes: DataFrame) -> DataFrame:
    """Edges between temporal neighbours."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    rows = _display(nodes).withColumn("target", F.lead("frame_idx").over(w)).withColumn("s2", F.lead("s").over(w)).filter("target is not null")
    return rows.select("video_id", F.col("frame_idx").alias("source"), "target", F.round(1 - F.abs(F.col("s") - F.col("s2")) / F.col("width") + TIE, 4).alias("weight"))


def cross_edges(nodes: DataFrame, least: float = 0.85) -> DataFrame:
    """Edges between frames that aren't neighbours but have nearly the same score (``least`` below 1)."""
    # only scores in the same or a neighbouring band can be as near as that
    a = _display(nodes).withColumn("band", F.floor(F.col("s") / (F.col("width") * (1 - least))))
    b = a.select("video_id", F.col("frame_idx").alias("target"), F.col("s").alias("s2"), F.col("rn").alias("rn2"), F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"))
    near = a.join(b, ["video_id", "band"]).filter("rn2 >= rn + 2").withColumn("c", 1 - F.abs(F.col("s") - F.col("s2")) / F.col("width"))
    return near.filter(F.col("c") > least).select("video_id", F.col("frame_idx").alias("source"), "target", F.round(F.col("c") + TIE, 4).alias("weight"), F.lit(True).alias("cross"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, peaks and mean score by video."""
    n = nodes.groupBy("video_id").agg(F.count("*").alias("nodes"), F.count_if("is_peak").alias("peaks"), F.avg("action_score").alias("mean_score"))
    return n.join(edges.groupBy("video_id").agg(F.count("*").alias("edges")), "video_id", "left").select("video_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "peaks", "mean_score")
