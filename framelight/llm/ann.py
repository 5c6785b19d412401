"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts
(recursive bisection of the smoothest graph signal at its median). A small
classifier learns to tell a vector's part; it places every row in its likeliest
part and routes each query to its most probable parts, where candidates are
ranked by exact cosine in double precision. Parts are dealt out in blocks of
bounded size on both sides, so neither a large part nor many queries meet in one
task. Rows with equal vectors share a score, so only the first ``k + 1`` ids of
each distinct vector can be among any ``k`` nearest; the rest are set aside
exactly.

Defined results: vectors that are null, empty, zero, hold a null or non-finite
component, or differ from the commonest length take no part, neither as queries
nor candidates; rows with null ids take no part; a repeated row is a candidate
for each other row with another id only, and one candidate however often it
occurs; an id with several vectors counts by the nearest; a query that finds fewer
than ``k`` candidates in its parts visits all parts, so it gets fewer only if the
table has fewer; equal scores go by the smaller id; components of any finite size
count in full; columns beyond id and vector are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.llm.storage import materialize

#: The index: rows it is fitted on, parts (a power of two), neighbours in the graph, hidden units.
SAMPLE = 8192
PARTS = 16
GRAPH_NEIGHBOURS = 10
HIDDEN = 96
EPOCHS = 60
#: Probability that the parts a query visits hold together, and the sides of a block.
COVER = 0.985
BLOCK_ROWS = 2048
BLOCK_QUERIES = 1024


def usable(vector: Column) -> Column:
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(wrong, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = _near_one(x)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _near_one(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two each, so that squares neither overflow nor vanish and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` nearest other rows, by blocks of rows."""
    out = []
    for low in range(0, len(unit), 256):
        near = unit[low : low + 256] @ unit.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -np.inf
        out.append(np.argpartition(-near, min(k, len(unit) - 1) - 1, axis=1)[:, :k].copy())  # a view would keep the whole block
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Cut the graph into parts of equal size."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(graph), dtype=np.int64)
    source, target = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    for _ in range(parts.bit_length() - 1):
        signal = rng.normal(size=len(graph))
        within = label[source] == label[target]
        a, b = source[within], target[within]
        degree = np.bincount(a, minlength=len(graph)) + np.bincount(b, minlength=len(graph)) + 1
        size = np.maximum(np.bincount(label, minlength=parts), 1)
        for _ in range(150):  # lazy walk without its constant part: what stays is the smoothest signal
            signal = (signal + np.bincount(a, signal[b], len(graph)) + np.bincount(b, signal[a], len(graph))) / degree
            signal -= (np.bincount(label, signal, parts) / size)[label]
            signal /= np.abs(signal).max() + 1e-300
        order = np.lexsort((np.arange(len(graph)), signal, label))
        place = np.arange(len(graph)) - np.searchsorted(label[order], label[order])
        upper = np.zeros(len(graph), dtype=np.int64)
        upper[order] = place >= (size[label[order]] + 1) // 2
        label = label * 2 + upper
    return label


def part_shares(graph: np.ndarray, label: np.ndarray, parts: int) -> np.ndarray:
    """For each row, the share of each part among itself and its neighbours, its own part counting as half."""
    share = np.zeros((len(label), parts))
    np.add.at(share, (np.repeat(np.arange(len(label)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    share[np.arange(len(label)), label] += 0.5
    return share


def train_router(unit: np.ndarray, share: np.ndarray, seed: int = 6) -> list[np.ndarray]:
    """One hidden layer and a softmax, fitted to the shares by Adam."""
    rng = np.random.default_rng(seed)
    d, parts = unit.shape[1], share.shape[1]
    net = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(t) for t in net], [np.zeros_like(t) for t in net], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(unit)), max(1, len(unit) // 256)):
            x = unit[at]
            h = np.maximum(x @ net[0] + net[1], 0)
            p = _softmax(h @ net[2] + net[3])
            p = (p - share[at]) / len(at)
            back = (p @ net[2].T) * (h > 0)
            step += 1
            for t, g, a, b in zip(net, [x.T @ back, back.sum(0), h.T @ p, p.sum(0)], m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                t -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def route(net: list[np.ndarray], unit: np.ndarray, cover: float) -> list[np.ndarray]:
    """For each row its most probable parts, likeliest first, until they hold ``cover`` of the probability."""
    p = _softmax(np.maximum(unit @ net[0] + net[1], 0) @ net[2] + net[3])
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
    return [o[: max(1, n)].astype(np.int32) for o, n in zip(order, (before < cover).sum(1), strict=True)]


def fit(vectors: DataFrame, parts: int = PARTS) -> list[np.ndarray] | None:
    """The router, fitted in one task on a bounded hash sample of (vec_id, vector) rows."""
    n = vectors.count()
    if not n:
        return None
    thinned = vectors.withColumn("_draw", F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000))).filter(F.col("_draw") < min(1.0, 1.2 * SAMPLE / n) * 1_000_000)
    sample = thinned.orderBy("_draw", "vec_id").limit(SAMPLE).select("vector").coalesce(1)
    row = sample.mapInPandas(lambda batches: fit_batches(batches, parts), "net binary").first()
    return pickle.loads(row["net"]) if row else None


def fit_batches(batches: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """The router of all sampled vectors as one pickled row, none without vectors."""
    rows = [np.stack(b["vector"].to_numpy()).astype(np.float64) for b in batches if len(b)]
    if rows:
        yield pd.DataFrame({"net": [pickle.dumps(fit_sample(np.concatenate(rows), parts))]})


def fit_sample(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    unit = np.unique(_unit(vectors), axis=0)
    if len(unit) < 4 * parts:  # too few to cut: all in one part
        return [np.zeros((unit.shape[1], 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts)]
    graph = neighbour_graph(unit, min(GRAPH_NEIGHBOURS, len(unit) - 1))
    return train_router(unit, part_shares(graph, balanced_parts(graph, parts), parts))


def search(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each query."""
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    valid = table.select(F.col(id_col).alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = valid.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    valid = valid.filter(F.size("vector") == (lengths[0]["d"] if lengths else 0))
    first = Window.partitionBy("vector").orderBy("vec_id")
    # repeated rows go first, so that the first rows of a vector are its first ids
    distinct = valid.select("vec_id", "vector").dropDuplicates().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).drop("_n")
    net = fit(valid.select("vec_id", "vector"), parts)
    shared = spark.sparkContext.broadcast(net)

    def router(share: float):
        @F.pandas_udf("array<int>")
        def routed(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(route(shared.value, _unit(np.stack(x.to_numpy()).astype(np.float64)), share))

        return routed

    placed = materialize(distinct.withColumn("part", router(0.0)("vector")[0]), "ann-rows")
    queries = valid.filter("is_query").select(F.col("vec_id").alias("query_id"), "vector")
    n_rows = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    near = materialize(_met(materialize(queries.withColumn("part", F.explode(router(cover)("vector"))), "ann-queries"), placed, n_rows, k), "ann-found")
    # parts that hold too few candidates: those queries visit every part
    found = near.groupBy("query_id").agg(F.countDistinct("vec_id").alias("found"))
    short = materialize(queries.join(found, "query_id", "left").filter(F.coalesce("found", F.lit(0)) < k).drop("found"), "ann-short")
    if not short.isEmpty():
        every = F.array(*(F.lit(p) for p in n_rows)).cast("array<int>")
        near = near.union(_met(short.withColumn("part", F.explode(every)), placed, n_rows, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(asked: DataFrame, placed: DataFrame, n_rows: dict[int, int], k: int) -> DataFrame:
    """The nearest of each query (query_id, vector, part) in each block of rows of its parts."""
    n_asked = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}

    def blocks(n: dict[int, int], most: int) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for p in {0, *n_rows, *n_asked} for x in (p, -(-n.get(p, 1) // most)))), F.col("part"))

    row_blocks, query_blocks = blocks(n_rows, BLOCK_ROWS), blocks(n_asked, BLOCK_QUERIES)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own_row, own_query = F.pmod(F.xxhash64("vec_id"), row_blocks).cast("int"), F.pmod(F.xxhash64("query_id"), query_blocks).cast("int")
    rows = placed.withColumn("row_block", own_row).withColumn("query_block", each(query_blocks))
    queries = asked.withColumn("query_block", own_query).withColumn("row_block", each(row_blocks))
    key = ["part", "row_block", "query_block"]
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(lambda q, r: block_nearest(q, r, k), "query_id long, vec_id long, score double")


def block_nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` ids of a block for each of its queries; an id counts once, by its nearest vector.

    A matrix product finds what may be among the best; those are scored again
    pair by pair, so equal vectors have equal scores in every block.
    """
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    q, v = np.stack(queries["vector"].to_numpy()), np.stack(rows["vector"].to_numpy())
    q_id, v_id = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
    rough = _unit(q) @ _unit(v).T
    rough[q_id[:, None] == v_id[None]] = -np.inf
    by_id = np.argsort(v_id, kind="stable")
    starts = np.flatnonzero(np.diff(v_id[by_id], prepend=v_id[by_id[0]] - 1))
    best = rough if len(starts) == len(v_id) else np.maximum.reduceat(rough[:, by_id], starts, axis=1)
    last = np.partition(best, max(best.shape[1] - k, 0), axis=1)[:, max(best.shape[1] - k, 0)]
    at_q, at_v = np.nonzero((rough >= last[:, None] - 1e-9) & (rough > -np.inf))
    q, v = _near_one(q), _near_one(v)
    a, b = q[at_q], v[at_v]
    exact = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    out = pd.DataFrame({"query_id": q_id[at_q], "vec_id": v_id[at_v], "score": exact}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)
