"""Hand-computed cases of scores, peaks, geometry, thresholds, graphs and retrieval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelight.config import Config, load_config
from framelight.operators import graph, retrieval, scores, signals, split_rank, tiers


def frames(spark, values, config_values=None):
    rows = [(1, i, float(v), float(v), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "video_id long, frame_idx int, residual_energy double, motion_magnitude double, entropy double")


def peaks(df):
    return {r["frame_idx"]: r["persistence_value"] for r in df.filter("is_peak").collect()}


CONFIG = Config(peak_distance=2, peak_prominence=0.05, persistence_threshold=0.4)


def brute_peaks(x, config):
    """Persistence of the peaks of one video's scores, by the stated rules."""
    n, found = len(x), []
    for i in range(n):
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if (i == 0 or x[i - 1] != x[i]) and 0 < i and j < n - 1 and x[i - 1] < x[i] > x[j + 1]:
            found.append((i + j) // 2)
    kept = []
    for i in sorted(found, key=lambda i: (-x[i], -i)):
        if all(abs(i - k) >= config.peak_distance for k in kept):
            kept.append(i)
    out = {}
    for i in kept:
        left = min(x[k] for k in range(i, -1, -1) if max(x[k : i + 1]) <= x[i])
        right = min(x[k] for k in range(i, n) if max(x[i : k + 1]) <= x[i])
        prominence = x[i] - max(left, right)
        if prominence >= config.peak_prominence:
            out[i] = min(prominence / config.max_prominence, 1.0)
    return out


@pytest.mark.parametrize("config", [CONFIG, Config(peak_distance=5, persistence_threshold=0.15, max_prominence=2.0), Config(peak_distance=1, peak_prominence=0.0)])
def test_scores_equal_brute_force(spark, config):
    """Several videos, one longer than many batches, with ties and plateaus."""
    rng = np.random.default_rng(4)
    videos = {v: rng.integers(0, 9, n) / 8 for v, n in ((1, 1), (2, 2), (3, 60), (4, 400), (5, 33), (6, 3))}
    rows = [(v, i, float(s)) for v, x in videos.items() for i, s in enumerate(x)]
    given = spark.createDataFrame(rows, "video_id long, frame_idx int, entropy double").withColumns({"residual_energy": F.col("entropy"), "motion_magnitude": F.col("entropy")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = scores.score_frames(given, config).collect()
        left = scores.nms(scores.score_frames(given, config), 6).filter("is_peak").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(rows)
    for v in videos:
        x = [r["action_score"] for r in sorted((r for r in out if r["video_id"] == v), key=lambda r: r["frame_idx"])]
        values = brute_peaks(x, config)
        assert {r["frame_idx"]: r["persistence_value"] for r in out if r["video_id"] == v and r["persistence_value"] > 0} == pytest.approx({i: p for i, p in values.items() if p > 0})
        flagged = [i for i, p in values.items() if p >= config.persistence_threshold]
        assert sorted(r["frame_idx"] for r in out if r["video_id"] == v and r["is_peak"]) == sorted(flagged)
        kept = []
        for i in sorted(flagged, key=lambda i: (-x[i], i)):
            if all(abs(i - k) > 6 for k in kept):
                kept.append(i)
        assert sorted(r["frame_idx"] for r in left if r["video_id"] == v) == sorted(kept)


def test_flat_and_single_peaks(spark):
    assert peaks(scores.score_frames(frames(spark, [0.7] * 12), CONFIG)) == {}
    assert peaks(scores.score_frames(frames(spark, [0, 2, 5, 9, 6, 1, 0]), CONFIG)) == {3: 1.0}


def test_weak_peak_persistence(spark):
    scored = scores.action_score(frames(spark, [0, 0, 3, 0, 0, 0, 10, 0]), CONFIG)
    found = scores.persistence(scores.peak_prominence(scores.find_peaks(scored), scored), CONFIG)
    assert {r["frame_idx"]: round(r["persistence_value"], 6) for r in found.collect()} == {2: 0.6, 6: 1.0}


def test_plateaus_and_ends(spark):
    scored = frames(spark, [3, 3, 1, 2, 2, 1, 2, 2, 2, 0, 5]).withColumn("action_score", F.col("entropy"))
    assert sorted(r["frame_idx"] for r in scores.find_peaks(scored).collect()) == [3, 7]


def test_distance_and_window_edges(spark):
    at = spark.createDataFrame([(1, 0, 1.0), (1, 5, 1.0), (1, 9, 0.5)], "video_id long, frame_idx int, height double")
    assert sorted(r["frame_idx"] for r in scores.peak_distance(at, 5).collect()) == [0, 5]  # a gap of exactly 5 stays
    peaked = spark.createDataFrame([(1, 0, 1.0, True), (1, 10, 1.0, True), (1, 21, 0.5, True)], "video_id long, frame_idx int, action_score double, is_peak boolean")
    assert sorted(r["frame_idx"] for r in scores.nms(peaked, 10).filter("is_peak").collect()) == [0, 21]  # exactly 10 goes, the earlier of equals stays
    assert scores.nms(peaked, None).filter("is_peak").count() == 3


@pytest.mark.parametrize("n", [49, 50])
def test_normalize_branches(spark, n):
    """Below 50 frames the outlier sets the scale; from 50 on the percentiles do, and the rest is clipped."""
    values = list(range(n - 1)) + [1000]
    out = {r["frame_idx"]: r["n_entropy"] for r in scores.robust_normalize(frames(spark, values), ["entropy"]).collect()}
    assert out[n - 1] == 1.0 and out[0] == 0.0
    assert (out[47] > 0.05) == (n == 50)


def test_flat_signal(spark):
    assert {r["n_entropy"] for r in scores.robust_normalize(frames(spark, [0.3] * 5), ["entropy"]).collect()} == {0.0}


def vectors(spark, cells):
    rows = [(1, gx * 16 + 8, gy * 16 + 8, float(u), float(v)) for gx, gy, u, v in cells]
    return spark.createDataFrame(rows, "frame_key long, dst_x int, dst_y int, motion_x double, motion_y double")


def geometry(spark, cells):
    keys = spark.createDataFrame([(1,), (2,)], "frame_key long")
    return {r["frame_key"]: r for r in signals.motion_geometry(keys, vectors(spark, cells), 160, 160).collect()}


def test_geometry(spark):
    grid = [(x, y) for x in range(10) for y in range(10)]
    out = geometry(spark, [(x, y, 2 if x >= 5 else -2, 2 if y >= 5 else -2) for x, y in grid])
    assert out[1]["divergence"] > 0 and out[1]["curl"] == 0
    turn = geometry(spark, [(x, y, -(y - 4.5), x - 4.5) for x, y in grid])
    assert turn[1]["curl"] > 0 and abs(turn[1]["divergence"]) < 1e-5
    assert all(v == 0 for k, v in out[2].asDict().items() if k != "frame_key")


def test_geometry_equals_numpy(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(2, 10, 10))
    row = geometry(spark, [(x, y, u[y, x], v[y, x]) for x in range(10) for y in range(10)])[1]
    uy, ux = np.gradient(u)
    vy, vx = np.gradient(v)
    m = np.hypot(u, v)
    my, mx = np.gradient(m)
    mxy, mxx = np.gradient(mx)
    myy, myx = np.gradient(my)
    assert row["divergence"] == pytest.approx((ux + vy).mean())
    assert row["jacobian_frobenius"] == pytest.approx(np.sqrt(ux**2 + uy**2 + vx**2 + vy**2).mean())
    assert row["hessian_max_eigenvalue"] == pytest.approx((np.abs(mxx + myy) + np.sqrt(np.maximum(0, (mxx - myy) ** 2 + 4 * myx * mxy))).mean() / 2)
    p = np.histogram(m, 10, (0, m.max()))[0] / 100
    assert row["motion_entropy"] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum())


def tier_rows(spark, values, keys):
    rows = [(1, i, float(v), i in keys) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "video_id long, frame_idx int, residual_energy double, key_frame boolean")


def test_threshold_fallbacks(spark):
    found = {r["scene_id"]: r["source"] for r in tiers.scene_thresholds(tiers.scene_segment(tier_rows(spark, [1, 0.1, 0.2, 1, 1, 0.3], {3, 4}))).collect()}
    assert found == {1: "scene", 2: "video", 3: "scene"}
    fixed = tiers.scene_thresholds(tiers.scene_segment(tier_rows(spark, [1], {0}))).first()
    assert (fixed["salient_thresh"], fixed["candidate_thresh"]) == (0.35, 0.08)


def test_tier_edges(spark):
    rows = tier_rows(spark, [0.5, 0.35, 0.08, 0.07, 0.36, 0.36], set())
    out = tiers.classify_tiers(rows, Config(adaptive=False)).orderBy("frame_idx").collect()
    assert [r["tier"] for r in out] == ["SALIENT", "CANDIDATE", "CANDIDATE", "SKIP", "SALIENT", "SALIENT"]


def nodes(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "video_id long, frame_idx int, action_score double, persistence_value double, embedding array<double>")


def test_edges_and_pagerank(spark):
    two = nodes(spark, [(10, 0.9, 0.0, None), (20, 0.4, 0.0, None)])
    assert graph.edge_weights(two).first()["weight"] == 0.0
    rank = {r["frame_idx"]: r["pagerank_score"] for r in graph.pagerank(two).collect()}
    assert rank[10] == pytest.approx(0.9 / 1.3, abs=1e-4) and sum(rank.values()) == pytest.approx(1)
    assert graph.pagerank(nodes(spark, [(10, 0.9, 0.0, None)])).first()["pagerank_score"] == pytest.approx(1)
    equal = nodes(spark, [(1, 0.5, 0.0, None), (2, 0.5, 0.0, None), (3, 1.5, 0.0, None)])
    assert {(r["src"], r["dst"]): r["weight"] for r in graph.edge_weights(equal).collect()} == {(1, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0}
    both = nodes(spark, [(1, 0.8, 0.0, [1.0, 0.0]), (2, 0.4, 0.0, [0.6, 0.8])])
    assert graph.edge_weights(both, Config(alpha=0.4, beta=0.6)).first()["weight"] == pytest.approx(0.24)
    assert graph.pagerank(nodes(spark, [(1, 0.0, 0.0, None), (2, 0.0, 0.0, None)])).first()["pagerank_score"] == pytest.approx(0.5)


def test_retrieve_order(spark):
    config, query = Config(alpha=0.5, beta=0.5, gamma=0.0), spark.createDataFrame([([1.0, 0.0],)], "query_embedding array<double>")
    order = lambda rows: [r["frame_idx"] for r in retrieval.hybrid_retrieve(nodes(spark, rows), query, 3, config).orderBy("rank").collect()]
    assert order([(1, 0.1, 0.0, None), (2, 0.5, 0.0, None), (3, 0.9, 0.0, None)]) == [3, 2, 1]
    assert order([(1, 0.1, 0.0, [0.5, 0.866]), (2, 0.5, 0.0, None), (3, 0.9, 0.0, [0.9, 0.435])]) == [3, 1, 2]


def test_matrix(spark):
    rows = spark.createDataFrame([(1, 2, [1.0, 2.0], [0.5, 0.5, 0.5]), (1, 1, [1.0, 2.0], None)], "video_id long, frame_idx int, tensor array<double>, embedding array<double>")
    full = rows.withColumns({c: F.lit(0.0) for c in ("timestamp_sec", "action_score", "persistence_value", "residual_energy", "motion_magnitude", "entropy", "pagerank_score")})
    out = graph.export_matrix(full).orderBy("frame_idx").collect()
    assert [len(r["row"]) for r in out] == [13, 13] and out[0]["row"][10:] == [0, 0, 0]
    assert graph.export_matrix(full.filter("false")).count() == 0


def test_sample_count(spark):
    rows = spark.createDataFrame([(5, 2.0, 1.0), (7, 0.0, 1.0), (1, 100.0, 1.0)], "total long, fps double, rate double")
    assert [r[0] for r in rows.select(retrieval.uniform_sample_count(F.col("total"), F.col("fps"), F.col("rate"))).collect()] == [2, 7, 1]


def test_zero_norm_and_failures(spark):
    from framelight.functions.arrays import cosine

    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine("a", "b")).collect()] == [0.0, 0.0]
    broken = retrieval.embed(spark.createDataFrame([("x",)], "t string"), "t", lambda s: 1 / 0, size=4)
    assert broken.first()["embedding"] == [0.0] * 4


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"alpha": 0.9, "unknown": 1}')
    assert load_config(str(path)).alpha == 0.9 and load_config(str(tmp_path / "none")) == Config()
    for bad in ({"verify_low_thresh": 0.9}, {"l1_w_action": 0.9}, {"retrieval_strategy": "x"}, {"peak_distance": 0}):
        with pytest.raises(ValueError):
            Config(**bad).validate()


def dense_pagerank(score, vectors, config):
    """The stated rules on a written-out matrix, until the change is below n times 1e-6."""
    n, width = len(score), max(score) - min(score)
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            c = 1.0 if width == 0 else 1 - abs(score[i] - score[j]) / width
            if i != j:
                a, b = vectors[i], vectors[j]
                if a is None or b is None:
                    w[i, j] = c
                else:
                    size = np.linalg.norm(a) * np.linalg.norm(b)
                    w[i, j] = config.alpha * (np.dot(a, b) / size if size else 0.0) + config.beta * c
    seed = np.array(score) / sum(score)
    x = np.full(n, 1 / n)
    for _ in range(100):
        new = 0.15 * seed
        for i in range(n):
            new = new + 0.85 * x[i] * (w[i] / w[i].sum() if w[i].sum() else seed)
        if abs(new - x).sum() < n * 1e-6:
            return new
        x = new
    raise AssertionError("no convergence")


@pytest.mark.parametrize("share", [0.0, 0.6, 1.0])
def test_pagerank_equals_dense(spark, share):
    rng = np.random.default_rng(int(share * 10))
    score = [round(float(s), 2) for s in rng.random(40)]
    vectors = [[float(v) for v in rng.random(5)] if rng.random() < share else None for _ in score]
    vectors[3] = [0.0] * 5 if share else None
    got = graph.pagerank(nodes(spark, [(i, s, 0.0, v) for i, (s, v) in enumerate(zip(score, vectors, strict=True))])).orderBy("frame_idx").collect()
    assert [r["pagerank_score"] for r in got] == pytest.approx(list(dense_pagerank(score, vectors, Config())), abs=1e-9)


def test_pagerank_without_convergence(spark):
    """Seeds are given up where the rounds don't suffice."""
    rows = nodes(spark, [(i, s, 0.0, None) for i, s in enumerate([0.9, 0.1, 0.5, 0.3])])
    plain = graph.pagerank(rows, rounds=2, tolerance=1e-30).orderBy("frame_idx").collect()
    unseeded = graph.power_iteration(graph.CompleteGraph(np.array([0.9, 0.1, 0.5, 0.3]), np.zeros((4, 1)), np.zeros(4, bool), 0.4, 0.3), np.zeros(4), 2, None)
    assert [r["pagerank_score"] for r in plain] == pytest.approx(list(unseeded))


def test_cross_edges_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    score = [round(float(s), 4) for s in rng.random(50)]
    got = graph.cross_edges(nodes(spark, [(i, s, 0.0, None) for i, s in enumerate(score)])).collect()
    width = max(score) - min(score)
    expected = {(i, j) for i in range(50) for j in range(i + 2, 50) if 1 - abs(score[i] - score[j]) / width > 0.85}
    assert {(r["source"], r["target"]) for r in got} == expected and len(got) == len(expected)


def test_missing_scores_and_finds(spark):
    out = spark.createDataFrame([(1, 0), (1, 1)], "video_id long, frame_idx int")
    some = spark.createDataFrame([(1, 0, 0.5, True, 0.4), (1, 9, 0.1, True, 0.2)], "video_id long, frame_idx int, action_score double, is_peak boolean, persistence_value double")
    assert [tuple(r)[2:] for r in signals.join_scores(out, some).orderBy("frame_idx").collect()] == [(0.5, True, 0.4), (0.0, False, 0.0)]
    found = spark.createDataFrame([(1, 1, [1.0]), (1, 7, [2.0])], "video_id long, frame_idx int, embedding array<double>")
    assert [(r["embedding"], r["triples"]) for r in graph.enrich(out, found).orderBy("frame_idx").collect()] == [(None, None), ([1.0], [])]
    with pytest.raises(KeyError):
        graph.enrich(out, found, strict=True)


def test_one_failing_row_spares_its_batch(spark):
    def model(values):
        if (values == "bad").any():
            raise ValueError("bad")
        return [[3.0, 4.0]] * len(values)

    rows = retrieval.embed(spark.createDataFrame([("a",), ("bad",), ("b",)], "t string").coalesce(1), "t", model, size=2)
    assert {r["t"]: r["embedding"] for r in rows.collect()} == {"a": [0.6, 0.8], "bad": [0.0, 0.0], "b": [0.6, 0.8]}


def random_nodes(spark, n, seed=5, videos=(1, 2)):
    rng = np.random.default_rng(seed)
    rows = []
    for video in videos:
        for frame in sorted(rng.choice(n * 3, n, replace=False).tolist()):
            e = None if rng.random() < 0.1 else [float(x) for x in rng.normal(size=4 if rng.random() < 0.9 else 3)]
            rows.append((video, frame, float(rng.random()), [0.0] * 4 if rng.random() < 0.05 else e))
    return rows, spark.createDataFrame(rows, "video_id long, frame_idx int, action_score double, embedding array<double>")


@pytest.mark.parametrize("size", [1, 7, 256])
def test_tiles_give_every_pair_once(spark, size):
    from itertools import combinations

    rows, nodes = random_nodes(spark, 60)
    expected = {}
    for video in (1, 2):
        mine = [r for r in rows if r[0] == video]
        low, high = min(r[2] for r in mine), max(r[2] for r in mine)
        for a, b in combinations(mine, 2):
            steady = 1 - abs(a[2] - b[2]) / (high - low)
            weight = steady
            if a[3] is not None and b[3] is not None:
                x, y = np.array(a[3]), np.array(b[3])
                lengths = np.linalg.norm(x) * np.linalg.norm(y)
                weight = 0.4 * (float(x @ y / lengths) if len(x) == len(y) and lengths else 0.0) + 0.6 * steady
            expected[video, a[1], b[1]] = weight
    found = graph.edge_weights(nodes, Config(alpha=0.4, beta=0.6), size).collect()
    assert len(found) == len(expected)
    assert {(r["video_id"], r["src"], r["dst"]): r["weight"] for r in found} == pytest.approx(expected, abs=1e-12)


def test_tiles_are_small_and_spread(spark):
    from framelight.operators import tiles

    _, nodes = random_nodes(spark, 900, videos=(1,))
    sizes = [r["count"] for r in tiles.tiled(nodes, 64).groupBy("video_id", "tile").count().collect()]
    assert max(sizes) <= 2 * 64 - 1 and sum(sizes) == 900 and len(sizes) >= 900 // 127
    assert graph.edge_weights(nodes.filter("false")).count() == 0
    some = spark.createDataFrame([(1, 5, None, None), (1, 9, 0.5, None), (1, 11, 0.7, None)], nodes.schema)
    assert {(r["src"], r["dst"]): r["coherence"] for r in graph.motion_coherence(some).collect()} == {(5, 9): None, (5, 11): None, (9, 11): 0.0}


@pytest.mark.parametrize("seed", [0, 1])
def test_cut_videos_equal_the_walk_over_whole_ones(spark, seed):
    """Videos of 64 ranges with plateaus over cuts, gaps in frame numbers, rises, falls and long chains of peaks."""
    from framelight.operators import cut_videos

    rng, rows = np.random.default_rng(seed), []
    for video, x in enumerate([
        rng.random(1024), np.round(rng.random(1024), 1), np.repeat(np.round(rng.random(40), 1), rng.integers(1, 60, 40))[:1024], np.sin(np.arange(1024) / 40), np.arange(1024) / 1024, -np.arange(1024) / 1024,
        np.where(np.arange(1024) % 2, np.arange(1024), 0) / 1024, np.zeros(1024), rng.random(3), rng.random(1),
    ]):
        frames = np.arange(len(x)) if video % 2 == 0 else np.sort(rng.choice(2 * len(x), len(x), replace=False))
        rows += [(video, int(f), float(v)) for f, v in zip(frames, x, strict=True)]
    acted = spark.createDataFrame(rows, "video_id long, frame_idx int, action_score double")
    same = lambda a, b, *c: sorted(map(tuple, a.select(*c).collect())) == sorted(map(tuple, b.select(*c).collect()))
    peaks, cut = scores.find_peaks(acted), cut_videos.find_peaks(acted, 16)
    assert same(peaks, cut, "video_id", "frame_idx", "height")
    for gap in (1, 5, 40):
        kept, cut_kept = scores.peak_distance(peaks, gap), cut_videos.peak_distance(cut, gap, 16)
        assert same(kept, cut_kept, "video_id", "frame_idx", "height")
    whole = acted.select("video_id", "frame_idx")
    kept = scores.peak_distance(peaks, 5).join(whole, ["video_id", "frame_idx"], "left_semi")
    assert same(scores.peak_prominence(kept, acted), cut_videos.peak_prominence(kept, acted, 16), "video_id", "frame_idx", "height", "prominence")
    marked = acted.withColumn("is_peak", F.col("frame_idx") % 3 != 0)
    for window in (0, 3, 10):
        assert same(scores.nms(marked, window), cut_videos.nms(marked, window, 16), "video_id", "frame_idx", "is_peak")


def test_cut_suppression_settles_most_ranges_alone():
    from framelight.operators import cut_videos

    rng = np.random.default_rng(3)
    places = np.sort(rng.choice(3000, 1500, replace=False))
    height = rng.random(1500)
    order = np.lexsort((-places, -height))
    stays = scores.spaced(places, order, 5)
    inside = (places >= 1000) & (places < 2000)
    near = (places >= 900) & (places < 2100)
    sub = np.lexsort((-places[near], -height[near]))
    sure = cut_videos.certain(places[near], sub, 5, 900, 2100)[inside[near]]
    assert (sure >= 0).all() and (sure.astype(bool) == stays[inside]).all()


def test_pagerank_of_vectors_of_different_lengths(spark):
    _, nodes = random_nodes(spark, 40, videos=(1,))
    rows = nodes.orderBy("frame_idx").collect()
    edges = {(r["src"], r["dst"]): r["weight"] for r in graph.edge_weights(nodes).collect()}
    n = len(rows)
    w = np.zeros((n, n))
    for i, a in enumerate(rows):
        for j in range(i + 1, n):
            w[i, j] = w[j, i] = edges[a["frame_idx"], rows[j]["frame_idx"]]
    seed = np.array([r["action_score"] for r in rows])
    step, x = w / w.sum(1, keepdims=True), np.full(n, 1 / n)
    for _ in range(60):
        x = 0.85 * (x @ step) + 0.15 * seed / seed.sum()
    found = {r["frame_idx"]: r["pagerank_score"] for r in graph.pagerank(nodes, tolerance=None).collect()}
    assert [found[r["frame_idx"]] for r in rows] == pytest.approx(x, abs=1e-9)


@pytest.mark.parametrize("size", [2, 16])
def test_pagerank_of_cut_videos(spark, size):
    """Ranges of any size give the ranks of the whole: ties, repeated frames, nulls, unlike and zero vectors, one node, no scores."""
    rng = np.random.default_rng(size)
    rows = []
    for video, n in ((1, 48), (2, 1), (3, 30), (4, 2), (5, 25)):
        for i in range(n):
            score = 0.0 if video == 4 else 0.5 if video == 5 else round(float(rng.random()), 1)
            vector = [float(v) for v in rng.random(3 + i % 2)] if rng.random() < 0.7 else None
            rows.append((video, i // 2 if video == 3 else i, None if i == 7 else score, [0.0] * 3 if i == 9 else [] if i == 11 else vector))
    nodes = spark.createDataFrame(rows, "video_id long, frame_idx int, action_score double, embedding array<double>").repartition(5)
    ranked = lambda found: sorted((r["video_id"], r["frame_idx"], r["pagerank_score"]) for r in found.collect())
    whole, cut = ranked(graph.pagerank(nodes)), ranked(split_rank.pagerank(nodes, size=size))
    assert [r[:2] for r in cut] == [r[:2] for r in whole] and len(cut) == len(rows)
    assert [r[2] for r in cut] == pytest.approx([r[2] for r in whole], abs=1e-9)


def test_pagerank_of_cut_videos_without_convergence(spark):
    nodes = spark.createDataFrame([(1, i, s, None) for i, s in enumerate([0.9, 0.1, 0.5, 0.3])] + [(2, 0, 1.0, None)], "video_id long, frame_idx int, action_score double, embedding array<double>")
    ranked = lambda found: [r["pagerank_score"] for r in found.orderBy("video_id", "frame_idx").collect()]
    assert ranked(split_rank.pagerank(nodes, rounds=2, tolerance=1e-30, size=2)) == pytest.approx(ranked(graph.pagerank(nodes, rounds=2, tolerance=1e-30)))
    assert split_rank.pagerank(nodes.limit(0)).count() == 0


def test_a_range_of_a_cut_video_is_one_row(spark):
    rows = [(v, i, float(i % 5), None if i == 3 else [1.0, float(i)]) for v in range(4) for i in range(10)]
    cut = split_rank.ranges(spark.createDataFrame(rows, "video_id long, frame_idx int, action_score double, embedding array<double>").coalesce(1), 4)
    found = cut.collect()
    assert sorted((r["video_id"], f, s) for r in found for f, s in zip(r["frames"], r["scores"], strict=True)) == sorted((v, f, s) for v, f, s, _ in rows)
    assert len({(r["video_id"], r["block"]) for r in found}) == len(found) < len(rows)
    assert all(r["scores"] == sorted(r["scores"]) and len(r["frames"]) <= 4 and len(r["unit"]) == 2 * len(r["frames"]) for r in found)
