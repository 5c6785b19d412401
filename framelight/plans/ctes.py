"""Shared CTEs of the SQL oracles: the canonical tables and intermediate results."""

from __future__ import annotations

FRAMES = """frames AS (
  SELECT user_id AS video_id, (row_number() OVER w - 1)::INT AS frame_idx,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS timestamp_sec,
    event_type = 'signup' AS key_frame, coalesce(abs(value - lag(value) OVER w) / 600, 1.0) AS residual_energy,
    json_extract_string(props, '$.k')::DOUBLE AS motion_magnitude, ((event_id * 37) % 101)::DOUBLE / 101 AS entropy, event_id, event_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

EMBEDDED = f"""{FRAMES},
embedded AS (SELECT video_id, frame_idx, embedding::DOUBLE[] AS embedding FROM frames JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings))"""


def quantile(a: str, p: float) -> str:
    at = f"((len({a}) - 1) * {p}::DOUBLE)"
    return f"({a}[floor({at})::INT + 1] + ({a}[ceil({at})::INT + 1] - {a}[floor({at})::INT + 1]) * ({at} - floor({at})))"


SCENES = f"""{FRAMES},
scened AS (SELECT *, (sum((key_frame OR frame_idx = 0)::INT) OVER (PARTITION BY video_id ORDER BY frame_idx))::INT AS scene_id, key_frame OR frame_idx = 0 AS scene_start FROM frames),
own AS (SELECT video_id, scene_id, list_sort(list(residual_energy) FILTER (WHERE NOT scene_start)) AS a FROM scened GROUP BY ALL),
whole AS (SELECT video_id, list_sort(list(residual_energy) FILTER (WHERE NOT key_frame)) AS b FROM scened GROUP BY ALL),
thresholds AS (SELECT video_id, scene_id,
  CASE WHEN len(a) > 0 THEN greatest(0.002, {quantile("a", 0.95)}) WHEN len(b) > 0 THEN greatest(0.002, {quantile("b", 0.95)}) ELSE 0.35 END AS salient_thresh,
  CASE WHEN len(a) > 0 THEN greatest(0.001, {quantile("a", 0.9)}) WHEN len(b) > 0 THEN greatest(0.001, {quantile("b", 0.9)}) ELSE 0.08 END AS candidate_thresh,
  CASE WHEN len(a) > 0 THEN 'scene' WHEN len(b) > 0 THEN 'video' ELSE 'fixed' END AS source
  FROM own JOIN whole USING (video_id))"""


def _tiered(source: str) -> str:
    return f"""peaked AS (SELECT *, coalesce(residual_energy > max(residual_energy) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
    AND residual_energy > max(residual_energy) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AND residual_energy >= salient_thresh, false) AS tier_peak
  FROM ({source}) WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)),
tiered AS (SELECT *, CASE WHEN key_frame THEN 'I_FRAME' WHEN tier_peak THEN 'PEAK' WHEN residual_energy > salient_thresh THEN 'SALIENT'
  WHEN residual_energy >= candidate_thresh THEN 'CANDIDATE' ELSE 'SKIP' END AS tier FROM peaked)"""


TIERED = f"{SCENES},\n{_tiered('SELECT * FROM scened JOIN thresholds USING (video_id, scene_id)')}"
FIXED_TIERED = f"{FRAMES},\n{_tiered('SELECT *, 0.35::DOUBLE AS salient_thresh, 0.08::DOUBLE AS candidate_thresh FROM frames')}"

_SIGNALS = ("residual_energy", "motion_magnitude", "entropy")

NORMALIZED = FRAMES + ",\nlists AS (SELECT video_id, " + ", ".join(f"list_sort(list({c})) AS l_{c}" for c in _SIGNALS) + " FROM frames GROUP BY video_id),\nbounds AS (SELECT video_id, " + ", ".join(
    f"CASE WHEN len(l_{c}) >= 50 THEN {quantile(f'l_{c}', 0.02)} ELSE l_{c}[1] END AS lo_{c}, CASE WHEN len(l_{c}) >= 50 THEN {quantile(f'l_{c}', 0.98)} ELSE l_{c}[-1] END AS hi_{c}" for c in _SIGNALS
) + " FROM lists),\nnormalized AS (SELECT frames.*, " + ", ".join(
    f"CASE WHEN hi_{c} - lo_{c} < 1e-8 THEN 0.0 ELSE least(greatest(({c} - lo_{c}) / (hi_{c} - lo_{c}), 0.0), 1.0) END AS n_{c}" for c in _SIGNALS
) + " FROM frames JOIN bounds USING (video_id))"

ACTION = f"""{NORMALIZED},
acted AS (SELECT * EXCLUDE (n_residual_energy, n_motion_magnitude, n_entropy),
  least(greatest((0.0 + 0.5::DOUBLE * n_residual_energy + 0.3::DOUBLE * n_motion_magnitude + 0.2::DOUBLE * n_entropy) / 1.0::DOUBLE, 0.0), 1.0) AS action_score FROM normalized)"""

PEAKS = f"""{ACTION},
marked AS (SELECT *, sum(changed) OVER (PARTITION BY video_id ORDER BY frame_idx) AS run FROM
  (SELECT video_id, frame_idx, action_score, coalesce((action_score <> lag(action_score) OVER (PARTITION BY video_id ORDER BY frame_idx))::INT, 1) AS changed FROM acted)),
runs AS (SELECT video_id, run, min(frame_idx) AS s, max(frame_idx) AS e, first(action_score) AS height FROM marked GROUP BY ALL),
peaks AS (SELECT video_id, ((s + e) // 2)::INT AS frame_idx, height FROM (SELECT *, lag(height) OVER w AS b, lead(height) OVER w AS a FROM runs WINDOW w AS (PARTITION BY video_id ORDER BY run)) WHERE height > b AND height > a)"""

SPACED = f"""{PEAKS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY height DESC, frame_idx DESC) AS rn FROM peaks),
fold AS (SELECT video_id, 0::BIGINT AS rn, []::INT[] AS kept FROM (SELECT DISTINCT video_id FROM peaks)
  UNION ALL SELECT f.video_id, r.rn, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - r.frame_idx) < 5)) > 0 THEN f.kept ELSE list_append(f.kept, r.frame_idx) END
  FROM fold f JOIN ranked r ON r.video_id = f.video_id AND r.rn = f.rn + 1),
kept AS (SELECT video_id, unnest(arg_max(kept, rn)) AS frame_idx FROM fold GROUP BY video_id),
spaced AS (SELECT peaks.* FROM peaks JOIN kept USING (video_id, frame_idx))"""

PROMINENT = f"""{SPACED},
ends AS (SELECT p.video_id, p.frame_idx, p.height, max(CASE WHEN s.frame_idx < p.frame_idx AND s.action_score > p.height THEN s.frame_idx END) AS le,
  min(CASE WHEN s.frame_idx > p.frame_idx AND s.action_score > p.height THEN s.frame_idx END) AS re FROM spaced p JOIN acted s ON s.video_id = p.video_id GROUP BY ALL),
prominent AS (SELECT e.video_id, e.frame_idx, e.height, e.height - greatest(
  min(CASE WHEN s.frame_idx <= e.frame_idx AND s.frame_idx > coalesce(le, -1) THEN s.action_score END),
  min(CASE WHEN s.frame_idx >= e.frame_idx AND (re IS NULL OR s.frame_idx < re) THEN s.action_score END)) AS prominence
  FROM ends e JOIN acted s ON s.video_id = e.video_id GROUP BY e.video_id, e.frame_idx, e.height)"""

SCORED = f"""{PROMINENT},
scored AS (SELECT acted.*, CASE WHEN prominence IS NULL THEN 0.0 ELSE least(prominence / 0.5::DOUBLE, 1.0) END AS persistence_value, CASE WHEN prominence IS NULL THEN 0.0 ELSE least(prominence / 0.5::DOUBLE, 1.0) END >= 0.4 AS is_peak
  FROM acted LEFT JOIN (SELECT * FROM prominent WHERE prominence >= 0.05) USING (video_id, frame_idx))"""

NMS = f"""{SCORED},
nranked AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY action_score DESC, frame_idx) AS rn FROM scored WHERE is_peak),
nfold AS (SELECT video_id, 0::BIGINT AS rn, []::INT[] AS kept FROM (SELECT DISTINCT video_id FROM nranked)
  UNION ALL SELECT f.video_id, r.rn, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - r.frame_idx) <= 10)) > 0 THEN f.kept ELSE list_append(f.kept, r.frame_idx) END
  FROM nfold f JOIN nranked r ON r.video_id = f.video_id AND r.rn = f.rn + 1),
nkept AS (SELECT video_id, unnest(arg_max(kept, rn)) AS frame_idx FROM nfold GROUP BY video_id),
nmsed AS (SELECT scored.* EXCLUDE (is_peak), nkept.frame_idx IS NOT NULL AS is_peak FROM scored LEFT JOIN nkept USING (video_id, frame_idx))"""

NODES = f"{NMS},\nembedded AS (SELECT video_id, frame_idx, embedding::DOUBLE[] AS embedding FROM frames JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)),\nnodes AS (SELECT nmsed.*, embedding FROM nmsed JOIN embedded USING (video_id, frame_idx)),\nranges AS (SELECT video_id, min(action_score) AS low, max(action_score) AS high FROM nodes GROUP BY video_id)"

EDGES = f"""{NODES},
edges AS (SELECT a.video_id, a.frame_idx AS src, b.frame_idx AS dst,
  0.4::DOUBLE * list_cosine_similarity(a.embedding, b.embedding) + 0.3::DOUBLE * CASE WHEN high = low THEN 1.0 ELSE 1 - abs(a.action_score - b.action_score) / (high - low) END AS weight
  FROM nodes a JOIN nodes b ON a.video_id = b.video_id AND a.frame_idx < b.frame_idx JOIN ranges r ON r.video_id = a.video_id)"""

GRID = """mv AS (SELECT l_orderkey AS frame_key, (l_partkey % 160)::INT AS dst_x, (l_suppkey % 160)::INT AS dst_y, l_quantity - 25 AS motion_x, (l_linenumber - 4)::DOUBLE AS motion_y FROM lineitem),
means AS (SELECT frame_key, dst_x // 16 AS gx, dst_y // 16 AS gy, avg(motion_x) AS u, avg(motion_y) AS v FROM mv GROUP BY ALL),
grid AS (SELECT frame_key, gx::INT AS gx, gy::INT AS gy, coalesce(u, 0.0) AS u, coalesce(v, 0.0) AS v
  FROM (SELECT DISTINCT frame_key FROM mv) CROSS JOIN range(10) x(gx) CROSS JOIN range(10) y(gy) LEFT JOIN means USING (frame_key, gx, gy))"""


def gradient(c: str, axis: str) -> str:
    w = f"(PARTITION BY frame_key, {'gy' if axis == 'gx' else 'gx'} ORDER BY {axis})"
    return f"CASE WHEN lag({c}) OVER {w} IS NULL THEN lead({c}) OVER {w} - {c} WHEN lead({c}) OVER {w} IS NULL THEN {c} - lag({c}) OVER {w} ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END"


FIELDS = f"""{GRID},
sized AS (SELECT *, sqrt(u * u + v * v) AS m FROM grid),
slopes AS (SELECT *, {", ".join(f"{gradient(c, 'g' + a)} AS {c}_{a}" for c in "uvm" for a in "xy")} FROM sized),
fields AS (SELECT *, {", ".join(f"{gradient('m_' + a, 'g' + b)} AS m_{a}{b}" for a in "xy" for b in "xy")} FROM slopes)"""

CLAIMS = r"""parts AS (SELECT conv_id AS run_id, turn, unnest(regexp_split_to_array(text, '[.?]\s')) AS s, unnest(range(len(regexp_split_to_array(text, '[.?]\s')))) AS at_ FROM conversations WHERE role = 'assistant'),
claims AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY turn, at_) - 1 AS pos, trim(s) AS text FROM parts WHERE trim(s) <> ''),
facts AS (SELECT conv_id AS run_id, turn AS pos, text FROM conversations WHERE role = 'user')"""
