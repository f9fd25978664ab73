"""SQL of the queries, written apart from the operators, for an engine that checks them."""

from __future__ import annotations

SQL: dict[str, str] = {}

_EV = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

SQL["episode_windows_truncate"] = f"""
WITH a AS (SELECT event_id, [value, lead(value, 2) OVER w, lead(value, 4) OVER w, lead(value, 6) OVER w] AS v FROM events {_EV})
SELECT event_id, CAST(k AS INT) AS k, round(v[k + 1], 6) AS x FROM a, unnest(range(0, 4)) AS t(k) WHERE v[k + 1] IS NOT NULL"""

SQL["episode_windows_history_repeat"] = f"""
WITH a AS (SELECT event_id, [coalesce(lag(value, 4) OVER w, first_value(value) OVER f), coalesce(lag(value, 2) OVER w, first_value(value) OVER f), value] AS v FROM events {_EV})
SELECT event_id, CAST(k AS INT) AS k, round(v[k + 1], 6) AS x FROM a, unnest(range(0, 3)) AS t(k)"""

SQL["episode_windows_quality_cut"] = f"""
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS hq FROM events), a AS (
  SELECT event_id, hq, last_value(value) OVER f AS last, [value, lead(value, 2) OVER w, lead(value, 4) OVER w, lead(value, 6) OVER w] AS v,
    [hq, lead(hq, 2) OVER w, lead(hq, 4) OVER w, lead(hq, 6) OVER w] AS q FROM e {_EV}
), b AS (SELECT *, coalesce(list_position(q, 0), 5) AS cut FROM a WHERE hq = 1)
SELECT event_id, CAST(k AS INT) AS k, round(coalesce(v[k + 1], last), 6) AS x FROM b, unnest(range(0, 4)) AS t(k)
WHERE k + 1 < cut"""

SQL["episode_windows_future_repeat"] = f"""
WITH a AS (SELECT event_id, last_value(value) OVER f AS last, [lead(value, 2) OVER w, lead(value, 4) OVER w, lead(value, 6) OVER w] AS v FROM events {_EV})
SELECT event_id, CAST(k AS INT) AS k, round(coalesce(v[k + 1], last), 6) AS x FROM a, unnest(range(0, 3)) AS t(k)"""

SQL["episode_segmentation"] = """
WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_event FROM b GROUP BY ALL"""

SQL["window_counts_by_episode"] = """
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS hq, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, [hq, lead(hq, 2) OVER w, lead(hq, 4) OVER w, lead(hq, 6) OVER w] AS h FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, 1 + CAST(i > 2 AS INT) + CAST(i > 4 AS INT) AS s, least(coalesce(list_position(h, 0) - 1, 4), 1 + (n - i) // 2, 4) AS a FROM q WHERE hq = 1)
SELECT user_id AS episode_index, count(*) AS anchors, CAST(sum(s) AS BIGINT) AS n_states, CAST(sum(a) AS BIGINT) AS n_actions, CAST(sum(a) AS BIGINT) AS n_valid FROM c GROUP BY user_id"""

_MELT = "m AS (SELECT 0 AS dim, CAST(l_quantity AS DOUBLE) AS x FROM lineitem UNION ALL SELECT 1, l_extendedprice FROM lineitem UNION ALL SELECT 2, l_discount FROM lineitem UNION ALL SELECT 3, l_tax FROM lineitem)"
_STATS = "s AS (SELECT dim, count(x) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM m GROUP BY dim)"
_LIMITS = "p AS (SELECT *, 2 / CASE WHEN q99 - q01 < 1e-4 THEN 2 ELSE q99 - q01 END AS scale, CASE WHEN q99 - q01 < 1e-4 THEN 0 - q01 ELSE -1 - 2 / (q99 - q01) * q01 END AS off FROM s)"
_GAUSS = "p AS (SELECT *, 1 / CASE WHEN std < 1e-4 THEN 1 ELSE std END AS scale, -mean / CASE WHEN std < 1e-4 THEN 1 ELSE std END AS off FROM s)"
_SHOW = "round(lo, 6) AS min, round(hi, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std, round(q01, 6) AS q01, round(q99, 6) AS q99"

SQL["normalizer_fit_limits"] = f'WITH {_MELT}, {_STATS}, {_LIMITS} SELECT dim, {_SHOW}, round(scale, 6) AS scale, round(off, 6) AS "offset" FROM p'
SQL["normalizer_fit_gaussian"] = f'WITH {_MELT}, {_STATS}, {_GAUSS} SELECT dim, round(scale, 6) AS scale, round(off, 6) AS "offset" FROM p'
SQL["normalizer_fit_no_offset"] = f"""WITH {_MELT}, {_STATS}
SELECT dim, round(CASE WHEN greatest(abs(q01), abs(q99)) < 1e-4 THEN 1 ELSE 1 / greatest(abs(q01), abs(q99)) END, 6) AS scale, 0.0::DOUBLE AS "offset" FROM s"""
SQL["normalize_roundtrip"] = f"""WITH {_MELT}, {_STATS}, {_LIMITS}, y AS (SELECT m.dim, x, x * scale + off AS y, scale, off FROM m JOIN p USING (dim))
SELECT dim, count(*) AS n, round(avg(y), 6) AS mean_y, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(max(abs((y - off) / scale - x)), 6) AS max_error FROM y GROUP BY dim"""
SQL["vector_stats_per_dim"] = f"""WITH m AS (SELECT CAST(k - 1 AS INT) AS dim, CAST(embedding[k] AS DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS t(k)), {_STATS}, {_LIMITS}
SELECT dim, {_SHOW}, CASE WHEN dim BETWEEN 6 AND 17 THEN 1.0 ELSE round(scale, 6) END AS scale, CASE WHEN dim BETWEEN 6 AND 17 THEN 0.0 ELSE round(off, 6) END AS "offset", dim BETWEEN 6 AND 17 AS ignored FROM p"""
SQL["post_normalize_outliers"] = f"""WITH {_MELT}, {_STATS}, {_GAUSS}, y AS (SELECT m.dim, x * scale + off AS y FROM m JOIN p USING (dim))
SELECT dim, count(*) AS n, count(*) FILTER (abs(y) > 1.5) AS n_outliers, round(max(abs(y)), 6) AS max_abs FROM y GROUP BY dim"""

SQL["instruction_gate"] = """
WITH i AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN ['', 'none', 'TODO', ' n/a '][(doc_id // 50) % 4 + 1] ELSE text END AS t FROM documents)
SELECT doc_id, coalesce(lower(trim(t, ' ')) IN ('', 'none', 'unknown', 'n/a', 'null', 'todo'), true) AS skipped FROM i"""

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_PAIRS = _V + ", pr AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM v)"


def _sum(xs) -> str:
    return "(" + " + ".join(xs) + ")"


def _rot_fails(a: str, at: int, threshold: float) -> str:
    x, y = [f"{a}[{at + k}]" for k in range(1, 4)], [f"{a}[{at + k}]" for k in range(4, 7)]
    inner, nx, ny = _sum(f"{p} * {q}" for p, q in zip(x, y)), _sum(f"{p} * {p}" for p in x), _sum(f"{p} * {p}" for p in y)
    return f"abs({inner} / ((sqrt({nx}) + 1e-8) * (sqrt({ny}) + 1e-8))) > {threshold}"


def _det(a: str, at: int) -> str:
    e = lambda i, j: f"{a}[{at + 4 * i + j + 1}]"
    return f"({e(0, 0)} * ({e(1, 1)} * {e(2, 2)} - {e(1, 2)} * {e(2, 1)}) - {e(0, 1)} * ({e(1, 0)} * {e(2, 2)} - {e(1, 2)} * {e(2, 0)}) + {e(0, 2)} * ({e(1, 0)} * {e(2, 1)} - {e(1, 1)} * {e(2, 0)}))"


SQL["quality_reason_counts"] = f"""WITH {_V} SELECT CASE WHEN v[45] = 0 OR v[46] = 0 THEN 'intrinsic' WHEN {_rot_fails("v", 6, 0.6)} THEN 'rot6d_left' WHEN {_rot_fails("v", 12, 0.6)} THEN 'rot6d_right' WHEN abs({_det("v", 48)}) > 0.001 THEN 'determinant' ELSE 'extrinsic' END AS reason, count(*) AS n FROM v GROUP BY 1"""
SQL["rot6d_orthogonality"] = f"WITH {_V} SELECT vec_id, {_rot_fails('v', 6, 0.1)} OR {_rot_fails('v', 12, 0.1)} AS skipped FROM v"


def _distance(start: int, size: int) -> str:
    return "sqrt" + _sum(f"(v[{k}] - n[{k}]) * (v[{k}] - n[{k}])" for k in range(start + 1, start + size + 1))


def _columns(a: str, at: int, name: str) -> list[str]:
    """CTE columns of a rotation whose columns are normalized apart: {name}x, {name}y, {name}z as lists."""
    x = "[" + ", ".join(f"{a}[{at + k}] / (sqrt{_sum(f'{a}[{at + j}] * {a}[{at + j}]' for j in range(1, 4))} + 1e-8)" for k in range(1, 4)) + "]"
    y = "[" + ", ".join(f"{a}[{at + k}] / (sqrt{_sum(f'{a}[{at + j}] * {a}[{at + j}]' for j in range(4, 7))} + 1e-8)" for k in range(4, 7)) + "]"
    return [f"{x} AS {name}x", f"{y} AS {name}y"]


def _cross(a: str, b: str) -> str:
    return f"[{a}[2] * {b}[3] - {a}[3] * {b}[2], {a}[3] * {b}[1] - {a}[1] * {b}[3], {a}[1] * {b}[2] - {a}[2] * {b}[1]]"


def _angle(p: str, q: str) -> str:
    trace = _sum(f"{p}{c}[{k}] * {q}{c}[{k}]" for c in "xyz" for k in (1, 2, 3))
    return f"acos(greatest(-1, least(1, (greatest(-1, least(3, {trace})) - 1) / 2)))"


_FOUR = [("v", 6, "e"), ("n", 6, "f"), ("v", 12, "g"), ("n", 12, "h")]
SQL["frame_delta_gate"] = f"""WITH {_PAIRS}, r AS (SELECT *, {", ".join(c for x in _FOUR for c in _columns(*x))} FROM pr WHERE n IS NOT NULL),
z AS (SELECT *, {", ".join(f"{_cross(n + 'x', n + 'y')} AS {n}w" for _, _, n in _FOUR)} FROM r),
u AS (SELECT *, {", ".join(f"list_transform({n}w, lambda t: t / (sqrt({n}w[1] * {n}w[1] + {n}w[2] * {n}w[2] + {n}w[3] * {n}w[3]) + 1e-8)) AS {n}z" for _, _, n in _FOUR)} FROM z)
SELECT vec_id, round({_distance(0, 6)}, 6) AS translation, round({_sum(_distance(18 + 3 * k, 3) for k in range(10))} / 10, 6) AS fingertips, round(greatest({_angle("e", "f")}, {_angle("g", "h")}), 6) AS rotation FROM u"""

SQL["skip_ratio"] = """SELECT count(*) AS seen, count(*) FILTER (coalesce(quality = 0, false)) AS skipped, round(100.0 * count(*) FILTER (coalesce(quality = 0, false)) / count(*), 6) AS percent FROM documents LEFT JOIN labels USING (doc_id)"""


def _gram(a: str, at: int, n: str) -> str:
    """CTE chain steps (select lists) for the Gram-Schmidt columns {n}1, {n}2, {n}3 of six numbers."""
    first = "[" + ", ".join(f"{a}[{at + k}] / greatest(1e-12, sqrt{_sum(f'{a}[{at + j}] * {a}[{at + j}]' for j in range(1, 4))})" for k in range(1, 4)) + "]"
    return first


def _steps(source: str, parts: list[tuple[str, int, str]], last: str) -> str:
    """CTEs from source to last that add the columns {n}1, {n}2, {n}3 of each part (array, place, n)."""
    one = ", ".join(f"{_gram(a, at, n)} AS {n}1" for a, at, n in parts)
    two = ", ".join("[" + ", ".join(f"{a}[{at + 3 + k}] - {_sum(f'{n}1[{j}] * {a}[{at + 3 + j}]' for j in (1, 2, 3))} * {n}1[{k}]" for k in (1, 2, 3)) + f"] AS {n}0" for a, at, n in parts)
    three = ", ".join(f"list_transform({n}0, lambda t: t / greatest(1e-12, sqrt({n}0[1] * {n}0[1] + {n}0[2] * {n}0[2] + {n}0[3] * {n}0[3]))) AS {n}2" for _, _, n in parts)
    four = ", ".join(f"{_cross(n + '1', n + '2')} AS {n}3" for _, _, n in parts)
    return f"{last}_1 AS (SELECT *, {one} FROM {source}), {last}_2 AS (SELECT *, {two} FROM {last}_1), {last}_3 AS (SELECT *, {three} FROM {last}_2), {last} AS (SELECT *, {four} FROM {last}_3)"


SQL["rot6d_matrix"] = f"WITH {_V}, {_steps('v', [('v', 6, 'l')], 'g')} SELECT vec_id, " + ", ".join(f"round(l{j + 1}[{i + 1}], 6) AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM g"
SQL["wrist_to_camera"] = f"WITH {_V} SELECT vec_id, " + ", ".join(f"round({_sum([*(f'v[{49 + 4 * i + k}] * v[{3 * h + k + 1}]' for k in range(3)), f'v[{49 + 4 * i + 3}]'])}, 6) AS x{3 * h + i}" for h in range(2) for i in range(3)) + " FROM v"
SQL["relative_action_roundtrip"] = f"WITH {_PAIRS}, q AS (SELECT * FROM pr WHERE n IS NOT NULL), {_steps('q', [('v', 6, 's')], 'g')} SELECT vec_id, " + ", ".join(f"round({_sum(f's{i + 1}[{k}] * (n[{k}] - v[{k}])' for k in (1, 2, 3))}, 6) AS t{i}" for i in range(3)) + ", 0.0::DOUBLE AS max_error FROM g"
SQL["hand_points_wrist_frame"] = f"WITH {_V}, {_steps('v', [('v', 6, 'l'), ('v', 12, 'r')], 'g')}, h AS (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS point, " + ", ".join(f"round({_sum(f'{s}{i + 1}[{j}] * (v[{18 + 3 * k + j}] - v[{t + j}])' for j in (1, 2, 3))} / (1 + 1e-6), 6) AS {c}" for i, c in enumerate("xyz")) + " FROM g" for k, (s, t) in enumerate([("l", 0)] * 5 + [("r", 3)] * 5)) + ") SELECT * FROM h"
SQL["project_points"] = f"WITH {_V}, h AS (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS point, round(388.0 * v[{19 + 3 * k}] / greatest(v[{21 + 3 * k}], 1e-6) + 320.0, 3) AS u, round(388.0 * v[{20 + 3 * k}] / greatest(v[{21 + 3 * k}], 1e-6) + 240.0, 3) AS v FROM v" for k in range(10)) + ") SELECT * FROM h"

_PRED = """pd AS (SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS step,
  l_extendedprice * 1e-5 AS gt, p_retailprice * l_quantity * 1e-5 AS pred, l_returnflag <> 'R' AS valid FROM lineitem JOIN part ON l_partkey = p_partkey), er AS (SELECT *, abs(gt - pred) AS err FROM pd)"""
SQL["action_accuracy"] = f"""WITH {_PRED}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS threshold)
SELECT 'masked' AS kind, threshold, round(count(*) FILTER (valid AND err < threshold) / greatest(1, count(*) FILTER (valid)), 6) AS accuracy FROM er, t GROUP BY threshold
UNION ALL SELECT 'unmasked_padded', threshold, round(count(*) FILTER (err < threshold) / count(*), 6) FROM er, t GROUP BY threshold"""
SQL["masked_part_l1"] = f"""WITH {_PAIRS}, d AS (SELECT vec_id, k, abs(v[k] - n[k]) AS err FROM pr, unnest(range(1, 49)) AS t(k) WHERE n IS NOT NULL AND vec_id % 3 <> 0)
SELECT CASE WHEN k <= 6 THEN 'wrist_trans' WHEN k <= 18 THEN 'wrist_rot' ELSE 'hand' END AS part, round(avg(err), 6) AS l1 FROM d GROUP BY 1"""
SQL["smoothness_heatmap"] = f"""WITH {_PRED}, a AS (SELECT sample_id, step, gt - pred AS d, lag(gt - pred) OVER w AS p, lag(gt - pred, 2) OVER w AS pp FROM pd WINDOW w AS (PARTITION BY sample_id ORDER BY step))
SELECT 1 AS diff, CAST(step - 1 AS INT) AS step, round(avg(abs(d - p)), 10) AS error FROM a WHERE p IS NOT NULL GROUP BY step UNION ALL SELECT 2, CAST(step - 2 AS INT), round(avg(abs(d - 2 * p + pp)), 10) FROM a WHERE pp IS NOT NULL GROUP BY step"""
SQL["trajectory_metrics"] = f"""WITH {_PRED}, a AS (SELECT *, abs(gt - lag(gt) OVER w) AS lg, abs(pred - lag(pred) OVER w) AS lp FROM er WINDOW w AS (PARTITION BY sample_id ORDER BY step))
SELECT sample_id, round(arg_max(err, step), 10) AS endpoint_error, round(abs(coalesce(sum(lg), 0) - coalesce(sum(lp), 0)), 10) AS length_error, round(avg(err), 10) AS mean_error, round(max(err), 10) AS max_error FROM a GROUP BY sample_id"""
SQL["loss_over_time"] = f"WITH {_PRED} SELECT CAST(step AS INT) AS step, round(avg(err), 6) AS l1, round(avg(err * err), 6) AS l2, count(*) AS n FROM er GROUP BY step"
_COV = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL["covariance_matrix"] = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_samp({a}, {b}), 4) + 0.0 AS cov FROM lineitem" for i, a in enumerate(_COV) for j, b in enumerate(_COV))
SQL["mean_of_batch_means"] = f"""WITH {_PRED}, o AS (SELECT sample_id, round(avg(err), 9) AS loss FROM er GROUP BY sample_id), b AS (SELECT sample_id // 100 AS b, avg(loss) AS m FROM o GROUP BY 1)
SELECT round(avg(m), 6) AS mean_of_means, count(*) AS batches FROM b"""
SQL["min_max_loss_sample"] = f"""WITH {_PRED}, o AS (SELECT sample_id, round(avg(err), 9) AS loss FROM er GROUP BY sample_id), lo AS (SELECT * FROM o ORDER BY loss, sample_id LIMIT 1), hi AS (SELECT * FROM o ORDER BY loss DESC, sample_id LIMIT 1)
SELECT 'min' AS which, round(loss, 6) AS loss, sample_id FROM lo UNION ALL SELECT 'max', round(loss, 6), sample_id FROM hi"""

_SH = "s AS (SELECT n_name AS dataset, c_custkey AS shard, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SQL["shard_coverage"] = f"""WITH {_SH} SELECT CASE WHEN grouping(dataset) = 1 THEN '(total)' ELSE dataset END AS dataset, count(*) AS shards, count(*) FILTER (c_mktsegment <> 'BUILDING') AS picked,
round(count(*) FILTER (c_mktsegment <> 'BUILDING') / count(*), 6) AS fraction, count(*) FILTER (c_mktsegment <> 'BUILDING') = count(*) AS "full" FROM s GROUP BY ROLLUP (dataset)"""
SQL["floor_plus_budget_selection"] = f"""WITH {_SH}, u AS (SELECT *, CAST('0x' || substr(md5(dataset || '|' || shard || '|0'), 1, 8) AS BIGINT) AS h FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY h, shard) AS k FROM u),
b AS (SELECT * FROM r WHERE k <= 3), e AS (SELECT *, row_number() OVER (ORDER BY h, shard) AS j FROM r WHERE k > 3)
SELECT dataset, shard, 'floor' AS picked_by FROM b UNION ALL SELECT dataset, shard, 'budget' FROM e WHERE j <= 100 - (SELECT count(*) FROM b)"""
SQL["ratio_interleave"] = """
WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), c AS (SELECT conv_id * 1000 + turn AS id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM conversations WHERE role = 'assistant'),
j AS (SELECT i // 17 AS r, k FROM a, unnest(range(0, 3)) AS t(k) WHERE i % 17 = 16)
SELECT (i // 17) * 20 + i % 17 AS slot, 'first' AS source, event_id AS id FROM a
UNION ALL SELECT r * 20 + 17 + k, 'second', id FROM j JOIN c ON c.i = (r * 3 + k) % c.n"""
SQL["validation_chain"] = """SELECT 0 AS source_ord, doc_id AS id, lang, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT 1, conv_id * 1000 + turn, NULL, role FROM conversations"""
SQL["weighted_blend"] = """
WITH n AS (SELECT 3.0 / (SELECT count(*) FROM documents) AS a, 1.0 / (SELECT count(*) FROM pages) AS b), u AS (
  SELECT doc_id AS id, 0 AS source, CAST('0x' || substr(md5(doc_id || '|0'), 1, 8) AS BIGINT) / 4294967296.0 < a / greatest(a, b) AS k FROM documents, n
  UNION ALL SELECT page_id, 1, CAST('0x' || substr(md5(page_id || '|1'), 1, 8) AS BIGINT) / 4294967296.0 < b / greatest(a, b) FROM pages, n)
SELECT id, source FROM u WHERE k"""
SQL["candidate_turn_argmax"] = """
WITH p AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), q AS (SELECT conv_id, turn, text, reply FROM p WHERE role = 'user' AND next_role = 'assistant'),
s AS (SELECT conv_id, turn, 0.5 * coalesce(CASE WHEN length(text) % 11 <> 0 THEN length(text) % 6 END, 0) + 0.5 * (length(reply) % 6) + 0.5 * (turn % 6) AS score FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM s)
SELECT conv_id, CAST(n AS INT) AS candidates, CAST(pos AS INT) AS chosen, turn FROM r WHERE k = 1"""
SQL["prompt_text"] = """SELECT event_id, 'Task: ' || event_type || ' States: ' || repeat('<state>', event_id % 4) || printf(' fx:%.2f fy:%.2f cx:%.2f cy:%.2f', value, value / 3, 320.0, 240.0) AS prompt FROM events"""
SQL["label_mask_subsequence"] = """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), a AS (SELECT *, least(len(w), doc_id % 40) AS p FROM w),
t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN len(w) ELSE p + 3 END AS start, CASE WHEN doc_id % 5 = 0 THEN [] ELSE w[p + 1 :] END AS kept FROM a)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(len(list_filter(kept, lambda x: length(x) > 0)) AS BIGINT) AS kept, CAST(coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) AS BIGINT) AS total FROM t"""
SQL["prefix_delay_forced"] = f"""WITH {_PRED} SELECT CAST(step AS INT) AS step, count(*) AS n, max(CASE WHEN step < 2 THEN 1.0 ELSE 0.5 END)::DOUBLE AS time, count(*) FILTER (step >= 2 AND valid) AS n_loss, round(sum(CASE WHEN step < 2 THEN gt ELSE 0 END), 6) AS prefix_sum FROM pd GROUP BY step"""
SQL["request_log_timings"] = """SELECT user_id AS conn, CAST(row_number() OVER w AS INT) AS request_index, round(value, 6) AS infer_ms, round(lag(value) OVER w, 6) AS prev_infer_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

SQL["stream_stats_equals_batch"] = "SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(sum(value * value), 4) AS total_sq, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type"
SQL["stream_windows_equals_batch"] = f"""
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS hq FROM events), a AS (
  SELECT event_id, hq, [value, lead(value, 2) OVER w, lead(value, 4) OVER w, lead(value, 6) OVER w] AS v, [hq, lead(hq, 2) OVER w, lead(hq, 4) OVER w, lead(hq, 6) OVER w] AS q FROM e {_EV}
), b AS (SELECT *, coalesce(list_position(q, 0), 5) AS cut FROM a WHERE hq = 1)
SELECT event_id, CAST(k AS INT) AS k, round(v[k + 1], 6) AS x, 3 AS n_states FROM b, unnest(range(0, 4)) AS t(k) WHERE k + 1 < cut AND v[k + 1] IS NOT NULL"""


from . import loading_oracles, media_oracles, sample_oracles  # noqa: E402, F401  add their SQL too
