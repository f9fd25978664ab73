"""SQL of the queries of sampling, sample rows, texts, attention, evaluation and storage, written apart from them."""

from __future__ import annotations

from .oracles import _EV, _PAIRS, _PRED, _V, SQL, _columns, _steps, _sum  # noqa: F401


def _u(*parts: str, seed: int = 0) -> str:
    text = " || '|' || ".join([*parts, f"'{seed}'"])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


_E = "event_id"

SQL["flow_time_samples"] = f"""
WITH t AS (SELECT event_id, (event_id % 64) / 64.0 + {_u("event_id // 64", seed=1)} AS t, {_u(_E, seed=2)} AS u FROM events)
SELECT event_id, round(t - floor(t / (1 - 1e-5)) * (1 - 1e-5), 6) AS t_uniform, round(0.999 * (1 - pow(u, 1 / 1.5)), 6) AS t_beta FROM t"""

_POISSON = "len(list_filter(range(0, 10), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-2.0) * pow(2.0, j) / gamma(j + 1))) <= w))"
SQL["position_samples"] = f"""
WITH t AS (SELECT event_id, greatest(1e-7, least(1 - 1e-7, {_u(_E, seed=1)})) AS g, {_u(_E, seed=2)} AS a, {_u(_E, seed=3)} AS b, {_u(_E, seed=4)} AS w FROM events)
SELECT event_id, CAST(greatest(1, ceil(ln(g) / ln(2 / 3.0))) AS INT) AS geometric, CAST(least(15, floor(16 * (1 - pow(1 - a, 0.4)))) AS INT) AS early, CAST(least(15, floor(16 * pow(b, 0.4))) AS INT) AS late, CAST({_POISSON} AS INT) AS spans FROM t"""

SQL["prefix_delays"] = f"""
WITH t AS (SELECT event_id, event_id % 9 AS n, least(event_id % 9, 6) AS up, {_u(_E, seed=1)} AS a, {_u(_E, seed=2)} AS b, {_u(_E, seed=3)} AS c FROM events),
k AS (SELECT *, list_filter(range(0, up), lambda k: (1 - exp(-(k + 1.0))) / (1 - exp(-1.0 * up)) > b)[1] AS f FROM t)
SELECT event_id, CAST(floor(a * up) AS INT) AS even, CAST(coalesce(f, greatest(up - 1, 0)) AS INT) AS falling, CAST(floor(c * n) AS INT) AS open FROM k"""


def _span(k: str, name: str) -> str:
    return _u(_E, f"CAST({k} AS VARCHAR)", f"'{name}'", seed=3)


_RATE = 0.4 * 11 / 2
SQL["state_masks"] = f"""
WITH t AS (SELECT event_id, {_u(_E, seed=2)} AS free, {_span("0", "free")} AS free2, {_span("0", "n")} AS w FROM events),
n AS (SELECT *, len(list_filter(range(0, 11), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-{_RATE}) * pow({_RATE}, j) / gamma(j + 1))) <= w)) AS n FROM t),
s AS (SELECT event_id, k, CAST(least(10, floor(11 * (1 - pow(1 - {_span("k", "start")}, 1 / 1.5)))) AS INT) AS a, least(11, greatest(1, CAST(ceil(ln(greatest(1e-7, least(1 - 1e-7, {_span("k", "length")}))) / ln(0.5)) AS INT))) AS l FROM n, unnest(range(0, n)) AS r(k)),
m AS (SELECT n.event_id, p, n.free2 >= 0.1 AND p < 11 AND EXISTS (SELECT 1 FROM s WHERE s.event_id = n.event_id AND p >= a AND p < a + l) AS hit FROM n, unnest(range(0, 12)) AS r(p)),
b AS (SELECT event_id, string_agg(CASE WHEN hit THEN '1' ELSE '0' END, '' ORDER BY p) AS spans FROM m GROUP BY event_id),
f AS (SELECT event_id, string_agg(CASE WHEN p < 5 AND free >= 0.2 AND {_u(_E, "CAST(p AS VARCHAR)", seed=1)} < 0.3 THEN '1' ELSE '0' END, '' ORDER BY p) AS frames FROM n, unnest(range(0, 6)) AS r(p) GROUP BY event_id)
SELECT event_id, frames, spans FROM b JOIN f USING (event_id)"""

_VIEWS = f"CASE WHEN event_id % 3 = 0 THEN 'head' WHEN {_u(_E, seed=1)} < 0.5 THEN 'head+chest' WHEN {_u(_E, seed=1)} < 0.7 THEN 'chest' ELSE 'head' END"
SQL["view_dropout"] = f"""
WITH v AS (SELECT event_id, {_VIEWS} AS views FROM events)
SELECT event_id, views, CASE WHEN event_id % 3 = 0 THEN 'head' ELSE 'head+chest' END AS val_views,
  CASE views WHEN 'head' THEN 'The video is from the head camera.' WHEN 'chest' THEN 'The video is from the chest camera.' ELSE 'There are two videos: the first video is from the head camera; the second video is from the chest camera.' END AS text, false AS fails FROM v"""

SQL["flow_inputs"] = f"""
WITH {_PRED}, d AS (SELECT *, CAST(floor({_u("sample_id", seed=1)} * least(count(*) FILTER (valid) OVER (PARTITION BY sample_id), 3)) AS INT) AS delay FROM pd),
c AS (SELECT *, CASE WHEN step < delay THEN 1.0 ELSE 1 - pow({_u("sample_id", "copy", seed=2)}, 1 / 1.5) END AS t FROM d, (VALUES (0), (1)) AS r(copy))
SELECT sample_id, copy, max(delay) AS delay, count(*) FILTER (step >= delay AND valid) AS n_loss, round(sum((1 - 0.99 * t) * pred + t * gt), 6) AS psi FROM c GROUP BY sample_id, copy"""

SQL["instruction_pick"] = f"""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, w[CAST(floor({_u("doc_id", seed=1)} * len(w)) AS INT) + 1] AS train_pick, w[1] AS val_pick FROM w"""

_SLICES = {"wrist_state": (0, 18), "hand_state": (18, 48), "wrist_action": (48, 66), "hand_action": (66, 96), "head_extrinsic": (96, 112), "head_intrinsic": (112, 116), "extrinsic": (96, 112), "intrinsic": (112, 116)}
SQL["lowdim_named_slices"] = f"WITH {_V}, w AS (SELECT vec_id, list_concat(v, v) AS w FROM v) " + " UNION ALL ".join(f"SELECT vec_id, '{n}' AS name, {b - a} AS n, round(list_sum(w[{a + 1} : {b}]), 6) AS total FROM w" for n, (a, b) in _SLICES.items())


def _camera_row(i: int, column: str | None, at: int | None) -> str:
    parts = [f"v[{49 + 4 * i + k}] * {f'{column}[{k + 1}]' if column else f'v[{at + k + 1}]'}" for k in range(3)]
    return _sum([*parts, f"v[{49 + 4 * i + 3}]"] if at is not None else parts)


_POSE = [_camera_row(i, None, 3 * h) for h in range(2) for i in range(3)] + [_camera_row(i, f"{s}{c}", None) for s in "lr" for c in (1, 2) for i in range(3)]
_HANDS = [f"v[{k + 1}]" for k in [*range(18, 28), *range(33, 43)]]
SQL["state_action_rows"] = f"WITH {_V}, {_steps('v', [('v', 6, 'l'), ('v', 12, 'r')], 'g')} SELECT vec_id, CAST(k - 1 AS INT) AS dim, round(x[k], 6) AS x FROM (SELECT vec_id, [{', '.join(_POSE + _HANDS)}] AS x FROM g), unnest(range(1, 39)) AS t(k)"
SQL["absolute_action_roundtrip"] = f"WITH {_PAIRS} SELECT vec_id, round(n[19] - v[19], 6) AS h0, round(n[48] - v[48], 6) AS h29, 0.0::DOUBLE AS max_error FROM pr WHERE n IS NOT NULL"
SQL["hand_points_camera_frame"] = f"WITH {_V}, {_steps('v', [('v', 6, 'l'), ('v', 12, 'r')], 'g')}, h AS (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS point, " + ", ".join(f"round(({_sum(f'{s}{j}[{i + 1}] * v[{18 + 3 * k + j}]' for j in (1, 2, 3))} + v[{t + i + 1}]) / (1 + 1e-6), 6) AS {c}" for i, c in enumerate("xyz")) + " FROM g" for k, (s, t) in enumerate([("l", 0)] * 5 + [("r", 3)] * 5)) + ") SELECT * FROM h"
SQL["padded_history"] = """
WITH w AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: md5(x)) AS w FROM documents), s AS (SELECT doc_id, w[1] AS first, w[greatest(1, len(w) - 5) :] AS s FROM w)
SELECT doc_id, array_to_string(list_concat(list_transform(range(0, 6 - len(s)), lambda k: first), s), ' ') AS "full", 6 AS n_full, array_to_string(s, ' ') AS short, CAST(len(s) AS INT) AS n_short FROM s"""

_QUESTIONS = "p AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), q AS (SELECT conv_id, turn, text, reply FROM p WHERE role = 'user' AND next_role = 'assistant')"
SQL["qa_rows"] = f"""
WITH {_QUESTIONS}, s AS (SELECT *, 0.5 * coalesce(CASE WHEN length(text) % 11 <> 0 THEN length(text) % 6 END, 0) + 0.5 * (length(reply) % 6) + 0.5 * (turn % 6) AS score FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS k FROM s)
SELECT conv_id, text AS question, reply AS answer, false AS is_vla_data, false AS any_view, CASE conv_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'book' ELSE 'unknown' END AS dataset_name, CASE WHEN conv_id % 2 = 0 THEN conv_id ELSE -1 END AS episode_index FROM r WHERE k = 1"""
SQL["chat_messages"] = f"""
WITH {_QUESTIONS} SELECT conv_id, turn, 0 AS place, 'user' AS role, md5(text) AS content FROM q UNION ALL SELECT conv_id, turn, 1, 'assistant', md5(reply) FROM q WHERE turn % 4 <> 0"""
SQL["view_intrinsic_rows"] = f"""
WITH v AS (SELECT event_id, value, string_split({_VIEWS}, '+') AS views FROM events)
SELECT event_id, CAST(k - 1 AS INT) AS place, views[k] AS view, round(CASE WHEN views[k] = 'chest' AND event_id % 2 = 0 THEN 2 * value ELSE value END, 6) AS intrinsic FROM v, unnest(range(1, len(views) + 1)) AS t(k)"""
SQL["image_name_order"] = """
WITH n AS (SELECT event_id, list_filter(range(0, event_id % 13 + 1), lambda k: k % 5 <> 4) AS k FROM events)
SELECT event_id, array_to_string(list_sort(list_transform(k, lambda x: 'image_' || x || '.jpg')), ',') AS names FROM n"""

SQL["request_texts"] = r"""
WITH a AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '' ELSE replace(c_name, '#', '_') || '_' || c_mktsegment END AS folder, c_custkey * c_custkey * 37 AS n FROM customer)
SELECT c_custkey, CASE folder WHEN '' THEN 'unknown' ELSE folder END AS folder, CASE WHEN n < 1024 THEN n || ' bytes' WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) ELSE printf('%.2f MB', n / 1048576.0) END AS size FROM a"""
SQL["request_json"] = """
SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","raw":"' || lower(hex(event_type)) || '"}' AS fields, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS "at" FROM events"""

SQL["media_gate"] = f"""
WITH {_V}, m AS (SELECT vec_id, list_transform(v[1:3], lambda x: abs(x) * 100) AS p, list_transform(v[4:6], lambda x: abs(x) * 100) AS s, len(list_filter(v[7:46], lambda x: x > 0)) / 40.0 AS d FROM v)
SELECT vec_id, CASE WHEN list_min(p) < 0.5 OR list_max(p) > 30 OR list_min(s) < 0.5 THEN 'image' WHEN d < 0.45 THEN 'depth' ELSE 'ok' END AS reason FROM m"""
SQL["non_finite_values"] = """
WITH k AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'nan' WHEN event_id % 13 = 0 THEN 'inf' ELSE 'fine' END AS kind, value FROM events)
SELECT count(*) FILTER (kind = 'nan') AS nan, count(*) FILTER (kind = 'inf') AS inf, round(min(value) FILTER (kind = 'fine'), 6) AS min, round(max(value) FILTER (kind = 'fine'), 6) AS max, round(avg(value) FILTER (kind = 'fine'), 6) AS mean FROM k"""

SQL["accuracy_partly_valid"] = f"""
WITH {_PRED}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS threshold)
SELECT threshold, round(count(*) FILTER (valid AND err < threshold AND abs(gt - (pred + 0.05)) < threshold) / greatest(1, count(*) FILTER (valid)), 6) AS accuracy FROM er, t GROUP BY threshold"""
SQL["error_tables"] = f"""
WITH {_PRED} SELECT 'heatmap' AS kind, CAST(step AS INT) AS step, 0 AS dim, round(avg(err), 10) AS x FROM er GROUP BY step
UNION ALL SELECT 'mae', -1, 0, round(avg(err), 6) FROM er UNION ALL SELECT 'loss', -1, -1, round(sum(err) / greatest(1, count(*) FILTER (err > 1e-8)), 6) FROM er"""
SQL["metrics_document"] = f"""
WITH {_PRED}, h AS (SELECT avg(e) AS heat_mean, max(e) AS heat_max FROM (SELECT avg(err) AS e FROM er GROUP BY step)), a AS (SELECT avg(CASE WHEN err < 0.1 THEN 1.0 ELSE 0 END) AS accuracy FROM er),
j AS (SELECT avg(m) AS mean_error, avg(x) AS max_error FROM (SELECT avg(err) AS m, max(err) AS x FROM er GROUP BY sample_id)),
l AS (SELECT step, gt - pred - lag(gt - pred) OVER w AS d, gt - pred - 2 * lag(gt - pred) OVER w + lag(gt - pred, 2) OVER w AS dd FROM pd WINDOW w AS (PARTITION BY sample_id ORDER BY step)),
s AS (SELECT (SELECT avg(x) FROM (SELECT avg(abs(d)) AS x FROM l WHERE d IS NOT NULL GROUP BY step)) AS first_diff, (SELECT avg(x) FROM (SELECT avg(abs(dd)) AS x FROM l WHERE dd IS NOT NULL GROUP BY step)) AS second_diff)
SELECT round(heat_mean, 6) AS heat_mean, round(heat_max, 6) AS heat_max, round(accuracy, 6) AS accuracy, round(mean_error, 6) AS mean_error, round(max_error, 6) AS max_error, round(first_diff, 6) AS first_diff, round(second_diff, 6) AS second_diff FROM h, a, j, s"""
SQL["covariance_summary"] = "SELECT round((var_samp(l_quantity) + var_samp(l_extendedprice) + var_samp(l_discount) + var_samp(l_tax)) / 1e6, 4) AS trace_millions, CAST(16 AS BIGINT) AS cells FROM lineitem"
SQL["worst_first_report"] = f"""
WITH {_PRED} SELECT sample_id, round(avg(err) FILTER (valid AND step >= 1), 10) AS mae, count(*) FILTER (valid AND step >= 1) AS n, round(avg(err) FILTER (step < 1), 10) AS prefix_l1 FROM er GROUP BY sample_id"""
SQL["eval_subsample"] = f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {_u('o_orderkey', seed=3)}, o_orderkey LIMIT 200"
SQL["head_video_entries"] = """
WITH b AS (SELECT event_id, event_id % 16 AS s, CASE (event_id // 16) % 3 WHEN 0 THEN 16 WHEN 1 THEN 32 ELSE 11 END AS n FROM events)
SELECT event_id, CASE WHEN n = 32 THEN 2 * s WHEN s < n THEN s END AS entry FROM b"""

_LONG = f"WITH {_V}, x AS (SELECT vec_id, k // 16 AS layer, k // 8 % 2 AS head, k % 4 AS patch, abs(v[k + 1]) AS w FROM v, unnest(range(0, 64)) AS t(k)), n AS (SELECT * FROM x WHERE NOT (layer = 2 AND vec_id % 4 = 0)), h AS (SELECT vec_id, layer, head, patch, avg(w) AS w FROM n GROUP BY ALL), l AS (SELECT vec_id, layer, patch, avg(w) AS mean, max(w) AS top FROM h GROUP BY ALL)"
SQL["attention_maps"] = _LONG + """, g AS (
  SELECT vec_id, 'middle_layers_mean_heads' AS strategy, patch, avg(mean) AS w FROM l WHERE layer IN (1, 2) GROUP BY ALL
  UNION ALL SELECT vec_id, 'mean_layers_heads', patch, avg(mean) FROM l GROUP BY ALL UNION ALL SELECT vec_id, 'max_heads', patch, avg(top) FROM l GROUP BY ALL UNION ALL SELECT vec_id, 'last_layer_mean_heads', patch, mean FROM l WHERE layer = 3)
SELECT vec_id, strategy, CAST(patch AS INT) AS patch, round(w / sum(w) OVER (PARTITION BY vec_id, strategy), 6) AS w FROM g"""
SQL["attention_entropy"] = f"""
WITH {_V}, x AS (SELECT vec_id, abs(v[k]) AS w FROM v, unnest(range(1, 65)) AS t(k)), p AS (SELECT vec_id, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM x)
SELECT vec_id, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(64), 6) AS entropy FROM p GROUP BY vec_id"""
SQL["attention_segments"] = """
WITH c AS (SELECT user_id, event_id, (event_id % 5 + 1) * 4 AS n FROM events)
SELECT user_id, event_id, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_token, CAST(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS last_token FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""

SQL["sample_profile"] = "SELECT event_type, count(*) AS samples, round(sum(value), 6) AS value_sum, round(avg(value), 6) AS value_avg, string_agg(DISTINCT CAST(user_id % 4 AS VARCHAR), ',' ORDER BY CAST(user_id % 4 AS VARCHAR)) AS workers FROM events GROUP BY event_type"
SQL["observation_stats"] = f"WITH {_V}, x AS (SELECT vec_id, unnest(v) AS x FROM v) SELECT vec_id, CAST(count(*) AS INT) AS size, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY vec_id"

SQL["euler_and_quaternions"] = f"""
WITH {_V}, a AS (SELECT vec_id, sin(v[1] * 3) AS sa, cos(v[1] * 3) AS ca, sin(v[2] * 1.5) AS sb, cos(v[2] * 1.5) AS cb, sin(v[3] * 3) AS sc, cos(v[3] * 3) AS cc FROM v)
SELECT vec_id, round(cc * cb, 6) AS m00, round(cc * sb * sa - sc * ca, 6) AS m01, round(cc * sb * ca + sc * sa, 6) AS m02, round(sc * cb, 6) AS m10, round(sc * sb * sa + cc * ca, 6) AS m11, round(sc * sb * ca - cc * sa, 6) AS m12,
  round(-sb, 6) AS m20, round(cb * sa, 6) AS m21, round(cb * ca, 6) AS m22, 0.0::DOUBLE AS apart, 0.0::DOUBLE AS angle_error, true AS rotation FROM a"""
SQL["relative_motions"] = f"WITH {_PAIRS} SELECT vec_id, 0.0::DOUBLE AS apart, 1.0::DOUBLE AS corner FROM pr WHERE n IS NOT NULL"

SQL["frame_shard_roundtrip"] = """
SELECT event_id, 'events' AS dataset_name, user_id AS episode_index, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS high_quality, CASE WHEN event_id % 2 = 0 THEN event_type END AS instruction, 116 AS n, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2) AS x, 8 AS image_bytes, true AS no_depth FROM events"""
SQL["stored_parameters"] = " UNION ALL ".join(f"SELECT {k} AS dim, round(avg({c}), 6) AS mean, round(min({c}), 6) AS min, round(max({c}), 6) AS max, count(*) AS rows, CAST(1 AS BIGINT) AS schema_version FROM lineitem" for k, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
SQL["sketched_quantiles"] = " UNION ALL ".join(f"SELECT {k} AS dim, count(*) AS n, true AS near FROM lineitem" for k in range(4))

SQL["stream_tumbling_counts"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"
SQL["sessions"] = """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, s"""
SQL["as_of_values"] = """
SELECT event_id, round(value, 6) AS value, round((SELECT v.value FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) < (p.ts, p.event_id) ORDER BY v.ts DESC, v.event_id DESC LIMIT 1), 6) AS seen FROM events p WHERE event_type = 'purchase'"""
SQL["semi_and_anti"] = """
WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), k AS (SELECT *, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM r) THEN 'left_semi' ELSE 'left_anti' END AS kind FROM orders)
SELECT kind, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM k GROUP BY ALL"""
SQL["order_cube"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS INT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"
