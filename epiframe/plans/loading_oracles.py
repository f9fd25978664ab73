"""SQL of the queries of loading, written apart from them."""

from __future__ import annotations

from .oracles import _PAIRS, _PRED, _V, SQL, _steps
from .sample_oracles import _HANDS, _POSE, _u

SQL["resampled_epochs"] = "SELECT event_id, user_id AS episode_index, CAST(2 AS BIGINT) AS n, '0,1' AS epochs, CAST(strlen(CAST(event_id AS VARCHAR)) + event_id % 997 AS INT) AS size FROM events"
SQL["stream_blend_equals_batch"] = """
WITH a AS (SELECT CAST(user_id % 8 AS INT) AS lane, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS n FROM events
), b AS (SELECT CAST(conv_id % 8 AS INT) AS lane, count(*) AS size FROM conversations GROUP BY 1
), rounds AS (SELECT lane, n // 10 AS r, k FROM a, (VALUES (0), (1)) AS t(k) WHERE n % 10 = 9)
SELECT lane, n // 10 * 12 + n % 10 AS slot, 'first' AS source, n FROM a
UNION ALL SELECT lane, r * 12 + 10 + k, 'second', (r * 2 + k) % size FROM rounds JOIN b USING (lane)"""
SQL["buffered_shuffle"] = "SELECT event_id, true AS bounded FROM events"
SQL["guarded_events"] = """
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'error event' WHEN value < 5 THEN 'small value' ELSE 'ok' END AS reason FROM events)
SELECT reason, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CASE WHEN reason = 'ok' THEN round(sum(2 * value), 4) END AS twice FROM e GROUP BY reason
UNION ALL SELECT 'counted', count(*), count(*) FILTER (reason = 'ok'), count(*) FILTER (reason <> 'ok') FROM e"""
SQL["collated_batches"] = """
WITH c AS (SELECT conv_id, coalesce(list(length(text) ORDER BY turn) FILTER (length(text) % 3 <> 0), []) AS l, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM conversations GROUP BY conv_id
), w AS (SELECT *, k // 16 AS batch, max(len(l)) OVER (PARTITION BY k // 16) AS width, count(*) OVER (PARTITION BY k // 16) AS n FROM c)
SELECT batch, CAST(n AS INT) AS n, CAST(k % 16 AS INT) AS place, conv_id, array_to_string(l || list_transform(range(0, width - len(l)), lambda x: -1), ',') AS lengths, CAST(len(l) AS INT) AS valid, CAST(len(l) AS INT) AS length FROM w"""
SQL["processed_frames"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT)) AS v FROM embeddings
), p AS (SELECT vec_id, y, x, [v[16 * y + 2 * x + 1], v[16 * y + 2 * x + 2], v[16 * y + 2 * x + 9], v[16 * y + 2 * x + 10]] AS q FROM v, unnest(range(0, 4)) AS s(y), unnest(range(0, 4)) AS t(x)
), c AS (SELECT *, floor(list_sum(list_transform(q, lambda z: z % 256)) / 4 + 0.5) AS r, floor(list_sum(list_transform(q, lambda z: 255 - z % 256)) / 4 + 0.5) AS g, floor(list_sum(list_transform(q, lambda z: z // 7 % 256)) / 4 + 0.5) AS b FROM p)
SELECT vec_id, 4 AS height, 4 AS width, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green, CAST(sum(b) AS BIGINT) AS blue, CAST(max(CASE WHEN y = 3 AND x = 3 THEN b END) AS INT) AS corner, CAST(sum(q[1]) AS BIGINT) AS millimetres, '4.0,3.0,2.0,1.5' AS intrinsic FROM c GROUP BY vec_id"""
SQL["covariance_of_sides"] = """
WITH v AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), s AS (SELECT 'gt' AS "of", v[1] AS a, v[2] AS b FROM v UNION ALL SELECT 'pred', v[3], v[4] FROM v UNION ALL SELECT 'error', v[1] - v[3], v[2] - v[4] FROM v)
SELECT "of", 2 AS size, round(var_samp(a) + var_samp(b), 8) AS trace, round(var_samp(a) * var_samp(b) - covar_samp(a, b) * covar_samp(a, b), 8) AS determinant FROM s GROUP BY "of\""""
SQL["slots_scattered"] = """
WITH p AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS slot, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, user_id FROM events WHERE event_type = 'purchase')
SELECT e.event_id, round(q.value, 6) AS value FROM events e LEFT JOIN p ON p.event_id = e.event_id LEFT JOIN p q ON q.user_id = p.user_id AND q.k = p.slot"""
SQL["flow_time_any_beta"] = f"SELECT event_id, round({_u('event_id', seed=5)}, 6) AS share FROM events"
SQL["model_rows_of_pairs"] = f"""
WITH {_PAIRS}, q AS (SELECT * FROM pr WHERE n IS NOT NULL), {_steps("q", [("v", 6, "l"), ("v", 12, "r")], "g")}
SELECT vec_id, CAST(k - 1 AS INT) AS dim, 1 AS n_states, 1 AS n_actions, 0 AS n_later, 'true,false,false' AS valid, round(x[k], 6) AS x, round(h[k], 6) AS hand
FROM (SELECT vec_id, [{", ".join(_POSE + _HANDS)}] AS x, [{", ".join(["NULL"] * 18 + [x.replace("v[", "n[") + " - " + x for x in _HANDS])}] AS h FROM g), unnest(range(1, 39)) AS t(k)"""
SQL["served_observations"] = """
WITH u AS (SELECT user_id, max(event_type) AS kind, list([value, (event_id % 7)::DOUBLE] ORDER BY ts, event_id) AS e FROM events GROUP BY user_id
), n AS (SELECT user_id, kind, e, list_transform(e, lambda s: concat_ws(' ', CAST(round(s[1] * 0.5 + 1, 4) AS VARCHAR), CAST(round(s[2] * 2 - 1, 4) AS VARCHAR))) AS t FROM u)
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN kind ELSE 'wait' END AS instruction, 'b' AS images, CASE WHEN user_id % 2 = 0 THEN concat_ws(',', user_id, user_id + 1, user_id + 2, user_id + 3) ELSE concat_ws(',', user_id, user_id + 4, user_id + 2, user_id + 5) END AS intrinsic,
  CASE WHEN user_id % 6 = 0 THEN 'head,chest' ELSE 'head' END AS views, array_to_string(list_transform(range(0, 6 - least(6, len(t))), lambda k: t[1]) || t[greatest(1, len(t) - 5) :], ',') AS states, 6 AS n_states,
  CASE WHEN user_id % 5 <> 0 THEN array_to_string(t[1:2] || list_transform(range(0, 3 - least(2, len(t))), lambda k: '0.0 0.0'), ',') END AS prefix, CASE WHEN user_id % 5 <> 0 THEN CAST(least(2, len(t)) AS INT) END AS delay, 1.0::DOUBLE AS video_fps FROM n"""
SQL["vision_entries"] = """
WITH i AS (SELECT event_id, k AS place, 'image' AS kind, NULL AS view, 1 AS frames, NULL AS fps FROM events, unnest(range(0, event_id % 5)) AS t(k) WHERE event_id % 3 = 0
), v AS (SELECT event_id, 0 AS place, 'video' AS kind, 'head' AS view, event_id % 5 AS frames, 1.5 AS fps FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 1, 'video', 'chest', event_id % 4, 1.5 FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0)
SELECT event_id, CAST(place AS INT) AS place, kind, view, CAST(frames AS INT) AS frames, CAST(fps AS DOUBLE) AS fps, NULL AS indices FROM i UNION ALL SELECT event_id, CAST(place AS INT), kind, view, CAST(frames AS INT), fps, array_to_string(range(0, frames), ',') FROM v"""
SQL["stored_predictions"] = f"WITH {_PRED} , h AS (SELECT avg(err) AS e FROM er GROUP BY step) SELECT count(*) AS rows, count(DISTINCT sample_id) AS samples, count(*) FILTER (valid) AS valid, (SELECT round(avg(e), 6) FROM h) AS mean_error, (SELECT round(max(e), 6) FROM h) AS max_error FROM er"
SQL["attention_steps"] = f"""
WITH {_V}, x AS (SELECT vec_id, k % 4 AS step, CAST(k // 4 AS INT) AS x, CASE WHEN k % 4 = 2 AND vec_id % 3 = 0 THEN NULL ELSE abs(v[k + 1]) END AS w FROM v, unnest(range(0, 64)) AS t(k))
SELECT vec_id, '1' AS step, x, round(w, 6) AS w FROM x WHERE step = 1 UNION ALL SELECT vec_id, 'early', x, round(avg(w), 6) FROM x WHERE step < 3 GROUP BY ALL UNION ALL SELECT vec_id, 'mean', x, round(avg(w), 6) FROM x GROUP BY ALL"""
SQL["view_contrast"] = f"""
WITH {_V}, l AS (SELECT CAST(label AS VARCHAR) AS label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), a AS (SELECT label, x FROM l UNION ALL SELECT '(joint)', x FROM l), s AS (SELECT label, list_sort(list(x)) AS x FROM a GROUP BY label)
SELECT label, round(x[greatest(1, ceil(0.02 * len(x))::INT)], 6) AS low, round(x[greatest(1, ceil(0.98 * len(x))::INT)], 6) AS high FROM s"""
SQL["task_prompts"] = """
WITH e AS (SELECT event_id, event_type, event_id % 4 AS n, CASE WHEN event_id % 2 = 0 THEN 'There are two videos: the first video is from the head camera; the second video is from the chest camera.' ELSE 'The video is from the head camera.' END AS seen,
  format('fx:{:.2f} fy:{:.2f} cx:{:.2f} cy:1.00.', value, value * 2, event_id + 0.25::DOUBLE) AS head, format('fx:{:.2f} fy:{:.2f} cx:{:.2f} cy:1.00.', value, value * 2, event_id + 0.75::DOUBLE) AS chest FROM events
), p AS (SELECT event_id, n, 'Task: ' || event_type || '. ' || seen || ' Head camera intrinsics: ' || head || CASE WHEN event_id % 2 = 0 THEN ' Chest camera intrinsics: ' || chest ELSE '' END || ' States: ' || repeat('<state>', n) || '. Predict the next action sequence.' AS plain,
  'Task: ' || event_type || '. ' || seen || ' Head camera intrinsics: <camera>.' || CASE WHEN event_id % 2 = 0 THEN ' Chest camera intrinsics: <camera>.' ELSE '' END || ' States: ' || repeat('<state>', n) || '. Predict the next action sequence and future frames.' AS marked FROM e)
SELECT event_id, plain, marked, 'user:video 0+' || CASE WHEN event_id % 2 = 0 THEN 'video 0+' ELSE '' END || 'text ' || length(plain) || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' | assistant:text ' || 8 * n END AS turns FROM p"""
SQL["decoded_media_gate"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 3 WHEN vec_id % 7 = 0 THEN 0 ELSE CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) END AS v FROM embeddings, unnest(embedding) AS t(x)
), c AS (SELECT vec_id, count(*) FILTER (v > 0) * 1.0 / count(*) AS depth, [avg(v % 256), avg(255 - v % 256), avg(v // 7 % 256)] AS m, [stddev_pop(v % 256), stddev_pop(255 - v % 256), stddev_pop(v // 7 % 256)] AS s FROM v GROUP BY vec_id)
SELECT vec_id, round(m[1], 6) AS red, round(s[2], 6) AS green_std, CASE WHEN list_min(m) < 5 OR list_max(m) > 250 OR list_min(s) < 3 THEN 'image' WHEN depth < 0.05 THEN 'depth' ELSE 'ok' END AS reason, depth < 0.05 AS no_depth FROM c"""
SQL["random_mix"] = f"""
WITH s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS slot FROM events), d AS (SELECT *, {_u("CAST(slot AS VARCHAR)", seed=6)} AS u FROM s), p AS (SELECT *, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS source FROM d)
SELECT event_id, slot, CAST(source AS INT) AS source, (row_number() OVER (PARTITION BY source ORDER BY slot) - 1) % CASE source WHEN 0 THEN (SELECT count(*) FROM lineitem) WHEN 1 THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM pages) END AS number FROM p"""
SQL["windows_of_resampled_shards"] = f"""
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS hq FROM events), a AS (
  SELECT event_id, hq, [value, lead(value, 2) OVER w, lead(value, 4) OVER w, lead(value, 6) OVER w] AS v, [hq, lead(hq, 2) OVER w, lead(hq, 4) OVER w, lead(hq, 6) OVER w] AS q FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), b AS (SELECT *, coalesce(list_position(q, 0), 5) AS cut FROM a WHERE hq = 1 AND {_u("event_id", seed=7)} < 0.4)
SELECT event_id, CAST(k AS INT) AS k, CAST(2 AS BIGINT) AS epochs, true AS alike, 3 AS n_states, round(CAST(CAST(v[k + 1] AS FLOAT) AS DOUBLE), 4) AS x FROM b, unnest(range(0, 4)) AS t(k) WHERE k + 1 < cut AND v[k + 1] IS NOT NULL"""
