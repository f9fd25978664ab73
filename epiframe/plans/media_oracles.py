"""SQL of the queries of late materialization and decoding, written apart from them."""

from __future__ import annotations

from .oracles import SQL

_HASH = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|4'), 1, 8) AS BIGINT) / 4294967296.0"
_WINDOWS = f"""
e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), refs AS (SELECT a.event_id, d.d, b.event_id AS ref FROM e a, (VALUES (0), (1), (2)) AS d(d) JOIN e b ON b.user_id = a.user_id AND b.k = greatest(1, CASE WHEN a.k - 2 * d.d < 1 THEN 1 ELSE a.k - 2 * d.d END) WHERE a.event_type <> 'error')"""
SQL["late_media_windows"] = f"""
WITH {_WINDOWS}
SELECT event_id, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY d DESC) AS images, CAST(sum(strlen(CAST(ref AS VARCHAR)) + ref % 997) AS BIGINT) AS bytes FROM refs WHERE {_HASH} < 0.3 GROUP BY event_id"""
SQL["late_media_bytes"] = f"""
WITH {_WINDOWS}, kept AS (SELECT DISTINCT keep, ref FROM refs, (VALUES (1.0::DOUBLE), (0.5), (0.1)) AS t(keep) WHERE {_HASH} < keep)
SELECT keep, count(*) AS members, CAST(sum(strlen(CAST(ref AS VARCHAR)) + ref % 997) AS BIGINT) AS bytes FROM kept GROUP BY keep"""
SQL["decoded_frames"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id, 8 AS height, 8 AS width, CAST(list_sum(list_transform(v, lambda x: x % 256)) AS BIGINT) AS red, CAST(list_sum(list_transform(v, lambda x: 255 - x % 256)) AS BIGINT) AS green,
  CAST(list_sum(list_transform(v, lambda x: x // 7 % 256)) AS BIGINT) AS blue, CAST(v[64] // 7 % 256 AS INT) AS corner, CAST(list_sum(v) AS BIGINT) AS millimetres FROM v"""
SQL["qa_images_decoded"] = """
WITH c AS (SELECT DISTINCT conv_id FROM conversations), i AS (SELECT conv_id, k, 'image_' || k || '.jpg' AS suffix FROM c, unnest(range(0, 1 + conv_id % 12)) AS t(k))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY suffix) - 1 AS INT) AS n, suffix, 1 AS height, CAST(k + 1 AS INT) AS width, CAST(conv_id % 256 AS INT) AS red, CAST(k AS INT) AS green, CAST(3 * (k + 1) AS INT) AS size FROM i"""
