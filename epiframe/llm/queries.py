"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed token files of all documents, read back."""
    from .tokens import tokenize

    return tokenize(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents."""
    from .decontaminate import mark_contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC bundles of all pages, read back."""
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts on all documents."""
    from .quality import RESULTS, judge_quality

    return judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")).select("doc_id", *RESULTS)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that all documents keep when passages of earlier documents go."""
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, decoded layers included."""
    from .secrets import RESULTS, find_secrets

    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULTS)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their near-duplicate components."""
    from .simhash import with_component, with_fingerprint

    prints = with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp")
    return with_component(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by pattern and by random field."""
    from .pii import RESULTS, find_personal

    return find_personal(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULTS)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their cell's raked weight, probability and sampling decision."""
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 2).alias("weight"), F.round("probability", 9).alias("probability"), "sampled")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more documents share."""
    from .lines import drop_lines

    docs = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of all documents."""
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all documents for each benchmark item."""
    from .search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_binary, op2_decontaminate, op3_warc, op4_url_filter, op5_quality, op6_substring_dedup, op7_secrets, op8_simhash, op9_personal_data, op10_mixing, op11_line_dedup, op12_collocations, op13_lexical_search)}
WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op2_decontaminate": r"""
WITH cut AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS words FROM cut, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(k) WHERE len(w) > 0
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT r, k, size, array_to_string(w[k : k + size - 1], ' ') AS words FROM docs, (SELECT DISTINCT size FROM windows) s, unnest(range(1, len(w) - size + 2)) AS t(k)
), hits AS (
  SELECT r, k, p.size, item_id FROM places p JOIN windows v ON p.size = v.size AND p.words = v.words
), words AS (
  SELECT r, count(DISTINCT k + j) AS n_hit FROM hits, unnest(range(0, size)) AS t(j) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op3_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), d AS (
  SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 AND count(*) OVER (PARTITION BY payload_digest) > 1 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to, url AS target_uri FROM g""",
    "op6_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS words FROM docs, unnest(range(1, len(w) - 48)) AS t(k)
), first AS (
  SELECT words, min(doc_id) AS low FROM windows GROUP BY words HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, k + j AS k FROM windows JOIN first USING (words), unnest(range(0, 50)) AS t(j) WHERE doc_id > low
), kept AS (
  SELECT d.doc_id, string_agg(d.w[t.k], ' ' ORDER BY t.k) AS words, count(*) AS n FROM docs d, unnest(range(1, len(w) + 1)) AS t(k) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id AND g.k = t.k) GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM docs d LEFT JOIN kept USING (doc_id)""",
}


def _goals(d: str) -> str:
    """CTE of the goals of a dimension's values: the tempered shares of three quarters of all tokens, within their means."""
    return f"""v_{d} AS (SELECT {d} AS v, sum(tokens)::DOUBLE AS have, pow(sum(tokens) / nullif((SELECT sum(tokens) FROM cells), 0), 0.7) AS share FROM cells GROUP BY 1),
o_{d} AS (SELECT *, row_number() OVER w AS place, 0.75 * (SELECT sum(tokens) FROM cells) - coalesce(sum(have) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
  sum(share) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM v_{d} WINDOW w AS (ORDER BY have / nullif(share, 0) NULLS LAST, v)),
g_{d} AS (SELECT v, least(have, coalesce(share * (SELECT arg_min(left_over / rest, place) FROM o_{d} WHERE left_over / rest * share <= have), have)) AS goal FROM v_{d})"""


_SCALED = " ".join(f"WHEN {k} THEN least(tokens, coalesce(weight * g{k} / nullif(sum(weight) OVER (PARTITION BY {d}), 0), 0))" for k, d in enumerate(("source", "lang", "topic")))
SQL["op10_mixing"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM documents
), t AS (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'empty' WHEN len(regexp_extract_all(text, ' \| ')) * 10 >= n_tokens THEN 'tabular'
    WHEN len(regexp_extract_all(text, '[#*$%&<>{{}}\[\]=_\\]')) * 5 >= n_tokens THEN 'marked' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM d
), cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL),
{_goals("source")}, {_goals("lang")}, {_goals("topic")},
raked AS (
  SELECT 0 AS k, source, lang, topic, tokens, a.goal AS g0, b.goal AS g1, c.goal AS g2, 0.75::DOUBLE * tokens AS weight FROM cells JOIN g_source a ON source IS NOT DISTINCT FROM a.v JOIN g_lang b ON lang IS NOT DISTINCT FROM b.v JOIN g_topic c ON topic = c.v
  UNION ALL SELECT k + 1, source, lang, topic, tokens, g0, g1, g2, CASE k % 3 {_SCALED} END FROM raked WHERE k < 48
), rated AS (SELECT source, lang, topic, weight, least(1, coalesce(weight / nullif(tokens, 0), 1))::DOUBLE AS probability FROM raked WHERE k = 48)
SELECT doc_id, t.source, t.lang, t.topic, n_tokens, round(weight, 2) AS weight, round(probability, 9) AS probability,
  CAST('0x' || substr(md5(CAST(coalesce(doc_id, 0) AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled
FROM t JOIN rated r ON t.source IS NOT DISTINCT FROM r.source AND t.lang IS NOT DISTINCT FROM r.lang AND t.topic = r.topic"""
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL["op11_line_dedup"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), x AS (SELECT r, k, l[k] AS line, translate(trim(l[k], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), {_LOWER}) AS key FROM d, unnest(range(1, len(l) + 1)) AS t(k)
), hot AS (SELECT key FROM x WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), kept AS (SELECT r, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS n FROM x WHERE key NOT IN (SELECT key FROM hot) GROUP BY r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
SQL["op12_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS s(size), unnest(range(1, len(w) - size + 2)) AS t(i)
), f AS (SELECT lang, size, phrase, CAST(count(*) AS BIGINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.f // (x.f + y.f) AS BIGINT) AS score
  FROM c, unnest(range(1, size)) AS t(k) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
), low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (SELECT lang, array_to_string(w[i : i + n - 1], ' ') AS phrase, max(f) AS around FROM c, unnest(range(2, size)) AS s(n), unnest(range(1, size - n + 2)) AS t(i) GROUP BY 1, 2
), kept AS (SELECT low.* FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""
SQL["op13_lexical_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), asked AS (SELECT q, t, count(*) AS c FROM q, unnest(w) AS u(t) GROUP BY ALL
), tf AS (SELECT r, t, count(*) AS tf FROM d, unnest(w) AS u(t) WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0
), rated AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY t, docs
), sized AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * docs) // words AS m FROM d, total
), scores AS (SELECT q, r, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN tf USING (t) JOIN rated USING (t) JOIN sized USING (r) GROUP BY q, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores JOIN q USING (q) JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10"""
