"""The ten operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomeloom.llm import exact_dedup, gif, langid, mixing, packing, pii, simhash, spans, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op4_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages")).drop("intact")


def op7_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(_read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), blocked=urls.blocklist())


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.without_repeats(_read(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("epochs", "cut")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hierarchical_packing, op2_simhash_bktree, op3_language_id, op4_pii_skip_chain, op5_exact_dedup,
        op6_warc_chunks, op7_gif_columns, op8_url_filter, op9_sentence_spans, op10_mix_sources,
    )
}

_SQL_EXACT = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

_SQL_MIX = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 1.0) / 4503599627370496.0)
    / CASE WHEN size > 0 THEN 0.25 + 0.75 * least(1.0, 25.0 * (length(t) - length(translate(t, '.!?', ''))) / size) ELSE 0.25 END AS key
  FROM base),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3.0 * source_size AS cap,
         sum(source_size) OVER () AS total FROM src),
levelled AS (
  SELECT *, cap / w AS ratio,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aimed AS (
  SELECT l.source, l.source_size, CAST(least(cap, coalesce(s.level * w, cap)) AS DOUBLE) AS target
  FROM levelled l, (SELECT arg_min(level, ratio) AS level FROM levelled WHERE level <= ratio) s),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM aimed),
run AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
    CAST(floor(p.target - p.epochs * p.source_size + 0.5) AS BIGINT) AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM run
"""

_SQL_WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.last > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last > p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""

_SQL_URL = r"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host0, regexp_extract(rest, '^[^?#]*') AS hp FROM a),
c AS (SELECT page_id, coalesce(translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(substr(hp, length(host0) + 1), '') AS path FROM b),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT c.page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
        FROM c JOIN rules ON (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath) GROUP BY c.page_id),
listed(entry) AS (SELECT 'ads' || i || '.example.com/' FROM range(200000) t(i)
  UNION ALL SELECT 'example.net/' || lang || '/' || i FROM range(1000, 10000) t(i), (VALUES ('de'), ('en'), ('es'), ('fr')) l(lang) WHERE i % 11 = 0),
asked AS (
  SELECT page_id, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') || substr(path, 1, 1) AS entry FROM c
  UNION ALL SELECT page_id, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') || substr(path, 1, 8) FROM c),
hit AS (SELECT DISTINCT page_id FROM asked JOIN listed USING (entry))
SELECT c.page_id, c.host, c.path, fit.rule, coalesce(fit.verdict, CASE WHEN c.host = '' OR hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON c.page_id = fit.page_id LEFT JOIN hit ON c.page_id = hit.page_id
"""

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": _SQL_EXACT,
    "op6_warc_chunks": _SQL_WARC,
    "op8_url_filter": _SQL_URL,
    "op10_mix_sources": _SQL_MIX,
}
