"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, language, mixing, mpeg, near, packing, substring, topk, urls
from . import secrets as secret_scan
from .common import read


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(read(spark, sf_dir, "documents"), spark)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, spark)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"), spark)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"), with_text=False).drop("redacted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = language.label(docs, spark, language.learned(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), spark)


def op7_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.store(read(spark, sf_dir, "documents"), with_media=False).drop("media")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(read(spark, sf_dir, "documents"), spark, with_text=False).drop("kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), spark).select("doc_id", "size", "source_size", "target", "taken")


# The columns of three of these that SQL can express, of the same operators on the same tables.


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def urls_ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op6_urls(spark, sf_dir).select("page_id", "host", "path", "rule", ruled.alias("ruling"))


def mpeg_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mpeg(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES = {f.__name__: f for f in (op1_jaccard, op2_topk, op3_html, op4_secrets, op5_language, op6_urls, op7_mpeg, op8_packing, op9_substring, op10_mixing, secrets_base, urls_ruled, mpeg_payload)}

ORACLE_SQL = {
    "op1_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, k = x.n AND k = y.n AS same FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN links ON a = r)
SELECT doc_id, min(r) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links,
  least(doc_id, (SELECT min(b) FROM links WHERE a = doc_id AND same)) AS copy_of
FROM documents JOIN reach ON d = doc_id GROUP BY doc_id
""",
    "op9_substring": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i,
    unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS t
  FROM w WHERE len(ws) >= 13),
firsts AS (SELECT t, min(doc_id) AS f FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM win JOIN firsts USING (t) CROSS JOIN range(0, 13) r(o) WHERE f < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
""",
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS hash
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [1, 2, 3][CAST((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / weight AS ratio FROM by_source),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM capped) - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM capped),
level AS (SELECT min(level) AS level FROM (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1)),
targets AS (
  SELECT source, source_size, CASE WHEN ratio <= (SELECT level FROM level) THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT level FROM level) END AS target
  FROM levels),
budget AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM targets),
run AS (
  SELECT s.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
""",
    "secrets_base": r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM documents
""",
    "urls_ruled": r"""
WITH found AS (SELECT page_id, strpos(url, '://') AS i, url FROM pages),
rest AS (SELECT page_id, CASE WHEN i > 0 THEN substr(url, i + 3) ELSE '' END AS r FROM found),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
rules(h, p, ruling) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, h || p AS rule, ruling, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, ruling FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
""",
    "mpeg_payload": r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(greatest(1, (octet_length(b) + 63) // 64) * 64 AS BIGINT) AS payload_bytes FROM b)
SELECT doc_id, n_bytes, payload_bytes, sha256(b || unhex(repeat('00', CAST(payload_bytes - n_bytes AS BIGINT)))) AS payload_sha256 FROM n
""",
}
