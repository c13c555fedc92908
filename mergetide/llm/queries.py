"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embeddings, extraction, language_id, mixing, packing, quality, secrets, sharding, simhash, warc
from .common import table


def op1_html_extraction(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages"))


def op2_sharding_compaction(spark, sf_dir):
    return sharding.compacted(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, clusters=packing.near_copies(docs))


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("kept")


def op7_mixing_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ordinal", "length", F.md5("candidate").alias("candidate_md5"), "score", "is_secret")


def op9_warc_revisits(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages")).drop("url", "payload")


def op10_quality_outliers(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't' || text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, level * w > cap AS capped, max(CASE WHEN level * w > cap THEN NULL ELSE level END) OVER () AS final FROM l
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(final * w, cap) END AS target FROM f
), b AS (
  SELECT *, least(CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END, 3) AS base FROM t
), g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h
), r AS (
  SELECT g.source, g.h, g.n, b.target - b.base * b.source_size AS need, sum(g.n) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
), c0 AS (
  SELECT source, need, coalesce(max(CASE WHEN upto <= need THEN upto END), 0) AS fits, min(CASE WHEN upto > need THEN h END) AS edge, min_by(n, CASE WHEN upto > need THEN h END) AS over,
         need - coalesce(max(CASE WHEN upto <= need THEN upto END), 0) AS miss, min(CASE WHEN upto > need THEN h END) AS last
  FROM r WHERE need > 0 GROUP BY source, need
), u1 AS (  -- later documents of at most half of what is missing
  SELECT source, h, need, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM (
    SELECT d.source, d.h, p.miss AS need, sum(d.size) AS n FROM d JOIN c0 p ON d.source IS NOT DISTINCT FROM p.source WHERE p.miss > 0 AND d.h > p.last AND d.size <= p.miss / 2 GROUP BY 1, 2, 3)
), v1 AS (SELECT source, coalesce(max(CASE WHEN upto <= need THEN upto END), 0) AS fits, coalesce(min(CASE WHEN upto > need THEN h END), 1152921504606846976) AS edge, true AS some FROM u1 GROUP BY source
), c1 AS (
  SELECT p.* EXCLUDE (miss, last), p.last AS low1, v.edge AS high1, p.miss / 2 AS most1, p.miss - coalesce(v.fits, 0) AS miss, coalesce(v.edge, p.last) AS last
  FROM c0 p LEFT JOIN v1 v ON p.source IS NOT DISTINCT FROM v.source
), u2 AS (  -- later documents of at most half of what is missing
  SELECT source, h, need, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM (
    SELECT d.source, d.h, p.miss AS need, sum(d.size) AS n FROM d JOIN c1 p ON d.source IS NOT DISTINCT FROM p.source WHERE p.miss > 0 AND d.h > p.last AND d.size <= p.miss / 2 GROUP BY 1, 2, 3)
), v2 AS (SELECT source, coalesce(max(CASE WHEN upto <= need THEN upto END), 0) AS fits, coalesce(min(CASE WHEN upto > need THEN h END), 1152921504606846976) AS edge, true AS some FROM u2 GROUP BY source
), c2 AS (
  SELECT p.* EXCLUDE (miss, last), p.last AS low2, v.edge AS high2, p.miss / 2 AS most2, p.miss - coalesce(v.fits, 0) AS miss, coalesce(v.edge, p.last) AS last
  FROM c1 p LEFT JOIN v2 v ON p.source IS NOT DISTINCT FROM v.source
), u3 AS (  -- later documents of at most half of what is missing
  SELECT source, h, need, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM (
    SELECT d.source, d.h, p.miss AS need, sum(d.size) AS n FROM d JOIN c2 p ON d.source IS NOT DISTINCT FROM p.source WHERE p.miss > 0 AND d.h > p.last AND d.size <= p.miss / 2 GROUP BY 1, 2, 3)
), v3 AS (SELECT source, coalesce(max(CASE WHEN upto <= need THEN upto END), 0) AS fits, coalesce(min(CASE WHEN upto > need THEN h END), 1152921504606846976) AS edge, true AS some FROM u3 GROUP BY source
), c3 AS (
  SELECT p.* EXCLUDE (miss, last), p.last AS low3, v.edge AS high3, p.miss / 2 AS most3, p.miss - coalesce(v.fits, 0) AS miss, coalesce(v.edge, p.last) AS last
  FROM c2 p LEFT JOIN v3 v ON p.source IS NOT DISTINCT FROM v.source
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(d.size * (b.base + CASE WHEN c.need IS NULL THEN 0 WHEN c.over - (c.need - c.fits) < c.miss THEN CASE WHEN d.h <= c.edge THEN 1 ELSE 0 END
         WHEN d.h < c.edge OR (d.h > c.low1 AND d.h < c.high1 AND d.size <= c.most1) OR (d.h > c.low2 AND d.h < c.high2 AND d.size <= c.most2) OR (d.h > c.low3 AND d.h < c.high3 AND d.size <= c.most3) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN c3 c ON d.source IS NOT DISTINCT FROM c.source
"""


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x
), n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.x LEFT JOIN n ON e.vec_id = n.x
"""


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p
), d AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM h
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    return {"op3_embedding_near_dedup": OP3_SQL, "op7_mixing_sources": OP7_SQL, "op9_warc_revisits": OP9_SQL}
