"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import chat, line_dedup, media, mixing, ngram_join, sentencepieces, topk, toxicity, url_filter, warc
from .common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a PGM image, read back."""
    ship(spark)
    return media.stored_features(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of similar documents and its number of links."""
    ship(spark)
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents")).drop("th", "class_th")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back in chunks."""
    ship(spark)
    return warc.archived(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in the largest doc_id only."""
    ship(spark)
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), digest=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the first slot of the schedule that does."""
    ship(spark)
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth vector."""
    ship(spark)
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("id % 100 = 0"))


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every whole text: all their ids, with inclusion scores."""
    ship(spark)
    return sentencepieces.sample(table(spark, sf_dir, "documents"), each=True)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back."""
    ship(spark)
    return chat.digests(chat.with_injection(table(spark, sf_dir, "conversations")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, with the offsets of its offending spans."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, by rule or by its host's path templates."""
    ship(spark)
    return url_filter.judge(table(spark, sf_dir, "pages"))


SQL_3 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS head FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to,
       CAST(CASE WHEN page_id IS NOT DISTINCT FROM head THEN greatest(1, ceil(payload_bytes / 1048576)) ELSE 1 END AS INT) AS chunks
FROM m
"""

SQL_4 = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, rid, unnest(l) AS line, unnest(range(len(l))) AS i
          FROM (SELECT doc_id, rid, string_split(text, chr(10)) AS l FROM docs)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
        GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, hot.k IS NOT NULL AND keyed.doc_id <> hot.keeper AS gone
           FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""

SQL_5 = r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM docs GROUP BY source),
s AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw, row_number() OVER o AS n
      FROM per WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT *, min(CASE WHEN 2.0::DOUBLE * source_size * lw >= weight * rest THEN n END) OVER () AS first FROM s),
g AS (SELECT source, source_size,
             CASE WHEN n >= first THEN weight * (SELECT rest FROM f x WHERE x.n = x.first) / (SELECT lw FROM f x WHERE x.n = x.first)
                  ELSE 2.0::DOUBLE * source_size END AS target FROM f),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM docs),
t AS (SELECT p.*, row_number() OVER () AS rid, source_size, CAST(target AS DOUBLE) AS target, CAST(floor(target + 0.5) AS BIGINT) AS goal, coalesce('=' || p.source, '-') AS key
      FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source),
need AS (SELECT coalesce('=' || source, '-') AS key, CAST(ceil(floor(target + 0.5) / 4096) AS BIGINT) AS need FROM g WHERE floor(target + 0.5) > 0),
high AS (SELECT *, CAST(sum(need) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS high, CAST(sum(need) OVER () AS BIGINT) AS total FROM need),
bands AS (SELECT key, need, total, CAST(high - need AS DOUBLE) / CAST(total AS DOUBLE) AS low, CAST(high AS DOUBLE) / CAST(total AS DOUBLE) AS high FROM high),
points AS (SELECT slot, CAST(slot + 1 AS DOUBLE) * 0.6180339887498949::DOUBLE % 1.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT coalesce(max(total), 0) FROM bands))) AS slot)),
named AS (SELECT slot, key, need, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS block_no FROM points JOIN bands ON u >= low AND u < bands.high),
lack AS (SELECT key, total, unnest(range(have, need)) AS block_no FROM (SELECT key, need, total, (SELECT count(*) FROM named WHERE named.key = bands.key) AS have FROM bands) WHERE have < need),
plan AS (SELECT slot, key, block_no FROM named WHERE block_no < need UNION ALL SELECT total + row_number() OVER (ORDER BY block_no, key) - 1, key, block_no FROM lack),
runs AS (SELECT rid, key, goal, w + pass * source_size AS a, least(w + pass * source_size + size, goal) AS z FROM t, (VALUES (0), (1)) v(pass)),
slots AS (SELECT rid, min(slot) AS first_slot FROM runs JOIN plan ON runs.key = plan.key AND block_no BETWEEN a // 4096 AND (z - 1) // 4096 WHERE z > a GROUP BY rid)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(w + size, goal) - w) + greatest(0, least(w + source_size + size, goal) - w - source_size) AS BIGINT) AS taken,
       CAST(first_slot AS BIGINT) AS first_slot
FROM t LEFT JOIN slots USING (rid)
"""

SQL_6 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS rid
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 10
"""

SQL_8 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, sum(length(et) + length(er) + 24) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - length(et) - 11 AS s
      FROM (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et,
             replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM c))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + length(er) + 24) AS BIGINT) AS formatted_chars,
       sha256(coalesce(string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(et) AS BIGINT) || chr(10), '' ORDER BY turn NULLS FIRST, role, text, s) FILTER (role = 'assistant'), '')) AS loss_spans_sha256,
       FALSE AS rewrites
FROM e GROUP BY conv_id
"""

QUERIES = {f.__name__: f for f in (op1_media, op2_ngram_join, op3_warc, op4_line_dedup, op5_mixing, op6_topk, op7_sentencepieces, op8_chat, op9_toxicity, op10_url_filter)}
SQL = {"op3_warc": SQL_3, "op4_line_dedup": SQL_4, "op5_mixing": SQL_5, "op6_topk": SQL_6, "op8_chat": SQL_8}
