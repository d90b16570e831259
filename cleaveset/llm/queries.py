"""Registered queries of this subpackage, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleaveset.llm import decontaminate, katz, langid, mixing, neighbours, ngram_join, quality, secrets, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_table(spark, sf_dir, "documents"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_mix_sources, op4_benchmark_leaks, op5_vantage_neighbours, op6_ngram_jaccard, op7_katz_scores, op8_rendezvous_shards, op9_secret_scan, op10_quality_classifier)}

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':42')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS remaining,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS others
      FROM w),
v AS (SELECT *, cap * others <= remaining * w AS full_, max(CASE WHEN NOT cap * others <= remaining * w THEN remaining / others END) OVER () AS level FROM l),
g AS (SELECT source, source_size, CASE WHEN full_ OR level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM v),
b AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM g),
o AS (SELECT doc_id, source, size, k,
             count(*) OVER (PARTITION BY source, k, doc_id, size) AS ties,
             sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
      FROM d)
SELECT o.doc_id, o.size, b.source_size, b.target,
       least(b.whole * o.size + CASE
         WHEN b.budget - b.whole * b.source_size >= o.through THEN o.size
         WHEN b.budget - b.whole * b.source_size < o.through - o.ties * o.size THEN 0
         ELSE (b.budget - b.whole * b.source_size - o.through + o.ties * o.size) // o.ties END, 2 * o.size)::BIGINT AS taken
FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source
"""

SHARD_SQL = r"""
WITH RECURSIVE t(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS crcs FROM t WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
c AS (
  SELECT doc_id, k, size, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, tab),
s AS (
  SELECT *, list_transform(range(0, 41), lambda i: {'h': substr(md5(k || ':' || i::VARCHAR), 1, 13), 's': -i}) AS scores FROM c),
p AS (
  SELECT *, list_max(scores[1:40]) AS best, scores[41] AS fresh FROM s),
q AS (
  SELECT doc_id, k, size::BIGINT AS size, text_crc32, (-best.s)::INT AS shard, CASE WHEN fresh.h > best.h THEN 40 ELSE -best.s END::INT AS grown_shard FROM p)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM q
"""

NEIGHBOUR_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT * FROM u WHERE n > 0 AND isfinite(n)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) / (q.n * c.n) AS score
      FROM w q JOIN w c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS l FROM w),
s AS (SELECT DISTINCT doc_id, unnest(l) AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM k WHERE k.a = d.doc_id)::BIGINT AS n_similar,
       least(d.doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {"op3_mix_sources": MIX_SQL, "op5_vantage_neighbours": NEIGHBOUR_SQL, "op6_ngram_jaccard": JACCARD_SQL, "op8_rendezvous_shards": SHARD_SQL}
