"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, decontaminate, jaccard_join, license_scan, near_embeddings, piece_bpe, quality, secret_scan, sharding, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: Shards of the sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.report(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_duplicates": op1_embedding_near_duplicates,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_secret_scan": op4_secret_scan,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_token_files": op6_token_files,
        "op7_backoff_scores": op7_backoff_scores,
        "op8_license_scan": op8_license_scan,
        "op9_quality": op9_quality,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_duplicates": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.t),
c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.s LEFT JOIN n ON n.a = v.vec_id""",
        "op2_sharding": f"""
WITH s AS (SELECT doc_id, source, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents),
t AS (SELECT unnest(range({sharding.SLOTS})) AS slot, unnest({sharding.lookup_table(SHARDS)}) AS shard)
SELECT s.doc_id, s.source, s.slot, CAST(t.shard AS INTEGER) AS shard FROM s JOIN t USING (slot)""",
        "op3_decontamination": r"""
WITH w AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS t FROM w, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS r(i) WHERE len(ws) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM p), unnest(range(1, len(ws) - n + 2)) AS r(i)),
h AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.t = p.t),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
        "op7_backoff_scores": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
x AS (SELECT *, count(*) OVER () AS total,
  count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS c1,
  count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY doc_id, b) AS c2,
  count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS c3 FROM p),
y AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM x),
s AS (SELECT doc_id, CASE
  WHEN c IS NOT NULL AND c3 > 0 THEN ln(c3 / p2)
  WHEN b IS NOT NULL AND c2 > 0 THEN ln(c2 / p1) + CASE WHEN c IS NULL THEN 0 ELSE ln(0.4) END
  ELSE ln(greatest(c1, 0.5) / greatest(total - n, 1)) + CASE WHEN b IS NULL THEN 0 WHEN c IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS z,
  CASE WHEN c IS NOT NULL THEN c3 = 0 WHEN b IS NOT NULL THEN c2 = 0 ELSE false END AS lower FROM y)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_backoff, round(z / len(w), 6) AS mean_log_score
FROM d LEFT JOIN (SELECT doc_id, sum(z) AS z, count(*) FILTER (lower) AS k FROM s GROUP BY doc_id) USING (doc_id)""",
        "op10_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS s, doc_id AS t FROM d UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.t),
c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d JOIN c ON c.s = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    }
