"""The queries op1 to op10 and pipeline, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .exact_dedup import exact_dedup
from .html_text import extract
from .license_scan import scan
from .near_dedup import near_duplicates
from .packing import pack
from .pii import sanitise
from .quality import classify
from .source_mix import mix_sources
from .topk_search import top_k
from .toxicity import toxicity


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, 65), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""

def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(text, '') AS text
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
         / (0.1 + 0.9 * len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x:
             regexp_full_match(x, '\p{L}[\p{L}''’-]*[.,;:!?]?')))
           / greatest(size, 1)) AS key
  FROM w),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
p AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fill FROM p),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
         sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM c),
l AS (SELECT *, max(CASE WHEN (budget - done) / weight_left <= fill THEN (budget - done) / weight_left END) OVER () AS level FROM f),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap))::DOUBLE AS target FROM l),
e AS (
  SELECT source, source_size, target,
         least(2, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS epochs
  FROM t)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - coalesce(
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""

def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents"), with_text=False)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85).drop("text_hash")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM s),
u AS (SELECT s, min(doc_id) AS node, any_value(n) AS n FROM (SELECT doc_id, n, list_sort(s) AS s FROM n WHERE n > 0) GROUP BY s),
x AS (SELECT node, n, unnest(s) AS g FROM u),
p AS (
  SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.g = b.g AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT node, node AS to_node FROM u UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_node),
c AS (SELECT node, min(to_node) AS component_id FROM r GROUP BY node),
k AS (
  SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id
  FROM n LEFT JOIN u ON list_sort(n.s) = u.s AND n.n > 0 LEFT JOIN c ON c.node = u.node)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM k
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_near_dedup": op9_near_dedup,
    "op10_license_scan": op10_license_scan,
}

ORACLES = {
    "op1_topk_search": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op3_source_mix": OP3_SQL,
    "op9_near_dedup": OP9_SQL,
}
