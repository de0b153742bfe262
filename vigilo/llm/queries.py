"""Registered queries of the corpus operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm import (ann, bag_search, bpe, hard_negatives, html_extract, imatch, ngram_join, packing, pii, quality_classifier,
                        quality_rules, suffix_dedup, toxicity)
from vigilo.llm.common import table


def fold(folds: int) -> Column:
    """Fold of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def op1_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold(3) != 1)
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


def op10_bayesian_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_l2ap_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_bag_dedup_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_random_indexing_quality": op1_random_indexing_quality,
    "op2_quality_divergence": op2_quality_divergence,
    "op3_skip_chain_pii": op3_skip_chain_pii,
    "op4_learned_partitions": op4_learned_partitions,
    "op5_wrapper_induction": op5_wrapper_induction,
    "op6_suffix_index": op6_suffix_index,
    "op7_kneser_ney_toxicity": op7_kneser_ney_toxicity,
    "op8_length_buckets": op8_length_buckets,
    "op9_bpe_rank_array": op9_bpe_rank_array,
    "op10_bayesian_jaccard": op10_bayesian_jaccard,
    "op11_l2ap_hard_negatives": op11_l2ap_hard_negatives,
    "op12_bag_dedup_search": op12_bag_dedup_search,
    "op13_imatch_fingerprints": op13_imatch_fingerprints,
}

# Words and links by the definition: pairs that share a shingle, counted.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON p.x = nx.doc_id JOIN n ny ON p.y = ny.doc_id
  WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON reach.r = l.x),
class AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id),
links AS (SELECT x AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE same) AS others FROM l GROUP BY x)
SELECT c.doc_id, c.class_id, coalesce(k.n_links, 0) AS n_links, 1 + coalesce(k.others, 0) AS n_copies
FROM class c LEFT JOIN links k ON c.doc_id = k.doc_id"""

# Every 50-byte string of every text, as hexadecimal digits, with its smallest document.
REPEATS_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM t, unnest(range(0, greatest(n - 49, 0))) r(i)),
least_doc AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least_doc m ON win.g = m.g WHERE m.d < win.doc_id),
step AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step),
run AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k),
part AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM run),
cut AS (
  SELECT p.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(t.h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS head
  FROM part p JOIN t ON p.doc_id = t.doc_id GROUP BY p.doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(c.head, '') || substr(t.h, 2 * coalesce(c.last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN cut c ON t.doc_id = c.doc_id"""

# All anchors against all rows; whole numbers are exact as doubles.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same,
         CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

# Every term of every document, weighed and added for every item that holds it.
SEARCH_SQL = r"""
WITH t AS (
  SELECT doc_id AS id, len(ts) AS n, unnest(ts) AS term
  FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                                      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts
        FROM documents)),
tf AS (SELECT id, n, term, count(*) AS tf FROM t GROUP BY id, n, term),
c AS (SELECT count(DISTINCT id) AS docs, CAST(sum(tf) AS BIGINT) AS terms FROM tf),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(c.docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf CROSS JOIN c GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                                              lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
        FROM benchmark)
  GROUP BY item_id, term),
r AS (
  SELECT q.item_id, tf.id AS doc_id,
         CAST(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM q JOIN tf ON q.term = tf.term JOIN w ON w.term = tf.term CROSS JOIN c GROUP BY q.item_id, tf.id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""

SQL: dict[str, str] = {
    "op6_suffix_index": REPEATS_SQL,
    "op10_bayesian_jaccard": JACCARD_SQL,
    "op11_l2ap_hard_negatives": NEGATIVES_SQL,
    "op12_bag_dedup_search": SEARCH_SQL,
}
