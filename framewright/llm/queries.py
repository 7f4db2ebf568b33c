"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mixing, quality, repair, warc
from .common import documents, fold, table
from .cover_tree import near_vectors
from .minhash import near_duplicates
from .nearest import nearest
from .token_count import count_tokens


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), "word_bpe_49k.json")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(documents(spark, sf_dir), "word_bpe_49k.json", end_id=1)


def op6_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict_language(docs, langid.fit(docs, k=3, held_out=1))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), k=5, remainder=0)
    found = quality.score_quality(docs, model, threshold=0.3)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


#: All pairs that share a shingle, then what each document can reach.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM d),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p WHERE 100 * c >= 80 * (na + nb - c)), e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.j FROM r JOIN e ON r.m = e.i),
g AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN g USING (doc_id)
"""

NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL),
n AS (SELECT *, list_inner_product(x, x) AS q FROM v WHERE list_inner_product(x, x) > 0 AND isfinite(list_inner_product(x, x))),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b USING (label) WHERE a.vec_id < b.vec_id AND list_inner_product(a.x, b.x) / sqrt(a.q * b.q) >= 0.98),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, e.j FROM r JOIN e ON r.m = e.i),
g AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1), k AS (SELECT i AS vec_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM g LEFT JOIN k USING (vec_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_temperature_mixing, op3_bpe, op4_nearest_neighbours, op5_repair_token_files, op6_cover_tree_near_dedup, op7_language_id, op8_quality_classifier, op9_token_counts, op10_warc_zip)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": NEAR_DUPLICATES_SQL, "op6_cover_tree_near_dedup": NEAR_VECTORS_SQL, "op2_temperature_mixing": mixing.oracle_sql(), "op10_warc_zip": warc.ORACLE_SQL}
