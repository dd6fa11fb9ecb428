"""The driver tables in the roles that the operators work on. Each role has the same expression in SQL, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as knowledge records."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("knowledge_id"), "doc_id", "source", F.col("lang").alias("crop"), F.col("source").alias("disease"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 3 == 0, "diagnosis").otherwise("treatment").alias("evidence_type"),
        F.when(F.col("doc_id") % 4 == 2, "Organic").when(F.col("doc_id") % 4 == 3, "IPM").otherwise("General").alias("recommendation_preference"),
        ((F.col("doc_id") % 4 != 3) & (F.col("doc_id") % 5 != 0)).alias("organic_eligible"), (F.col("doc_id") % 7 != 0).alias("ipm_eligible"),
    )


RECORDS = """records AS (SELECT 'doc-' || doc_id AS knowledge_id, doc_id, source, lang AS crop, source AS disease, text AS content,
  CASE WHEN doc_id % 3 = 0 THEN 'diagnosis' ELSE 'treatment' END AS evidence_type,
  CASE WHEN doc_id % 4 = 2 THEN 'Organic' WHEN doc_id % 4 = 3 THEN 'IPM' ELSE 'General' END AS recommendation_preference,
  (doc_id % 4 <> 3 AND doc_id % 5 <> 0) AS organic_eligible, (doc_id % 7 <> 0) AS ipm_eligible FROM documents)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as query texts, with a filter language and preference by turns."""
    b = load(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.when(F.col("item_id") % 3 == 0, "Organic").when(F.col("item_id") % 3 == 1, "IPM").otherwise("General").alias("preference"),
        F.when(F.col("item_id") % 4 == 0, "en").when(F.col("item_id") % 4 == 1, "fr").when(F.col("item_id") % 4 == 2, "de").otherwise("es").alias("want_crop"),
    )


QUERIES = """queries AS (SELECT item_id AS query_id, text AS query,
  CASE WHEN item_id % 3 = 0 THEN 'Organic' WHEN item_id % 3 = 1 THEN 'IPM' ELSE 'General' END AS preference,
  CASE WHEN item_id % 4 = 0 THEN 'en' WHEN item_id % 4 = 1 THEN 'fr' WHEN item_id % 4 = 2 THEN 'de' ELSE 'es' END AS want_crop FROM benchmark)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vectors of double, with their label."""
    return load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


def record_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """knowledge_id and vector of each record: the embedding whose id is doc_id modulo their number."""
    v = vectors(spark, sf_dir)
    n = v.agg(F.count(F.lit(1)).alias("n_vec"))
    at = load(spark, sf_dir, "documents").select("doc_id").join(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n_vec")).alias("vec_id"))
    return at.join(v, "vec_id").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("knowledge_id"), "vector")


RECORD_VECTORS = """vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vector, label FROM embeddings),
record_vectors AS (SELECT d.doc_id, 'doc-' || d.doc_id AS knowledge_id, v.vector FROM documents d JOIN vecs v ON v.vec_id = d.doc_id % (SELECT count(*) FROM embeddings))"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(vectors(spark, sf_dir), F.col("query_id") == F.col("vec_id")).select("query_id", "vector")


QUERY_VECTORS = "query_vectors AS (SELECT b.item_id AS query_id, v.vector FROM benchmark b JOIN vecs v ON v.vec_id = b.item_id)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as repeated, timed predictions of one item each user."""
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("event_type").alias("prediction"), F.col("value").alias("seconds"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as labelled class folders in the four styles of folder names."""
    p = load(spark, sf_dir, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    k = F.col("p_partkey") % 4
    folder = F.when(k == 0, F.concat_ws("___", a, b)).when(k == 1, F.concat_ws("__", a, b)).when(k == 2, F.concat_ws("_", a, b)).otherwise(F.concat(b, F.lit("_healthy")))
    return p.select("p_partkey", folder.alias("folder"), a.alias("colour"), b.alias("noun"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


NAMES = """names AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN split_part(p_name, ' ', 1) || '___' || split_part(p_name, ' ', 2) WHEN 1 THEN split_part(p_name, ' ', 1) || '__' || split_part(p_name, ' ', 2)
  WHEN 2 THEN split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 2) || '_healthy' END AS folder,
  split_part(p_name, ' ', 1) AS colour, split_part(p_name, ' ', 2) AS noun, p_brand AS brand, p_type AS type FROM part)"""
