"""Hybrid retrieval: both candidate lists, an outer merge, reciprocal-rank fusion and a preference score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_size

RRF_K, PREFERENCE_WEIGHT = 60, 0.05
PREFERENCES = ("Organic", "IPM", "General")


def check_preference(value: str) -> None:
    if value not in PREFERENCES:
        raise ValueError(f"unknown recommendation preference {value!r}; known: {', '.join(PREFERENCES)}")


def rrf(*ranks: str, k: int = RRF_K) -> Column:
    """The sum of 1 / (k + rank); a missing rank adds nothing."""
    parts = [F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0)) for r in ranks]
    return sum(parts[1:], parts[0])


def preference_score(want: Column | str, have: Column | str = "recommendation_preference", organic: Column | str = "organic_eligible", ipm: Column | str = "ipm_eligible") -> Column:
    want, have, organic, ipm = (F.col(x) if isinstance(x, str) else x for x in (want, have, organic, ipm))
    half = lambda eligible: F.when((have == "General") & eligible.eqNullSafe(True), 0.5).otherwise(0.0)
    return (
        F.when(want == "Organic", F.when(have == "Organic", 1.0).otherwise(half(organic)))
        .when(want == "IPM", F.when(have == "IPM", 1.0).otherwise(half(ipm)))
        .otherwise(F.when(have == "General", 1.0).otherwise(0.8))
    )


def eligible(want: Column | str, organic: str = "organic_eligible", ipm: str = "ipm_eligible") -> Column:
    """Whether a record may serve a preference: its flag for Organic and IPM, anything for General."""
    want = F.col(want) if isinstance(want, str) else want
    return F.when(want == "Organic", F.col(organic).eqNullSafe(True)).when(want == "IPM", F.col(ipm).eqNullSafe(True)).otherwise(True)


def merge(vector_hits: DataFrame, lexical_hits: DataFrame, key: str, query_key: str = "query_id") -> DataFrame:
    """Full outer merge of two ranked lists: a missing side has no rank and score 0."""
    v = vector_hits.select(query_key, key, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    b = lexical_hits.select(query_key, key, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    return v.join(b, [query_key, key], "full_outer").withColumns({s: F.coalesce(s, F.lit(0.0)) for s in ("vector_score", "bm25_score")})


def search(merged: DataFrame, records: DataFrame, queries: DataFrame, key: str, k: int = 8, query_key: str = "query_id", crop: str | None = None) -> DataFrame:
    """The k best of each query's merged candidates that pass its filters. Filters stand above the candidate cut on purpose."""
    meta = records.select(key, "crop", "recommendation_preference", "organic_eligible", "ipm_eligible")
    out = merged.join(meta, key).join(by_size(queries), query_key).filter(eligible("preference"))
    if crop:
        out = out.filter(F.lower("crop") == F.lower(crop))
    out = out.withColumns({"rrf_score": rrf("vector_rank", "bm25_rank"), "preference_score": preference_score("preference")})
    out = out.withColumn("final_score", F.round(F.col("rrf_score") + PREFERENCE_WEIGHT * F.col("preference_score"), 6))
    order = Window.partitionBy(query_key).orderBy(F.desc("final_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), key)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
