"""Fixed row shapes that stored indexes and rerankers rely on, and checks of what was loaded."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import verdict

#: The columns of an index row, and the metadata that a reranker's candidate carries.
INDEX_FIELDS = (
    "chunk_id", "knowledge_id", "source", "source_type", "crop", "disease", "evidence_type", "content", "recommendation_preference",
    "organic_eligible", "ipm_eligible", "title", "chunk_index", "total_chunks", "metadata",
)
RERANK_FIELDS = (
    "chunk_id", "knowledge_id", "source", "source_type", "source_uri", "document_id", "document_title", "page", "section", "subsection",
    "crop", "disease", "evidence_type", "recommendation_preference", "organic_eligible", "ipm_eligible",
)


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def index_rows(chunks: DataFrame) -> DataFrame:
    """chunks with exactly the columns of an index row; flags that are null count as false, missing columns are null."""
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("organic_eligible", "ipm_eligible") if c in chunks.columns}
    some = chunks.withColumns(flags)
    return some.select(*(F.col(c) if c in some.columns else F.lit(None).cast("string").alias(c) for c in INDEX_FIELDS))


#: Text fields of an evidence row of the service, those of them that are "Unknown" where the rows have no such column, and its scores.
EVIDENCE_FIELDS, NAMED_UNKNOWN = ("knowledge_id", "chunk_id", "source", "source_type", "crop", "disease", "evidence_type", "recommendation_preference"), ("source", "source_type")
EVIDENCE_SCORES = ("vector_score", "bm25_score", "hybrid_score")


def api_evidence(accepted: DataFrame, *keep: str) -> DataFrame:
    """accepted rows with exactly the service's evidence columns, after those in `keep`: reranker_score must be a number, the other scores may be null."""
    text = [F.col(c) if c in accepted.columns else (F.lit("Unknown") if c in NAMED_UNKNOWN else F.lit(None).cast("string")).alias(c) for c in EVIDENCE_FIELDS]
    number = lambda c: (F.col(c) if c in accepted.columns else F.lit(None)).cast("double").alias(c)
    return accepted.select(*keep, *text, F.col("reranker_score").cast("double").alias("reranker_score"), *map(number, EVIDENCE_SCORES))


def ab_rows(base: DataFrame, lora: DataFrame) -> DataFrame:
    """The 15 columns of a comparison file: two result tables of the same images side by side, and the verdict."""
    fields = ("prediction", "confidence", "truncated", "correct", "inference_time", "response")
    side = lambda df, name: [F.col(c).alias(f"{name}_{c}") for c in fields]
    both = base.select("image", "ground_truth", *side(base, "base")).join(lora.select("image", *side(lora, "lora")), "image")
    return both.withColumn("verdict", verdict("ground_truth", "base_prediction", "lora_prediction"))


def rerank_metadata(chunks: DataFrame, own: str | None = None, name: str = "metadata") -> DataFrame:
    """chunks with a map of the reranker's fields as strings, laid over the map in column `own`; missing fields are null."""
    fields = F.create_map(*(x for c in RERANK_FIELDS for x in (F.lit(c), _text(chunks, c))))
    if own:
        base = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*RERANK_FIELDS))
        fields = F.map_concat(base, fields)
    return chunks.withColumn(name, fields)


def count_check(rows: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """(by, expected, found, ok) for each expected group."""
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("found"))
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"{by} string, expected long")
    n = F.coalesce("found", F.lit(0))
    return want.join(found, by, "left").select(by, "expected", n.alias("found"), (n == F.col("expected")).alias("ok"))


def demand_counts(rows: DataFrame, by: str, expected: dict[str, int]) -> None:
    """An error that names every group whose number of rows is not the expected one."""
    wrong = count_check(rows, by, expected).filter("NOT ok").orderBy(by).collect()
    if wrong:
        raise ValueError("; ".join(f"{r[0]}: expected {r.expected}, found {r.found}" for r in wrong))


def first_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first `most` rows by `order`; None takes all."""
    return rows if most is None else rows.orderBy(order).limit(most)


def utc_stamp(c: Column | str) -> Column:
    """An instant as ISO text in UTC; the session's time zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed(began: datetime, ended: datetime) -> float:
    """Seconds between two driver times, to two decimals."""
    return round((ended - began).total_seconds(), 2)
