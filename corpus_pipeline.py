"""The corpus pipeline: quality, line dedup, near-duplicate removal, secrets, packing, each stage over all rows of the one before.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next. All but
the last return the columns of documents. Decisions: documents that the quality model rejects go; lines that repeat an earlier
line go, and with them documents of which nothing is left; one document of each group of near duplicates stays; secrets are
replaced by a mark; what is left is packed into sequences of 1024 tokens. Null, empty, repeated and very long texts are handled
as each operator's module says; empty tables pass through. Line dedup comes before near duplicates, so of a near copy only the lines
that it changed reach the latter; what is left of it is judged as it stands.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwright.llm import line_dedup, minhash, packing, quality, secret_scan
from gleanwright.llm.common import cut, sweep, tables_so_far


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality.keep_good(docs, trusted)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, P.path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The model, the hashes and the tokenizer cannot be told in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, had = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_so_far()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        sweep(spark, had, (docs,))  # what the stage and the one before it wrote on the way
    return docs
