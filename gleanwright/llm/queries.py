"""The queries of this folder, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, embed_dedup, licenses, line_dedup, merkle, minhash, packing, pii, quality, secret_scan, token_counts, topk, whitening
from .oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secret_scan.joined("spans", base_only=True).cast("binary"), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"), n("markov").alias("n_markov"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), trusted)
    return out.select("doc_id", "lang", "n_symbols", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), window=1024, end_id=0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), "text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), P.path("byte_bpe_50k.json"), limit=1024, fits="fits_chars")
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = P.path("byte_bpe_50k.tiktoken")
    ids = bpe_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, keep=False)
    out = bpe_codec.decode(ids, ranks)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), bound=0.98)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda *kinds: F.size(F.filter("spans", lambda x: x["kind"].isin(*kinds))).cast("long")
    return out.select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in pii.BASE), F.sha2(pii.joined("spans", base_only=True).cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"),
        n(*pii.LEARNED).alias("n_learned"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
    return out.select("vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    n_chars = F.col("n_chars").cast("decimal(38,0)")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    out = merkle.manifest(table(spark, sf_dir, "documents"), columns, group="lang", key="doc_id", changed={"n_chars": F.when(tampered, n_chars + 1).otherwise(n_chars)})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", F.col("again").alias("folded_root"), (F.col("again") == F.col("root")).alias("verified"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_exact_topk": op10_exact_topk,
    "op11_personal_data": op11_personal_data,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}
