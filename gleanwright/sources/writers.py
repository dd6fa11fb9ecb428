"""Writers: JSON lines, CSV beside JSON lines, index tables, reject audits, and replacement that readers never see half done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8 unescaped, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def csv_and_json(df: DataFrame, csv_path: str, json_path: str) -> None:
    """The same rows as CSV with a header and as JSON lines; an empty table writes nothing."""
    if df.isEmpty():
        return
    df = df.persist()
    try:
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(csv_path)
        json_lines(df, json_path)
    finally:
        df.unpersist()


def split_rejects(df: DataFrame, reason: str, accepted_path: str, rejects_path: str) -> None:
    """Rows without a reject reason to one place, the others to another; no accepted row at all is an error."""
    if df.filter(F.col(reason).isNull()).isEmpty():
        raise ValueError("no record was accepted")
    df.filter(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(accepted_path)
    df.filter(F.col(reason).isNotNull()).write.mode("overwrite").parquet(rejects_path)


def bm25_index(postings: DataFrame, frequency: DataFrame, stats: DataFrame, path: str) -> None:
    for name, df in (("postings", postings), ("df", frequency), ("stats", stats)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def vector_index(df: DataFrame, path: str, vector: str = "vector", meta: dict[str, str] | None = None) -> None:
    """Records with their vectors, and if `meta` is given one row under `path`.meta: it, the number of rows and the vectors' length. An empty index is refused."""
    if df.isEmpty():
        raise ValueError("an empty index is not saved")
    df.write.mode("overwrite").parquet(path)
    if meta is not None:
        told = df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("dim"))
        told.withColumns({k: F.lit(v) for k, v in meta.items()}).write.mode("overwrite").parquet(f"{path}.meta")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def replace(df: DataFrame, path: str, keep_backup: bool = False) -> None:
    """Write beside `path`, then swap by rename; keep_backup keeps what was there, once, under `path`.backup."""
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    p, fs, make = _fs(df.sparkSession, path)
    if fs.exists(p):
        backup = make(f"{path}.backup")
        fs.rename(p, backup if keep_backup and not fs.exists(backup) else make(old))
    fs.rename(make(new), p)
    if fs.exists(make(old)):
        fs.delete(make(old), True)


def replace_domains(df: DataFrame, path: str, domain: str = "domain") -> None:
    """Rewrite only the partitions of the domains that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(domain).parquet(path)
