"""What the operators of this folder share: written cuts of lineage, size-checked joins, Arrow batches in bounded pieces."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: A side is broadcast only if it is counted to have no more rows than this (about 80 MB of ids in each executor).
BROADCAST_ROWS = 2_000_000
#: Bytes of an Arrow batch to a Python worker, where the session sets no bound: at Spark's own 10,000 texts take tens of MB, on both sides.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver found it by sys.path alone, and get batches of bounded size."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none it is a local one, if the executors are this process; else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/gleanwright-{spark.sparkContext.applicationId}"
    return named.rstrip("/")


#: Tables that cut() has made and forget() has not deleted.
_cuts: set[str] = set()


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a lost executor costs no recomputation before it."""
    spark = df.sparkSession
    ready(spark)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _cuts.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _cuts.discard(path)


def forget(*frames: DataFrame) -> None:
    """Delete tables made by cut() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            _delete(df.sparkSession, path)


def tables_so_far() -> frozenset[str]:
    """The tables that cut() has made and that are still there."""
    return frozenset(_cuts)


def sweep(spark: SparkSession, since: frozenset[str] = frozenset(), keep: tuple[DataFrame, ...] = ()) -> int:
    """Delete the tables that cut() made in this process, but for those in `since` and `keep`; call it when no result that reads them is needed any more."""
    paths = list(_cuts - since - {getattr(df, "_cut_path", None) for df in keep})
    for path in paths:
        _delete(spark, path)
    return len(paths)


def few(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether df has no more than bound rows; reads no further than that."""
    return df.limit(bound + 1).count() <= bound


def by_size(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows it; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if few(df, bound) else df


def texts(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of text. A longer text is a slice of its own and stays whole."""
    for batch in batches:
        col, lo, size = batch.column(column), 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += n + 16
        if lo < len(lengths):
            yield batch.slice(lo)


def fresh(name: str, taken: list[str]) -> str:
    """name, lengthened until no column in `taken` has it (Spark compares without case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
