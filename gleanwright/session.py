"""Sessions and size-checked joins."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is counted to have no more rows than this.
BROADCAST_ROWS = 1_000_000


def session(name: str = "gleanwright", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution, Arrow, and the last of equal map keys winning."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    return b.config(map=base | conf).getOrCreate()


def by_size(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small enough; otherwise for a shuffled join."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver found it by sys.path alone."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none it is a local one, if the executors are this process; else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/gleanwright-{spark.sparkContext.applicationId}"
    return named.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and what makes a path object."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def temporary(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, make = filesystem(spark, path)
    fs.mkdirs(make(shared_dir(spark)))
    fs.deleteOnExit(make(path))
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing will read again."""
    for path in paths:
        fs, make = filesystem(spark, path)
        fs.delete(make(path), True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what several steps read is computed once, and a lost executor repeats nothing before it."""
    spark = df.sparkSession
    ready(spark)
    path = temporary(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_table_path", None):
            delete(df.sparkSession, path)


#: Bytes of input, by the optimiser's estimate, for each core, under which rows are dealt out.
SMALL_INPUT = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its input is small (a small file is often one row group); larger inputs stay where they are. Nothing is run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL_INPUT else df
