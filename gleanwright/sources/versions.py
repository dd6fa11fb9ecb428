"""Tables and small states whose readers see one version or the next, never anything between.

Under a path lie data folders, which nothing overwrites, and numbered commits: small JSON files that say what is current. A commit
is written beside its place and renamed into it, which fails if another writer was first; a reader takes the highest number. So a
change is one rename, a writer that dies leaves the old version current, and of two writers one gets an error and may try again.
It asks for a file system whose rename does not overwrite (HDFS, a POSIX folder), not for locks.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..session import filesystem


class Outrun(RuntimeError):
    """Another writer committed first."""


def _commits(path: str) -> str:
    return f"{path}/_commits"


def version(spark: SparkSession, path: str) -> tuple[int, dict[str, Any] | None]:
    """The number of the current version and what its commit says; 0 and None before the first."""
    fs, make = filesystem(spark, path)
    folder = make(_commits(path))
    if not fs.exists(folder):
        return 0, None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    number = max((int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json")), default=0)
    if not number:
        return 0, None
    stream = fs.open(make(f"{_commits(path)}/{number:012d}.json"))
    try:
        return number, json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, after: int, state: dict[str, Any]) -> int:
    """Make `state` current as version after + 1; Outrun if that version is there already."""
    fs, make = filesystem(spark, path)
    fs.mkdirs(make(_commits(path)))
    target, draft = make(f"{_commits(path)}/{after + 1:012d}.json"), make(f"{_commits(path)}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri())
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), gateway.new_array(rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Outrun(f"version {after + 1} of {path} was committed by another writer") from e
        raise
    return after + 1


def publish(df: DataFrame, path: str, keep: int = 1) -> int:
    """Make df the table at `path` in one step; the `keep` versions before it stay readable, older ones are deleted. Returns its number."""
    spark = df.sparkSession
    before, state = version(spark, path)
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    old = (state or {"data": []})["data"]
    number = commit(spark, path, before, {"data": [*old[-keep:], data] if keep else [data]})
    fs, make = filesystem(spark, path)
    for gone in old[:-keep] if keep else old:
        fs.delete(make(f"{path}/{gone}"), True)
    return number


def published(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The current table at `path`, or the one `back` versions before it, if it was kept."""
    _, state = version(spark, path)
    if state is None or len(state["data"]) <= back:
        raise FileNotFoundError(f"no such version of a table at {path}")
    return spark.read.parquet(f"{path}/{state['data'][-1 - back]}")
