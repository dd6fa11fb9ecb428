"""Resumable and incremental processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import filesystem


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no result yet."""
    return rows.join(done.select(key), key, "left_anti")


def process_new(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Run `step` over the files of `source` that no earlier run has seen, append the results, and end. A broken run goes on where it stopped."""
    stream = spark.readStream.schema(schema).parquet(source)
    step(stream).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def results(spark: SparkSession, sink: str) -> DataFrame | None:
    """What process_batches() has written so far, with the batch that wrote it; None before the first batch."""
    fs, make = filesystem(spark, sink)
    folder = make(sink)
    done = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return spark.read.parquet(sink) if any(d.getName().startswith("batch=") for d in done) else None


def process_batches(
    spark: SparkSession, source: str, schema, key: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 1, after_write: Callable[[int], None] | None = None
) -> None:
    """Run `step` over rows of `source` whose key has no result yet, `files` files a batch, and end.

    A batch's results are one partition, named by its number and written over. A run that dies after the write and before the commit
    is given the same batch again by the checkpoint, so its results replace themselves and each key has one. Keys that earlier
    batches have done are skipped, and of a key that a batch has twice the first row by `step`'s input order is not stated: one stays.
    after_write is called between a batch's write and its commit.
    """

    def each(rows: DataFrame, number: int) -> None:
        todo, done = rows.dropDuplicates([key]), results(rows.sparkSession, sink)
        if done is not None:
            todo = pending(todo, done.filter(F.col("batch") != number), key)
        step(todo).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if after_write:
            after_write(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_state(rows: DataFrame, case: str, order: list[str], *fields: str) -> DataFrame:
    """The last row of each case."""
    last = F.max_by(F.struct(*fields), F.struct(*order))
    return rows.groupBy(case).agg(last.alias("s")).select(case, "s.*")


def windowed_counts(rows: DataFrame, ts: str, width: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Counts in tumbling windows; with a watermark, over a stream too."""
    r = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        r = r.withWatermark(ts, watermark)
    return r.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(rows: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """(key, start, n): runs of a key's rows with less than `gap` between neighbours."""
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def positions(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)))
