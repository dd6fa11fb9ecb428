"""Queries that run the driver tables as streams of files, with a stop and a new start in the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as t
from ..session import temporary
from ..streaming import memory, resume
from .registry import query

GAP = 24 * 3600
#: Rows of a file, on average, beyond which what comes at once comes in several files.
FILE_ROWS = 250_000
TURNS = """turns AS (SELECT user_id AS "case", epoch_us(ts) AS "at", event_id AS seq, CASE WHEN event_type = 'view' THEN 'crop-' || event_id % 3 END AS crop,
  CASE WHEN event_type = 'click' THEN 'disease-' || event_id % 5 END AS disease, CASE WHEN event_type = 'error' THEN 'place-' || event_id % 4 END AS place,
  CASE WHEN event_type = 'signup' THEN 'home-' || user_id % 3 END AS home, CASE WHEN event_type = 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'Organic' ELSE 'IPM' END END AS preference FROM events)"""
UP_TO_NOW = 'ORDER BY "at", seq ROWS UNBOUNDED PRECEDING'
MEMORY = f"""WITH {TURNS}, g AS (SELECT *, coalesce("at" - lag("at") OVER w > {GAP}000000, false)::INT AS silent, lead("at") OVER w AS later FROM turns WINDOW w AS (PARTITION BY "case" ORDER BY "at", seq)),
i AS (SELECT *, sum(silent) OVER (PARTITION BY "case" {UP_TO_NOW}) AS island FROM g),
b AS (SELECT *, last_value(crop IGNORE NULLS) OVER (PARTITION BY "case", island ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had FROM i),
n AS (SELECT *, (sum(CASE WHEN silent = 1 OR crop <> had THEN 1 ELSE 0 END) OVER (PARTITION BY "case" {UP_TO_NOW}))::INT + 1 AS number FROM b),
c AS (SELECT "case", "at", seq, later, number, last_value(crop IGNORE NULLS) OVER own AS crop, last_value(disease IGNORE NULLS) OVER own AS disease,
  coalesce(last_value(place IGNORE NULLS) OVER own, last_value(home IGNORE NULLS) OVER whole, 'unknown') AS place, coalesce(last_value(preference IGNORE NULLS) OVER whole, 'General') AS preference
  FROM n WINDOW own AS (PARTITION BY "case", number {UP_TO_NOW}), whole AS (PARTITION BY "case" {UP_TO_NOW}))
SELECT "case", "at", seq, 'turn' AS kind, number, crop, disease, place, preference FROM c
UNION ALL SELECT "case", "at" + {GAP}000000, NULL, 'closed', number, crop, disease, place, preference FROM c WHERE later IS NULL OR later - "at" > {GAP}000000"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """events as turns of one case a user."""
    n, kind = F.col("event_id"), F.col("event_type")
    named = lambda word, by: F.concat(F.lit(f"{word}-"), by.cast("string"))
    return t.load(spark, sf, "events").select(
        F.col("user_id").alias("case"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), n.alias("seq"),
        F.when(kind == "view", named("crop", n % 3)).alias("crop"), F.when(kind == "click", named("disease", n % 5)).alias("disease"), F.when(kind == "error", named("place", n % 4)).alias("place"),
        F.when(kind == "signup", named("home", F.col("user_id") % 3)).alias("home"), F.when(kind == "signup", F.when(n % 2 == 0, "Organic").otherwise("IPM")).alias("preference"),
    )


def arrive(rows: DataFrame, path: str, files: int = 1) -> None:
    """rows as so many new files of a stream; each is written by a task of its own."""
    (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)


@query("case_memory", MEMORY)
def case_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of all turns, which come six times (in one file each, or in several where they are many), a third of them one time late; the
    stream takes what came at one time as a batch, is stopped after three times and started again."""
    base, rows = temporary(spark, "stream"), turns(spark, sf)
    low, high, n = rows.agg(F.min("at"), F.max("at"), F.count("at")).first()
    if low is None:
        return spark.createDataFrame([], memory.CONTEXT)
    width, delay = (high - low) // 5 + 1, f"{2 * ((high - low) // 5_000_000 + 1)} seconds"
    part = F.floor((F.col("at") - low) / width) + F.when(F.col("seq") % 3 == 0, 1).otherwise(0)
    files = 1 + n // (6 * FILE_ROWS)
    # a batch that were cut elsewhere would still be within the delay: what comes at one time is at most two widths behind what came before
    run = lambda: memory.remember(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", GAP, delay, files)
    for k in range(6):
        arrive(rows.filter(part == k), f"{base}/in", files)
        if k == 2:
            run()
    # a turn of nobody, long after the others, lets the watermark pass them all
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("case"), F.lit(high + 10 * width + 10 * GAP * 1_000_000).alias("at"), *rows.columns[2:])
    arrive(end, f"{base}/in")
    run()
    return spark.read.schema(memory.CONTEXT).parquet(f"{base}/out").filter(F.col("case") >= 0)


class Broken(RuntimeError):
    """What stops the run below on purpose."""


@query("resumed_results", "SELECT event_id, user_id, upper(event_type) AS answer FROM events")
def resumed_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of all events, which come four times with overlaps (in one file each, or in several where they are many); the run dies between a batch's write and its commit, and is started again."""
    base, rows = temporary(spark, "stream"), t.load(spark, sf, "events").select("event_id", "user_id", "event_type")
    files = 1 + rows.count() // (4 * FILE_ROWS)
    for k in range(4):
        arrive(rows.filter((F.col("event_id") % 4 == k) | (F.col("event_id") % 5 == k)), f"{base}/in", files)
    died = []

    def die(number: int) -> None:
        if number == 1 and not died:
            died.append(number)
            raise Broken("stopped after the write")

    step = lambda df: df.select("event_id", "user_id", F.upper("event_type").alias("answer"))
    run = lambda: resume.process_batches(spark, f"{base}/in", rows.schema, "event_id", step, f"{base}/out", f"{base}/checkpoint", files, die)
    try:
        run()
    except Exception:
        if not died:
            raise
    run()
    return resume.results(spark, f"{base}/out").drop("batch")
