"""Case memory: cases share states in groups, keep their numbers exact, and may come in several files at a time (F12)."""

import random

from pyspark.sql import functions as F

from gleanwright.plans import streams
from gleanwright.session import temporary
from gleanwright.streaming import memory

from test_lines_and_containment import plain_contexts


def test_states_are_as_many_as_groups_and_rows_those_of_a_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(memory, "GROUPS", 4)
    rng, second, big = random.Random(12), 1_000_000, 2**60 + 1
    cases = [None, big, big + 1, *range(60)]
    some = lambda *x: rng.choice([None, *x])
    turns = [(rng.choice(cases), rng.randrange(0, 2000) * second, k, some("corn", "rice"), some("rust"), some("north"), some("farm"), some("IPM")) for k in range(400)]
    end = [(-1, 10**12, 0, *[None] * 5)]
    base = temporary(spark, "stream")
    for rows in (turns[:200], turns[200:], end):
        spark.createDataFrame(rows, f"case long, {memory.TURN}").repartition(2).write.mode("append").parquet(f"{base}/in")
    query = memory.remember(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", 300, "3000 seconds", files=2)
    assert max(sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress) <= 4 * 4  # of cases, turns, and two of a timer
    rows = spark.read.schema(memory.CONTEXT).parquet(f"{base}/out").filter("case IS NULL OR case >= 0").collect()
    want = plain_contexts([(-7 if t[0] is None else t[0], *t[1:]) for t in turns], 300 * second)
    assert len(rows) == len(set(rows)) and {(-7 if r[0] is None else r[0], *r[1:]) for r in rows} == want


def test_what_comes_at_once_is_written_by_several_tasks(spark):
    path = temporary(spark, "stream")
    streams.arrive(spark.range(100, numPartitions=1), path, 3)
    assert spark.read.parquet(path).select(F.col("_metadata.file_path")).distinct().count() == 3
