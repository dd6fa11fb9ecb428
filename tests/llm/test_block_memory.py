"""What near-duplicate blocks and Arrow batches hold at once (round 3, pipeline on check_h)."""

import random
import tracemalloc

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gleanwright.llm import common, minhash


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def test_forest_hashes_its_texts_in_slices():
    rng = random.Random(1)
    texts = [words(rng, 1200) for _ in range(600)]
    texts[599] = texts[0] + " more"
    p = pd.DataFrame({"key": 1, "rep": range(600), "comp": [0] * 599 + [1], "val": texts, "probe": [0] * 599 + [1], "i": 0, "j": 0})
    whole = list(minhash.shingle_sets(pa.array(texts[:50], pa.large_string())))
    assert all((a == b).all() for a, b in zip(whole, minhash._sets(texts)[:50], strict=True))
    tracemalloc.start()
    got = minhash._forest(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.values.tolist() == [[599, 0]] and peak < 20 * sum(map(len, texts))


def test_block_pairs_of_one_bucket_are_spread_and_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 10_000)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # joins by bucket are shuffled, as for large tables
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(400).select(F.pmod("id", F.lit(1)).cast("long").alias("key"), F.col("id").alias("rep"), (F.col("id") % 5).alias("comp"), F.repeat(F.lit("x"), 1000).alias("val"))
        got = minhash._blocks(rows, 512).withColumn("at", F.spark_partition_id()).cache()
        assert got.select("at").distinct().count() == 4
        pairs = got.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("at").alias("places")).collect()
        assert max(r.n for r in pairs) <= 50 and {r.places for r in pairs} == {1}  # two blocks of 10 on average
        met = got.filter("probe = 1").select("i", "j", F.col("rep").alias("a"), F.col("comp").alias("c")).join(got.filter("probe = 0").select("i", "j", F.col("rep").alias("b"), F.col("comp").alias("d")), ["i", "j"])
        main = got.filter("probe = 0").groupBy("comp").count().count()
        assert main == 5 and met.filter("c <> d").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().count() == 400 * 320 // 2
        got.unpersist()
    finally:
        for k in held:
            spark.conf.unset(k)


def test_batches_to_python_are_bounded_in_bytes(spark):
    common.ready(spark)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows * 10_000], pa.int64())})

    got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 30_000_000 and max(got) <= common.BATCH_BYTES + 20_000
