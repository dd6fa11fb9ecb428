"""Scores of pairs with an equal label by blocks, against the sum pair by pair (F26)."""

import random

import pytest
from pyspark.sql import functions as F

from gleanwright.functions import vectors
from gleanwright.operators import dense

NAN = float("nan")


@pytest.mark.parametrize("pairs", [7, 1 << 16])
def test_scores_are_those_of_the_sum_pair_by_pair(spark, monkeypatch, pairs):
    monkeypatch.setattr(dense, "PAIR_ROWS", 5)
    monkeypatch.setattr(dense, "PAIR_QUERIES", 3)
    monkeypatch.setattr(dense, "PAIRS", pairs)
    rng = random.Random(26)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [NAN, 1.0, 1.0], [1.0, 2.0]]
    some = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    v = [(f"d{k}", rng.choice(["a", "b", "c", None]), odd[k] if k < 6 else odd[k - 6] if k < 12 else some()) for k in range(60)]
    v = [(k, "a" if n < 6 else c, x) for n, (k, c, x) in enumerate(v)]
    q = [(k, ["a", "b", None, "x"][k % 4] if k > 5 else "a", odd[k] if k < 6 else some()) for k in range(24)]
    left = spark.createDataFrame(v, "knowledge_id string, c string, vector array<double>")
    right = spark.createDataFrame(q, "query_id long, c string, vector array<double>")
    unit = lambda df, name: df.withColumn(name, vectors.normalized("vector")).drop("vector")
    plain = unit(left, "v").join(unit(right, "q"), "c").select("query_id", "knowledge_id", F.round(vectors.dot("v", "q"), 6))
    got = dense.pair_scores(left, right, "knowledge_id", "c").select("query_id", "knowledge_id", F.round("score", 6))
    tidy = lambda df: sorted((r[0], r[1], "none" if r[2] is None else "nan" if r[2] != r[2] else str(r[2] + 0.0)) for r in df.collect())
    assert tidy(got) == tidy(plain) and {"none", "nan"} < {r[2] for r in tidy(got)}
