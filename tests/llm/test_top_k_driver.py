"""What exact top-k sends through the driver (round 4, F1)."""

import numpy as np

from gleanwright.llm import topk


def test_top_k_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 64)
    monkeypatch.setattr(topk, "ROW_BLOCK", 100)
    v = np.random.default_rng(41).standard_normal((600, 8))
    v[400:] = v[:200]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, [1.0, 2.0]), (603, [2.0, 1.0])]  # two with one candidate each
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).cache()
    ints = np.floor(v * 256).astype(int)
    want = {(600, 1, 603, 4 * 256**2), (603, 1, 600, 4 * 256**2)}
    for q in range(0, 600, 3):
        s = sorted((-int(ints[q] @ ints[i]), i) for i in range(600) if i != q)[:5]
        want |= {(q, r, i, -x) for r, (x, i) in enumerate(s, 1)}
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")  # a broadcast of more fails, as one beyond the driver's memory does
    try:
        got = topk.top_k(df.filter("vec_id % 3 = 0"), df, 5).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
