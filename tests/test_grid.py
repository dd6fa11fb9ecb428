"""The vector search on its grid: many cells, ties and own keys; and queries that search once."""

import os

import numpy as np
import pytest

from gleanwright import plans
from gleanwright.operators import dense

SF = "/root/testdata/sf0.001"


def test_cells_give_the_brute_force_neighbours(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 8 * 4 * 7)  # seven vectors a block
    monkeypatch.setattr(dense, "QUERY_BLOCK", 11)
    monkeypatch.setattr(dense, "SLICE", 4, raising=False)
    x = np.random.default_rng(5).integers(-2, 3, (150, 4)).astype(float)  # many ties, zero vectors too
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, vector array<double>")
    got = dense.vector_top(v, v.withColumnRenamed("vec_id", "query_id"), "vec_id", 5, others=True).collect()
    u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    s = np.round(u @ u.T, 6)
    want = {(q, c, k + 1) for q in range(150) for k, c in enumerate([j for j in np.lexsort((np.arange(150), -s[q])).tolist() if j != q][:5])}
    assert {(r.query_id, r.vec_id, r.rank) for r in got} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["class_report", "metric_delta"])
def test_a_report_does_not_search_again_in_each_of_its_counts(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan
