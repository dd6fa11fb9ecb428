"""Rows that share an id, very many equal lines, and very large or small numbers."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwright.llm import embed_dedup, line_dedup, topk

from .brute import one_edit


def without_repeats_of_shared_ids(rows, fp):
    """(doc_id, text) -> (lines removed, text left): places are document, line, and the upper half of the text's hash."""
    places = sorted(((i, k, (fp[t] >> 32) & 0xFFFFFFFF), t, raw) for i, t in set(rows) for k, raw in enumerate(t.split("\n")))
    seen, gone = [], {}
    for (i, k, _), t, raw in places:
        line = raw.strip(" ")
        if line and any(one_edit(line, x) for x in seen):
            gone.setdefault((i, t), set()).add(k)
        if line:
            seen.append(line)
    return {(i, t): (len(g := gone.get((i, t), set())), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)) for i, t in rows}


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "alpha beta gamma"), (5, "totally different line"), (5, "alpha beta gammb")],
        [(7, "same x"), (7, "same x\nother")],
        [(7, "one line\nsame x"), (7, "two\nsame x"), (7, "two\nsame x"), (-3, "same y\nfour"), (9, "four\nfive\nonf line"), (7, "five\nsixteen")],
        [(2**63 - 1, "first line"), (-(2**63), "first line\nsecond line"), (2**63 - 1, "second lin")],
    ],
)
def test_lines_of_rows_that_share_an_id(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fp = {r.text: r.fp for r in df.select("text", F.xxhash64("text").alias("fp")).collect()}
    want = without_repeats_of_shared_ids(rows, fp)
    got = line_dedup.remove_repeated_lines(df).collect()
    texts = sorted((r.doc_id, r.n_removed, r.text) for r in got)
    assert texts == sorted((i, *want[i, t]) for i, t in rows)
    assert len(line_dedup.clean(df).collect()) == sum(bool(want[r][1].strip()) for r in rows)


def test_a_text_of_very_many_equal_lines(spark):
    n = 400_000
    df = spark.createDataFrame([(1, "\n".join(["the same line"] * n)), (2, "\n".join(f"line {k:07d} of many" for k in range(3)))], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.remove_repeated_lines(df).collect()}
    assert got[1] == (n - 1, "the same line") and got[2] == (2, "line 0000000 of many")
    assert time.perf_counter() - began < 120


def exact_best(rows, queries, k, scale=256):
    def whole(x):
        y = min(max(x * scale, -1.7e308), 1.7e308)
        return int(np.floor(y))

    ints, top = {i: [whole(float(x)) for x in v] for i, v in rows}, 2**63 - 1
    out = set()
    for q in queries:
        s = sorted((-max(-top, min(top, sum(a * b for a, b in zip(ints[q], v, strict=True)))), i) for i, v in ints.items() if i != q)[:k]
        out |= {(q, r, i, -x) for r, (x, i) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("large", [1e4, 1e6, 1e9, 3e15, 1e30, 1e300, 1.7e308])
def test_top_k_of_large_values(spark, monkeypatch, large):
    monkeypatch.setattr(topk, "ROW_BLOCK", 32)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 4)))]
    for i in (10, 50, 51, 77):
        rows[i] = (i, [large, -large, large * 0.5, 1.0] if i % 2 else [-large, 1.0, 0.25, large * 0.999999])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.filter("vec_id % 50 = 0 OR vec_id = 77"), df, 5).collect()}
    assert got == exact_best(rows, (0, 50, 77, 100), 5)


@pytest.mark.parametrize("size", [1e-320, 1e-200, 1e-3, 1e150, 1e300])
def test_near_vectors_of_any_size(spark, size):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((12, 8))
    rows = [(i, (v / np.abs(v).max()).tolist(), 1) for i, v in enumerate(base)]
    rows += [(100 + i, [x * size for x in v], 1) for i, v, _ in rows]
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in out} == {(i, 1, i % 100) for i, _, _ in rows}
