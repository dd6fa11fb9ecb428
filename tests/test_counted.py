"""Counted terms: nothing is shuffled for them, memory is bounded by pieces, and documents that share a key are one."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from gleanwright.operators import lexical, segments

DOCS = [("a", "x y x"), ("b", ""), ("c", None), ("d", "z z z w"), (None, "x q"), ("e", "y"), ("d", "w v"), (None, "q q")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, text string")


def test_postings_are_made_without_a_shuffle(spark):
    p = lexical.postings(frame(spark, DOCS[:4]), "key", "text")
    assert "Aggregate" not in p._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.key, r.term, r.tf, r.dl) for r in p.collect()} == {("a", "x", 2, 3), ("a", "y", 1, 3), ("d", "z", 3, 4), ("d", "w", 1, 4)}


def test_documents_that_share_a_key_are_one(spark):
    want = Counter((k, w) for k, t in DOCS for w in (t or "").split())
    got = lexical.postings(frame(spark, DOCS), "key", "text").collect()
    assert {(r.key, r.term): r.tf for r in got} == want and len(got) == len(want)
    df = Counter(w for _, w in want)
    avg = sum(len((t or "").split()) for _, t in DOCS) / len(DOCS)
    queries = spark.createDataFrame([(1, "x x y"), (2, "w nowhere"), (3, "nowhere")], "query_id long, query string")
    scored = {(r.query_id, r.key): r.score for r in lexical.scores(frame(spark, DOCS), queries, "key", "text").collect()}
    idf = lambda w: math.log(1 + (len(DOCS) - df[w] + 0.5) / (df[w] + 0.5))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert set(scored) == {(1, "a"), (1, None), (1, "e"), (2, "d")}
    assert abs(scored[1, "a"] - (2 * idf("x") * part(2, 3) + idf("y") * part(1, 3))) < 2e-6
    assert any(abs(scored[2, "d"] - idf("w") * part(2, dl)) < 2e-6 for dl in (4, 2))  # either length


def test_tokens_are_taken_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 6, raising=False)
    monkeypatch.setattr(segments, "PIECE", 6, raising=False)
    rng = np.random.default_rng(1)
    tokens = [["t%d" % x for x in rng.integers(0, 5, n)] for n in (3, 0, 4, 9, 1, 1, 2)] + [None]
    batch = pa.RecordBatch.from_pydict({"key": list(range(8)), "tokens": pa.array(tokens, pa.list_(pa.string()))})
    out = list(lexical._count(iter([batch])))
    assert len(out) > 3
    got = {k: dict(zip(t, f, strict=True)) for b in out for k, t, f in zip(*(b.column(c).to_pylist() for c in ("key", "terms", "tfs")), strict=True)}
    assert got == {k: dict(Counter(t or [])) for k, t in enumerate(tokens)}
