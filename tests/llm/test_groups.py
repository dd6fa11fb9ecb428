import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwright.llm import components, embed_dedup, minhash, topk

from .brute import near_documents, roots


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    out, shared = [], text(60)
    for base in (text(120), text(300), text(40)):
        out += [base] * 5
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.choice((1, 2, 3, 5, 8))):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    out += [text(rng.randint(20, 80)) + shared + text(rng.randint(5, 60)) for _ in range(40)]
    out += [text(rng.randint(1, 9)) for _ in range(30)] + [["Solo"], ["solo"], ["a", "b", "c"], ["A", "B", "c"]]
    texts = [" ".join(x) for x in out] + ["", None, "  \t\n", " ".join(text(20_000))]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small,block", [(32, 512), (2, 16)])
def test_near_documents(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in near_documents(rows).items()}


def test_deduplicate_keeps_columns_and_odd_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(3, t, "k"), (1, t.upper(), None), (None, t, "k"), (9, None, "k"), (8, "", "k"), (1, t.upper(), None)], "doc_id long, text string, Rep string")
    out = minhash.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(1, t.upper()), (8, ""), (9, "")]
    alone = spark.createDataFrame([(None, t), (None, t), (None, t + " and eight"), (4, "x y"), (4, "z")], "doc_id long, text string")
    assert sorted(r.text for r in minhash.deduplicate(alone).collect()) in ([t, "x y", "z"], [t + " and eight", "x y", "z"], [t, t + " and eight", "x y", "z"])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1, None):
        base = rng.standard_normal((40, 16)).astype("f4")
        rows += [(label, v.tolist()) for v in base]
        for v in base[:4]:
            rows += [(label, (v + rng.standard_normal(16) * s).astype("f4").tolist()) for s in (0.02, 0.05, 0.1, 0.15, 0.2) for _ in range(6)]
        rows += [(label, base[0].tolist())] * 7 + [(label, (base[1] * 3).tolist())]
    rows += [(0, None), (0, [0.0] * 16), (1, [float("nan")] * 16), (1, [None] + [1.0] * 15), (0, [1.0] * 3), (0, [1.0] * 3), (0, [])]
    return [(i, v, label) for i, (label, v) in enumerate(rows)]


@pytest.mark.parametrize("block", [768, 20])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df.withColumn("rep", F.lit(1))).collect()}
    ok = {i: (np.array(v, "f4").astype("f8"), lb) for i, v, lb in rows if lb is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = []
    for i, (a, la) in ok.items():
        for j, (b, lb) in ok.items():
            if j < i and la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links.append((i, j))
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    root = roots([r[0] for r in rows], links)
    assert got == {i: (n[i], root[i], root[i] == i) for i, _, _ in rows}


def test_near_vectors_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(None, [1.0], 1), (5, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in embed_dedup.near_duplicates(one).collect()) == [(-1, 0, True), (5, 0, True)]


def best(rows, queries, k):
    out = set()
    ok = {i: np.floor(256 * np.array(v, "f4").astype("f8")) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    for q in queries:
        if q in ok:
            s = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out |= {(q, r, i, -x) for r, (x, i) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("bins", [1024, 4])
def test_top_k(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "BINS", bins)
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)).astype("f4"))]
    rows += [(300 + i, [0.5] * 8) for i in range(60)] + [(400, None), (401, [float("inf")] * 8), (402, [None] * 8), (403, [1.0]), (404, [2.0]), (450, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.filter("vec_id % 50 = 0"), df, 5).collect()}
    assert got == best(rows, range(0, 451, 50), 5)
    assert topk.top_k(df.limit(0), df, 5).count() == topk.top_k(df.filter("vec_id = 50"), df.limit(0), 5).count() == 0


def test_cuts_are_swept(spark):
    from gleanwright.llm.common import cut, forget, sweep

    a, b = cut(spark.range(3)), cut(spark.range(4))
    assert a.count() == 3 and b.count() == 4
    forget(a)
    assert sweep(spark) >= 1 and sweep(spark) == 0


def test_buckets_of_any_size_go_the_same_way(spark, monkeypatch):
    """Signatures that agree in one band and in 97 minima, but in no second band: the bucket's size must not lose their pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, minhash.PERMUTATIONS, dtype="u4")
    sig = [base.copy() for _ in range(6)]
    for k, s in enumerate(sig):
        for band in range(1, minhash.BANDS):
            s[band * minhash.ROWS] ^= np.uint32(k + 1)
    monkeypatch.setattr(minhash, "FINER", 2)
    members = spark.createDataFrame([(7, k, k, len(sig), s.tobytes()) for k, s in enumerate(sig)], "key long, rep long, comp long, size long, val binary")
    flagged = minhash._blocks(members.drop("size"), minhash.FINER).groupBy("key", "i", "j").applyInPandas(lambda p: minhash._flag(p), "key long, rep long")
    assert {r.rep for r in flagged.collect()} == set(range(6))
