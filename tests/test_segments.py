"""The stored lexical index against plain scores: updates, deletes, merging, ties, and writers that meet."""

import math
import random
import re
from collections import Counter

import pytest

from gleanwright.operators import segments
from gleanwright.session import temporary
from gleanwright.sources import versions

WORDS = ["leaf", "rust", "blight", "corn", "rice", "spot", "northern_leaf", "a-b", "mildew", "soil", "the", "of", "é", "42"]


def plain(docs, queries, k):
    """{(query, rank, key, score)} by the formula."""
    tok = lambda s: re.findall(r"[a-z0-9]+(?:[_-][a-z0-9]+)*", (s or "").lower())
    rows = [(key, Counter(tok(text)), len(tok(text))) for key, text in docs]
    n, avg = len(rows), sum(x[2] for x in rows) / max(1, len(rows))
    df = Counter(t for _, c, _ in rows for t in c)
    out = set()
    for q, text in queries:
        found = []
        for key, c, dl in rows:
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / max(avg, 1e-12))) for t in tok(text) if t in c)
            if round(s, 6) > 0:
                found.append((-round(s, 6), key))
        out |= {(q, r, key, -s) for r, (s, key) in enumerate(sorted(found)[:k], 1)}
    return out


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.choice([0, 1, 3, 8, 30])))) for i in range(n)]


QUERIES = [(1, "Leaf rust"), (2, "the of the"), (3, "northern_leaf a-b, 42"), (4, "unknown words"), (5, ""), (6, None), (7, "corn " * 3 + "soil")]


def check(spark, index, docs, k=4):
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    out, work = index.search(q, k)
    got = {(r.query_id, r["rank"], r.key, r.score) for r in out.collect()}
    want = plain(docs, [(i, t) for i, t in QUERIES if t], k)
    assert {x[:3] for x in got} == {x[:3] for x in want} and len(got) == out.count()
    assert sorted(x[3] for x in got) == pytest.approx(sorted(x[3] for x in want), abs=2e-6)
    told = {r.query_id: (r.postings, r.read) for r in work.rows.collect()}
    tok = lambda s: set(re.findall(r"[a-z0-9]+(?:[_-][a-z0-9]+)*", (s or "").lower()))
    for i, t in QUERIES:
        n = sum(len(tok(t) & tok(d)) for _, d in docs)
        assert told.get(i, (0, 0))[0] == n and told.get(i, (0, 0))[1] <= n


@pytest.mark.parametrize("block,held", [(32, 1 << 19), (4, 64)])
def test_updates_deletes_and_merge(spark, monkeypatch, block, held):
    monkeypatch.setattr(segments, "BLOCK", block)
    monkeypatch.setattr(segments, "HELD", held)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string").repartition(3)
    index = segments.Index(spark, temporary(spark, "test"))
    first = texts(150, 1) + [(500, None), (501, ""), (502, "leaf rust"), (503, "leaf rust"), (504, "leaf rust"), (505, "leaf rust"), (506, "leaf rust")]
    index.add(frame(first), "id", "text")
    check(spark, index, first)
    changed = [(i, f"rust {t} soil") for i, t in texts(40, 2)] + [(900, "corn corn"), (None, "mildew leaf")]
    index.add(frame(changed), "id", "text", replace=True)
    state = [x for x in first if x[0] >= 40] + changed
    index.delete(frame([(7, ""), (60, ""), (503, ""), (12345, ""), (None, "")]).select("id"))
    state = [x for x in state if x[0] not in (7, 60, 503)]
    if block == 32:
        check(spark, index, state)
    index.add(frame([(60, "back again, leaf"), (1000, "soil"), (1000, "soil")]), "id", "text")
    state += [(60, "back again, leaf"), (1000, "soil"), (1000, "soil")]
    check(spark, index, state)
    before = (sorted(map(tuple, index.frequency().collect())), index.stats().first())
    tok = lambda s: re.findall(r"[a-z0-9]+(?:[_-][a-z0-9]+)*", (s or "").lower())
    assert dict(before[0]) == Counter(t for _, d in state for t in set(tok(d)))
    assert before[1] == (len(state), pytest.approx(sum(len(tok(d)) for _, d in state) / len(state)))
    index.merge()
    assert len(index.state()["segments"]) == 1 and not index.state()["tombstones"]
    assert (sorted(map(tuple, index.frequency().collect())), index.stats().first()) == before
    check(spark, index, state)
    index.delete(frame([(i, "") for i, _ in state if i is not None]).select("id"))
    check(spark, index, [(None, "mildew leaf")])


def test_empty_indexes(spark):
    index = segments.Index(spark, temporary(spark, "test"))
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert index.search(q, 3)[0].count() == 0 and index.stats().first() == (0, 0.0)
    index.add(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert index.search(q, 3)[0].count() == 0
    index.merge()
    assert index.search(q.limit(0), 3)[0].count() == 0


def test_many_queries_go_in_passes(spark, monkeypatch):
    monkeypatch.setattr(segments, "AT_ONCE", 4)
    docs = texts(80, 3)
    index = segments.Index(spark, temporary(spark, "test"))
    index.add(spark.createDataFrame(docs, "id long, text string").repartition(2), "id", "text")
    check(spark, index, docs)


def test_of_two_writers_one_is_told(spark):
    path = temporary(spark, "test")
    assert versions.version(spark, path) == (0, None)
    versions.publish(spark.range(3), path)
    at, state = versions.version(spark, path)
    versions.publish(spark.range(5), path)
    with pytest.raises(versions.Outrun):
        versions.commit(spark, path, at, state)
    assert versions.published(spark, path).count() == 5 and versions.published(spark, path, 1).count() == 3
    versions.publish(spark.range(6), path)
    with pytest.raises(FileNotFoundError):
        versions.published(spark, path, 2)
