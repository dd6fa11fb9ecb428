"""Parents and children, grids of tables, scopes that widen, table functions."""

import random

import pytest
from pyspark.errors import AnalysisException

from gleanwright.operators import chunking, grids, html, nested, scopes, table_functions


def test_children_lie_in_their_parents(spark):
    texts = [(k, " ".join(f"w{i}" for i in range(n))) for k, n in enumerate([0, 1, 9, 10, 11, 40, 57])] + [(99, None)]
    df = spark.createDataFrame(texts, "knowledge_id long, content string")
    rows = nested.parents_and_children(df, parent=20, child=9, overlap=3).collect()
    words = {k: (t or "").split() for k, t in texts}
    seen = {}
    for r in rows:
        assert r.parent_start <= r.child_start < r.child_end <= r.parent_end <= r.parent_start + 20 and r.child_end - r.child_start <= 9
        assert r.content.split() == words[r.knowledge_id][r.child_start : r.child_end] and r.child_id.startswith(r.parent_id)
        seen.setdefault(r.knowledge_id, set()).update(range(r.child_start, r.child_end))
    assert {k: len(v) for k, v in seen.items()} == {k: len(w) for k, w in words.items() if w}
    assert len({r.child_id for r in rows}) == len(rows)
    with pytest.raises(ValueError):
        nested.parents_and_children(df, parent=5, child=9, overlap=3)


def test_each_parent_once_with_its_best_child(spark):
    children = spark.createDataFrame([(f"p{p}", f"p{p}.{c}", p, p + 9, c, c + 1) for p in range(3) for c in range(3)], "parent_id string, child_id string, parent_start int, parent_end int, child_start int, child_end int")
    hits = spark.createDataFrame([(1, "p0.1", 2.0), (1, "p0.0", 2.0), (1, "p1.2", 5.0), (1, "p1.1", 4.0), (1, "p2.0", 2.0), (2, "p2.2", 1.0)], "query_id int, child_id string, score double")
    got = nested.best_parents(hits, children, 2).select("query_id", "rank", "parent_id", "child_id", "score", "n_children").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "p1", "p1.2", 5.0, 2), (1, 2, "p0", "p0.0", 2.0, 2), (2, 1, "p2", "p2.2", 1.0, 1)]


PAGE = """<h1>Guide</h1><script>var a = "<table>";</script>
<table><caption>Doses</caption>
<thead><tr><th rowspan=2>Crop<th colspan=2>Dose</tr><tr><th>Spring<th>Autumn</thead>
<tbody><tr><td rowspan=0>Corn<td>1<td>2<tr><td colspan="2">none</tr></tbody>
<tbody><tr><td>Rice<td>3 <table><tr><td>inner</table> ml<td rowspan=x colspan=-1>4</tbody></table>
<h2>Second</h2><table><tr><td>lonely"""


def test_grids_resolve_spans():
    one, inner, two = grids.tables_of(PAGE)
    texts = [[row[c].text for c in sorted(row)] for row in grids.grid(one)]
    assert texts == [["Crop", "Dose", "Dose"], ["Crop", "Spring", "Autumn"], ["Corn", "1", "2"], ["Corn", "none", "none"], ["Rice", "3 ml", "4"]]
    assert (one.title, inner.title, two.title) == ("Doses", "Guide", "Second")
    assert [[s.text for s in r.values()] for r in grids.grid(inner)] == [["inner"]] and [[s.text for s in r.values()] for r in grids.grid(two)] == [["lonely"]]
    assert grids.row_groups(one, 1, 5) == [
        (2, 3, "Doses\nCrop: Corn; Dose / Spring: 1; Dose / Autumn: 2\nCrop: Corn; Dose / Spring: none"),
        (4, 4, "Doses\nCrop: Rice; Dose / Spring: 3 ml; Dose / Autumn: 4"),
    ]
    assert grids.tables_of(None) == [] and grids.row_groups(grids.tables_of("<table><tr></table>")[0], 2, 2) == [(0, 0, "")]


def test_grid_rows_of_pages(spark):
    df = spark.createDataFrame([("a", PAGE), ("b", None), ("c", "<p>no table</p>")], "id string, html string")
    assert {(r.id, r.table_index) for r in grids.cells(df, "id").collect()} == {("a", 0), ("a", 1), ("a", 2)}
    assert grids.table_chunks(df, "id", rows=1).count() == 4
    with pytest.raises(ValueError):
        grids.table_chunks(df, "id", rows=5, most=4)


def test_scopes_widen_until_enough(spark):
    rng = random.Random(2)
    parent = {"all": None, "n1": "all", "n2": "all", **{f"s{k}": f"n{1 + k % 2}" for k in range(6)}, "lost": "gone"}
    above = scopes.closure(spark.createDataFrame(list(parent.items()), "node string, parent string"))

    def chain(n):
        out = [n]
        while parent.get(out[-1]):
            out.append(parent[out[-1]])
        return out

    assert {tuple(r) for r in above.collect()} == {(n, a, k) for n in parent for k, a in enumerate(chain(n))}
    hits = [(q, f"d{k}", round(rng.random(), 3), rng.choice(["s0", "s1", "s2", "s3", "s5", "lost", "elsewhere"])) for q in range(4) for k in range(15)]
    asked = [(0, "s0"), (1, "s4"), (2, "lost"), (3, "nowhere")]
    got = scopes.widened(spark.createDataFrame(hits, "query_id int, knowledge_id string, score double, node string"), spark.createDataFrame(asked, "query_id int, node string"), above, 4).collect()
    want = set()
    for q, at in asked:
        up = {a: k for k, a in enumerate(chain(at))} if at in parent else {}
        own = [(d, s, min((up[a] for a in (chain(n) if n in parent else []) if a in up), default=None)) for x, d, s, n in hits if x == q]
        reach = next((k for k in range(4) if sum(lv is not None and lv <= k for *_, lv in own) >= 4), None)
        kept = sorted((-s, d, lv) for d, s, lv in own if reach is None or (lv is not None and lv <= reach))[:4]
        want |= {(q, d, -s, lv, reach, r) for r, (s, d, lv) in enumerate(kept, 1)}
    assert {tuple(r) for r in got} == want


def test_table_functions_give_the_rows_of_their_operators(spark):
    table_functions.register(spark)
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (300, 500, 900, 20))
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "- one\n- two")], "knowledge_id string, content string")
    want = sorted(map(tuple, chunking.chunk_pack(df).collect()))
    got = spark.sql("SELECT knowledge_id, c.* FROM {d}, LATERAL packed_chunks(content, 650, 100, 800, 120) c", d=df)
    assert sorted(map(tuple, got.collect())) == want
    lines = df.selectExpr("knowledge_id", "posexplode(split(content, '\n')) AS (position, line)").repartition(3)
    got = spark.sql("SELECT * FROM packed_lines(TABLE(SELECT * FROM {d}), 'knowledge_id', 'position', 'line')", d=lines)
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(AnalysisException):
        spark.sql("SELECT c.* FROM {d}, LATERAL packed_chunks(content, 650, 900, 800, 120) c", d=df).collect()
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")
    walked = html.sections(pages.selectExpr("id", "html", "'u' AS url", "'s' AS source_id"), "id").select("id", "section", "subsection").collect()
    sql = spark.sql("SELECT id, s.section, s.subsection FROM {d}, LATERAL page_sections(html) s", d=pages).collect()
    assert sorted(map(str, walked)) == sorted(map(str, sql))
