"""Sections leave a worker in small batches, and a worker holds one page at a time as text (F25)."""

from gleanwright.operators import html


def test_sections_in_many_batches_are_those_of_the_walk(spark, monkeypatch):
    monkeypatch.setattr(html, "OUT_CHARS", 50)
    pages = [(k, f"u{k}", "s", None if k == 3 else "" if k == 4 else "".join(f"<h2>H {k} {j}</h2><h3>S {j}</h3><p>text {k} {j} {'w ' * j}</p>" for j in range(k))) for k in range(12)]
    rows = html.sections(spark.createDataFrame(pages, "page_id long, url string, source_id string, html string"), "page_id").collect()
    want = {(k, *r) for k, _, _, h in pages for r in html.section_rows(h)}
    assert len(rows) == len(want) == 66 - 3 - 4 and {(r.page_id, r.counter, r.section, r.subsection, r.content) for r in rows} == want
