"""Repeated paragraphs of long texts, of null and of empty ones (F19)."""

import os
import time

import pandas as pd

from gleanwright.operators import curation
from gleanwright.plans import QUERIES


def plain(text):
    seen, out = set(), []
    for b in (b.strip() for b in text.split("\n\n")):
        k = " ".join(b.split()).lower()
        if b and k not in seen:
            seen.add(k)
            out.append(b)
    return "\n\n".join(out)


def test_a_long_text_takes_no_square_of_its_paragraphs(spark):
    text = "\n\n".join(f"{'A' if k % 2 else 'a'} {' ' * (k % 3)}word {k % 6000}" for k in range(12_000))
    start = time.monotonic()
    got = spark.createDataFrame([(text,), ("b\n\nA\n\nB \n\n\n\na",)], "t string").select(curation.dedup_blocks("t")).collect()
    assert [r[0] for r in got] == [plain(text), "b\n\nA"] and time.monotonic() - start < 60


def test_null_and_empty_texts_are_empty(spark, tmp_path):
    os.mkdir(tmp_path / "sf")
    pd.DataFrame({"doc_id": [1, 2, 3], "text": [None, "", "x\nX\ny"]}).to_parquet(tmp_path / "sf" / "documents.parquet")
    rows = QUERIES["dedup_blocks"](spark, f"file://{tmp_path}/sf").collect()
    assert {r.doc_id: r.text for r in rows} == {1: "", 2: "", 3: "x\n\ny"}
