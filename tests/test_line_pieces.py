"""Line files in pieces (F14): numbers go on from piece to piece, and no task writes a whole file."""

import duckdb
import pandas as pd

from gleanwright.plans import ORACLES, QUERIES, stored
from gleanwright.session import temporary
from gleanwright.sources import readers


def test_numbers_go_on_over_pieces(spark):
    base = temporary(spark, "stored")
    texts = [f"{k:02d} {'x' * (k % 5)}" if k % 4 else " " for k in range(60)]
    for name in ("a", "b"):
        for piece in range(3):  # one file each
            spark.createDataFrame([(s,) for s in texts[piece * 20 : piece * 20 + 20]], "value string").coalesce(1).write.text(f"{base}/{name}-{piece}")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in ("a", "b"):
        fs.mkdirs(at(f"{base}/all/x={name}"))
        for piece in range(3):
            file = next(s.getPath() for s in fs.listStatus(at(f"{base}/{name}-{piece}")) if s.getPath().getName().startswith("part"))
            fs.rename(file, at(f"{base}/all/x={name}/part-{piece}.txt"))
    rows = readers.numbered_lines(spark, f"{base}/all", range_bytes=64, pieces=True).collect()
    want = {(f"x={name}", k + 1, s) for name in ("a", "b") for k, s in enumerate(texts) if s.strip()}
    assert len(rows) == len(want) and {(r.path.rsplit("/", 1)[1], r.line_number, r.line) for r in rows} == want


def test_documents_in_many_pieces_are_those_of_the_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "PIECE_BYTES", 500)
    docs = pd.DataFrame({"doc_id": list(range(-6, 194)), "lang": ["en", None] * 100, "text": [None if k % 9 == 0 else f"line {k}\nmore" for k in range(200)]})
    docs.to_parquet(tmp_path / "documents.parquet")
    seen = []
    old = readers.numbered_json
    monkeypatch.setattr(readers, "numbered_json", lambda s, path, *a, **k: seen.append(path) or old(s, path, *a, **k))
    df = QUERIES["jsonl_numbered"](spark, f"file://{tmp_path}")
    documents = docs  # noqa: F841  # read by DuckDB
    want = duckdb.sql(ORACLES["jsonl_numbered"]).fetchall()
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert len(spark.read.text(seen[0]).inputFiles()) > 4
