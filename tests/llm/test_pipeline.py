import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanwright.llm import common, quality, queries
from gleanwright.llm.common import cut

from .brute import kneser_ney, near_documents, without_repeats
from .test_texts import pieces_fit

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def small_corpus():
    """(doc_id, text, trusted): clean texts, junk, repeated lines, near copies and secrets."""
    rng = random.Random(41)
    words = ["river", "bridge", "people", "walk", "every", "market", "song", "window", "garden", "quiet", "letter", "stone", "winter", "under", "over"]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(8, 14))).capitalize() + "."
    texts = ["\n".join(sentence() for _ in range(rng.randint(2, 5))) for _ in range(90)]
    texts[10:40] = [f"{t} The password = hunter{k}hunter{k} and AKIAQWERTYUIOPASDFG{chr(65 + k % 26)} too." for k, t in enumerate(texts[10:40])]
    texts += [texts[3], texts[4] + "\n" + sentence(), texts[5] + "\n" + texts[6], texts[7].replace("river", "rivers", 1)]
    texts += [" ".join(w.upper() + "!!" for w in rng.choices(words, k=30)) for _ in range(5)] + ["#$%& " * 20, "River " * 50, "", None]
    one = texts[50].split()
    texts += [" ".join([*one[:-1], "stone."])]  # on one line, and one word other
    return [(i, t, i < 60) for i, t in enumerate(texts)]


def plain_pipeline(rows, side):
    """doc_id -> text of what goes to packing. side: of a text, the half that it is in."""
    codes = lambda t: [ord(c) + 1 for c in t]
    trusted = [t for _, t, good in rows if good and t]
    held = [t for t in trusted if side[t]]
    of = lambda texts: kneser_ney([codes(t) for t in texts], quality.SYMBOLS, quality.ORDER)
    half, whole = of([t for t in trusted if not side[t]]), of(trusted)
    steps = sorted(math.floor(math.log(half(codes(t))) / quality.STEP) for t in held)
    limit = math.exp((steps[math.ceil(quality.QUANTILE * len(steps)) - 1] + 1) * quality.STEP)
    good = [(i, t) for i, t, _ in rows if t and whole(codes(t)) <= limit]
    lines = [(i, t) for i, (n, t) in without_repeats(good).items() if not n or t.strip()]
    alone = near_documents(lines)
    kept = [(i, t) for i, t in lines if alone[i][1] == i]
    return {i: re.sub(r"password = hunter\d+hunter\d+|AKIA[A-Z]{16}", "[SECRET]", t) for i, t in kept}


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = small_corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(good)) for i, _, good in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    side = {r.text: r.s for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("s")).collect()}
    want = plain_pipeline(rows, side)
    assert 60 < len(want) < len(rows) - 8 and sum("[SECRET]" in t for t in want.values()) == 30
    had = common.tables_so_far()
    got = corpus_pipeline.run(spark, str(tmp_path))
    pieces_fit(sorted(want.items()), got.collect())
    assert len(common.tables_so_far() - had) == 1  # the result; the rest is swept


@needs_tables
def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "token = abcdef123456 is what the note says and nothing more.", "en", "s", 60)], docs.schema)
    now = docs.unionByName(extra).withColumn("spans", F.lit("own"))
    columns, sizes = now.columns, [now.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, SF))
        assert now.columns == columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert now.filter(F.col("text").rlike(r"token = [\"a-f0-9]{6}")).count() == 0
    got = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}


@needs_tables
def test_stages_of_no_documents(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = queries.QUERIES[name](spark, SF).count()
    if name.startswith("op12"):  # eight components of each vector
        assert got == 8 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
        return
    assert got == docs or name.startswith(("op4", "op9", "op10")) and got > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    r = c.execute(queries.ORACLES[name])
    names = [d[0] for d in r.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, ([x[c] for c in names] for x in df.collect()))) == sorted(str(list(x)) for x in r.fetchall())
