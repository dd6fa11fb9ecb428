import random
import re

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from gleanwright.llm import licenses, quality, topk


def test_top_k_outlives_a_lost_executor(spark, monkeypatch):
    v = np.random.default_rng(31).standard_normal((90, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(12)
    ints = np.floor(v * 256)
    want = {(q, i) for q in range(0, 90, 30) for i in sorted((i for i in range(90) if i != q), key=lambda i: (-(ints[q] @ ints[i]), i))[:5]}
    cores = iter([4])  # as many when the blocks are dealt, one from then on
    monkeypatch.setattr(topk, "ROW_BLOCK", 1)
    monkeypatch.setattr(SparkContext, "defaultParallelism", property(lambda self: next(cores, 1)))
    got = topk.top_k(df.filter(F.col("vec_id") % 30 == 0), df, k=5).collect()
    assert {(r.query_id, r.vec_id) for r in got} == want


def forms(phrase):
    """Every text that a phrase of SENTENCES stands for, with 2.0 for a version and without what may be missing."""
    p = re.sub(r"\(\[a-z0-9\.\+-\]\+\)", "mit", phrase.replace(r"\b", ""))
    p = re.sub(r"\[a-z0-9 ?\.?\+?-?\][*+]\??", "", p.replace("([0-9.]*[0-9])", "2.0")).replace(",?", "").replace("noderiv", "noderivatives").replace("[sc]", "s").replace("ation2.0", "ation 2.0")
    out = [p]
    while any("(?:" in x or "?" in x or "|" in x for x in out):
        step = []
        for x in out:
            if m := re.search(r"\(\?:([^()]*)\)(\?)?", x):
                step += [x[: m.start()] + y + x[m.end() :] for y in [*m[1].split("|"), *([""] if m[2] else [])]]
            elif "|" in x:
                step += x.split("|")
            elif m := re.search(r"(.)\?", x):
                step += [x[: m.start()] + y + x[m.end() :] for y in (m[1], "")]
            else:
                step.append(x)
        out = step
    return sorted({re.sub(" +", " ", x).strip() for x in out})


def test_every_phrase_alone_is_identified(spark):
    texts = [(name, f) for name, phrase in licenses.SENTENCES for f in forms(phrase) if re.search(phrase, f)]
    assert {n for n, _ in texts} == {n for n, _ in licenses.SENTENCES}
    # plain, in capitals, and wrapped in a comment block
    rows = [(n, v) for n, f in texts for v in (f"{f}.", f.upper(), "/* " + f.replace(" ", "\n * ") + " */")]
    out = licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert not [(r.name, r.text) for r in out if not r.sentence_ids]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Released under CC0 1.0.", ["CC0-1.0"]),
        ("Available under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("Creative Commons Attribution 4.0 International", ["CC-BY-4.0"]),
        ("Text: Attribution-NonCommercial-ShareAlike 3.0.", ["CC-BY-NC-SA-3.0"]),
        ("/* All rights\n * reserved. */", ["AllRightsReserved"]),
        ("See __CC0__ for terms", ["CC0"]),
        ("Commits 3fcc0a91 and cc0f12ab fix it.", []),
    ],
)
def test_licences_without_the_word(spark, text, want):
    assert licenses.scan(spark.createDataFrame([(text,)], "text string")).first().licenses == want


def test_quality_tables_grow_and_both_ways_of_scoring_agree(spark):
    rng = random.Random(33)
    words = ["der", "die", "Das", "haus", "Ελλάδα", "русский", "日本", "🙂", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(40)]
    model, order = quality.train(spark.createDataFrame([(t,) for t in texts], "text string")), quality.ORDER
    assert [p.count() for p, _ in model.levels] == [len({("\0" * (order - 1) + t)[k + order - n : k + order] for t in texts for k in range(len(t))}) for n in range(1, order + 1)]
    rows = spark.createDataFrame([(t,) for t in [*texts, texts[0], "Ελλάδα αδάλλΕ", "中国 日本", "x", ""]] + [(None,)], "text string")
    key = lambda r: (r.text or "", r.n_symbols)
    near, far = (sorted(quality.score(rows, model, most=most).collect(), key=key) for most in (None, 0))
    assert len(near) == len(far) == rows.count()
    for a, b in zip(near, far, strict=True):
        assert key(a) == key(b) and (a.perplexity is b.perplexity is None or abs(a.perplexity / b.perplexity - 1) < 1e-5)
    value = {r.text: r.perplexity for r in near}
    assert value["Ελλάδα αδάλλΕ"] > 5 * max(value[t] for t in texts if len(t) > 20)


def test_quality_drops_one_ordinary_word_repeated(spark):
    rng = random.Random(34)
    words = ["the", "river", "runs", "under", "old", "bridge", "and", "people", "walk", "there", "every", "day"]
    # no word twice in a row
    clean = [". ".join(" ".join(rng.sample(words, 8)).capitalize() for _ in range(8)) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*clean, "The " * 80])], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.keep_good(df, df.filter("doc_id < 120").select("doc_id")).collect()}
    assert kept == set(range(150))
