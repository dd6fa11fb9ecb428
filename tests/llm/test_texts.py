import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanwright.llm import line_dedup, packing, quality

from .brute import kneser_ney, one_edit, without_repeats

JSON = P.path("byte_bpe_50k.json")


def lines():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(25)]
    base += ["Page 1 of the very long report", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "short", ""]

    def edited(s):
        k, c = rng.randrange(len(s) + 1), rng.choice("xyzé")
        return rng.choice([s, s[:k] + c + s[k:], s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :], s[:k] + c + c + s[k:], f"  {s} "])

    return [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(120)]


@pytest.mark.parametrize("least", [0, 24])
def test_repeated_lines(spark, least):
    rows = [*lines(), (500, None), (501, ""), (502, "x" * 40_000), (503, "x" * 39_999 + "y"), (504, "z" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "at": F.lit("a")}).repartition(5)
    out = line_dedup.remove_repeated_lines(df, min_chars=least)
    assert out.columns == [*df.columns, "n_removed"]
    got = {r.doc_id: (r.n_removed, r.text) for r in out.collect()}
    assert got == without_repeats(rows, least)


def test_exact_repeats_alone(spark):
    df = spark.createDataFrame([(1, "a\nb\n\n a \n"), (2, "b\nbb\n")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.remove_repeated_lines(df, edits=0).collect()) == [(1, "a\nb\n\n"), (2, "bb\n")]
    with pytest.raises(ValueError):
        line_dedup.remove_repeated_lines(df, edits=2)


def test_window_keys_meet_exactly_at_one_edit():
    rng = random.Random(12)
    words = ["".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(120)]
    for parts in (line_dedup.CHARACTERS, 2, 4):
        keys = {w: set(line_dedup.window_keys(w, parts).tolist()) for w in words}
        for a in words:
            for b in words:
                if one_edit(a, b):
                    assert keys[a] & keys[b]
                elif parts == line_dedup.CHARACTERS:
                    assert not keys[a] & keys[b]


def test_clean_drops_emptied_documents(spark):
    line = "a line that is long enough to count"
    rows = [(1, line, 9), (2, f"{line}\n{line}", 9), (3, f"new words in a line of its own\n{line}", 9), (4, "", 0), (5, None, None), (None, line, 7)]
    out = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"))
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in out.filter("text IS NOT NULL").collect()) == [(0, line, 7), (1, line, 9), (3, "new words in a line of its own", 30), (4, "", 0)]
    assert line_dedup.clean(out.limit(0)).count() == 0


def pieces_fit(rows, got, window=1024):
    t = Tokenizer.from_file(JSON)
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for _, x in rows]
    want = defaultdict(int)
    for (i, _), x in zip(rows, ids, strict=True):
        want[i, len(x)] += len(x)
    have, seqs = defaultdict(int), defaultdict(list)
    known = defaultdict(list)
    for (i, _), x in zip(rows, ids, strict=True):
        known[i, len(x)].append(x)
    for g in got:
        have[g.doc_id, g.doc_tokens] += g.length
        assert any(zlib.crc32(x[g.start : g.start + g.length].tobytes()) == g.ids_crc32 for x in known[g.doc_id, g.doc_tokens])
        seqs[g.sequence_id].append((g.offset, g.length))
    assert have == want
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == window or at & (at - 1) == 0


def test_packing(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(n))
    rows = [(i, text(rng.randint(0, 900))) for i in range(150)] + [(1000 + i, text(1) + "x" * 3) for i in range(40)] + [(2000, None), (2001, ""), (2002, text(5000)), (2003, text(1023)), (2003, text(1022))]
    rows += [(3000, "same words here")] * 5 + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", F.lit(1)).repartition(4)
    got = packing.pack(df, JSON).collect()
    pieces_fit(rows, got)
    assert packing.pack(df.limit(0), JSON).count() == 0
    pieces_fit([(1, "only")], packing.pack(df.limit(0).unionByName(spark.createDataFrame([(1, "only", 1)], df.schema)), JSON).collect())


def test_plan_uses_no_more_than_there_is():
    rng = np.random.default_rng(14)
    for counts in (rng.integers(0, 30, 1024), np.zeros(1024, int), np.bincount([700] * 500 + [324] * 100, minlength=1024)):
        counts[0] = 0
        ranges, used, filled = packing.plan(counts)
        assert (used <= counts).all() and sum(k * (hi - lo) for k, lo, hi, _, _ in ranges) == filled * 1024 == int((used * np.arange(1024)).sum())
    assert filled == 100


def test_kneser_ney_against_the_formulas(spark):
    rng = random.Random(15)
    texts = ["".join(rng.choices(["the ", "cat ", "Sat", ". ", "on", " a mat", "é", "1", "\n"], k=rng.randint(1, 60))) for _ in range(30)]
    trusted = spark.createDataFrame([(t,) for t in texts] + [("",), (None,)], "text string").repartition(3)
    model = quality.train(trusted)
    symbols = lambda t: quality.symbols(pa.array([t]))[0].tolist()
    want = kneser_ney([symbols(t) for t in texts], quality.SYMBOLS, quality.ORDER)
    other = ["the cat sat", "ZZZ!!", "é", "x", "日本🙂", ""]
    rows = spark.createDataFrame([(t,) for t in [*texts, *other]] + [(None,)], "text string")
    for r in quality.score(rows, model).collect():
        p = want(symbols(r.text)) if r.text else None
        assert r.n_symbols == len(r.text or "") and (r.perplexity is None if p is None else abs(r.perplexity / p - 1) < 1e-4)


def test_classify_keeps_clean_and_drops_junk(spark):
    rng = random.Random(16)
    words = ["the", "river", "runs", "under", "old", "bridge", "and", "people", "walk", "there", "every", "day"]
    clean = [" ".join(rng.choices(words, k=40)).capitalize() + "." for _ in range(80)]
    junk = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=40)) for _ in range(8)] + ["#$%& " * 30]
    rows = [(i, t, "en", i) for i, t in enumerate(clean + junk)] + [(500, "", "en", 0), (501, None, None, 0), (502, clean[0], None, 0), (None, clean[1], "xx", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold int")
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,), (3,)], "doc_id long")
    out = quality.classify(df, trusted)
    assert out.columns == [*df.columns, "n_symbols", "perplexity", "_threshold", "kept"]
    kept = {r.doc_id for r in out.filter("kept").collect()}
    assert kept == {*range(80), 502, None}
    assert quality.keep_good(df, trusted).columns == df.columns
    assert quality.keep_good(df.limit(0), trusted).count() == 0
    assert {r.doc_id for r in quality.keep_good(df, trusted.limit(0)).collect()} == {*range(89), 502, None}


def test_thresholds_of_each_language_and_size(spark):
    data = [("a", 9, float(k)) for k in range(1, 101)] + [("a", 70, 3.0)] * 5 + [("b", 9, 5.0)] * 3 + [(None, 15, 2.0)] * 30 + [("a", 9, None)]
    rows = spark.createDataFrame(data, "lang string, n_symbols long, perplexity double")
    got = {(r.pool, r.lang, r["size"]): r.threshold for r in quality.thresholds(rows, quantile=0.9, least=20).collect()}
    assert set(got) == {(0, "a", 3), (0, None, 3), (1, None, 3), (2, "a", None), (2, None, None), (3, None, None)}
    assert 90 <= got[0, "a", 3] < 90.2 and 2 <= got[0, None, 3] < 2.01 and 86 <= got[1, None, 3] < 90


def test_many_symbols_and_few_agree():
    rng = random.Random(19)
    wide = "".join(chr(rng.choice([*range(0x4E00, 0x9000), 97, 98])) for _ in range(4000))
    for texts in (["abcab", "", "xabc" * 9], [wide, "abab", wide[:50]]):
        sym, starts = quality.symbols(pa.array(texts))
        at, which, n = quality.distinct(sym, starts)
        padded = ["\0" * (quality.ORDER - 1) + t for t in texts]
        want = [p[k : k + quality.ORDER] for p in padded for k in range(len(p) - quality.ORDER + 1)]
        assert len(at) == len(set(want)) and n.sum() == len(want) and [want[at[w]] for w in which] == want
        hi, lo = quality.grams(sym, starts, at)
        assert len(set(zip(hi.tolist(), lo.tolist(), strict=True))) == len(at)
