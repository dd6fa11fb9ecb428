"""Texts that simple hashes confuse, and pieces whose hashes are made to clash."""

import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanwright.llm import bpe_codec, bytebpe, line_dedup, minhash, packing, token_counts

from .brute import near_documents

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(JSON)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


def thue_morse(n, a="a", b="b"):
    """The string on which every polynomial modulo a power of two meets its complement."""
    return "".join(b if k.bit_count() & 1 else a for k in range(n))


PAIRS = [t for n in (1024, 2048, 4096, 8192) for t in (thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n, "x", "Q"), thue_morse(n, "Q", "x"))]


def test_pieces_of_like_hashes_get_their_own_ids():
    got = token_counts.PrefixEncoder(JSON).counts(pa.array(PAIRS))
    assert got.tolist() == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in PAIRS]
    for coder, want in ((bytebpe.library_encoder(JSON), lambda t: LIBRARY.encode(t, add_special_tokens=False).ids), (bytebpe.ranks_encoder(RANKS), OWN.encode_ordinary)):
        ids, off = coder.ids(pa.array(PAIRS))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [want(t) for t in PAIRS]


def test_clashing_hashes_change_no_ids(monkeypatch):
    texts = ["Hello there, general reader.", "a bb a bb ccc", "", None, thue_morse(300), "  x  y\n\n z"]
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    bytebpe.library_encoder.cache_clear()
    for few in (1, 3):
        monkeypatch.setattr(bytebpe, "span_hashes", lambda buf, start, end, few=few: ((end - start) % few).astype(np.uint64))
        coder = bytebpe.library_encoder(JSON)
        for _ in range(3):
            ids, off = coder.ids(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
        bytebpe.library_encoder.cache_clear()


def test_queries_over_such_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PAIRS)], "doc_id long, text string").coalesce(1)
    want = {i: LIBRARY.encode(t, add_special_tokens=False).ids for i, t in enumerate(PAIRS)}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, JSON).collect()} == {i: len(x) for i, x in want.items()}
    for r in bpe_codec.decode(bpe_codec.encode(df, RANKS), RANKS).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == OWN.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text
    import zlib

    for r in packing.pack(df, JSON).collect():
        data = np.array([*want[r.doc_id], 0], "<u4")[r.start : r.start + r.length].tobytes()
        assert zlib.crc32(data) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id]) + 1


def test_shingles_of_such_words(spark):
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(1, " ".join([one, two] * 4)), (2, " ".join([two, one, one, two, one, two, two, one])), (3, " ".join([one] * 8)), (4, " ".join([two] * 8)), (5, one), (6, two)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_documents(rows)


def test_clashing_shingle_hashes_make_no_links(spark):
    assert minhash.linked_words("A b c d e f", "a B c d e f") and not minhash.linked_words("a b c d e f", "a b c d e g")
    assert not minhash.linked_words("", "") and minhash.linked_words("x", "X")


def test_lines_of_such_characters(spark):
    lines = [thue_morse(1024), thue_morse(1024, "b", "a"), thue_morse(1024) + "a", thue_morse(64) * 3]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert line_dedup.remove_repeated_lines(df).first().text == "\n".join([lines[0], lines[1], lines[3]])


@pytest.mark.parametrize("text", ["".join(np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)), "=" * 100_000, thue_morse(1 << 17)])
def test_long_runs_are_counted_in_bounded_time(text):
    solver = token_counts.PrefixEncoder(JSON)
    began = time.process_time()
    got = solver.counts(pa.array([text]))[0]
    assert time.process_time() - began < 5
    assert got == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_longest_prefix_within_the_limit(spark):
    texts = ["Don't we're they'll  go\n\n\n on 're 've", "a<|endoftext|>b <|endoftext|><|endoftext|>  c", "  \n\t x " * 9, "naïve 🙂🙂 ½ " * 5, "", None, "short"]
    for limit in (1, 3, 7):
        got = token_counts.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), JSON, limit=limit, fits="fits").collect()
        for r in got:
            t = r.text or ""
            fits = max(i for i in range(len(t) + 1) if len(LIBRARY.encode(t[:i], add_special_tokens=False).ids) <= limit)
            assert r.fits == (len(t) if r.n_tokens <= limit else fits), (t, limit)


def test_large_buckets_are_cut_by_further_bands(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    shared = word(60)
    rows = [(i, " ".join(shared + word(int(rng.integers(5, 60))))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " " + " ".join(word(int(rng.integers(1, 6))))) for i in range(60)]
    for name, value in (("SMALL", 2), ("BLOCK", 16), ("FINER", 8)):
        monkeypatch.setattr(minhash, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == near_documents(rows)


def test_names_that_operators_use_themselves(spark):
    df = spark.createDataFrame([(1, "same line of words\nx", 5, 6, 7, 8, 9), (2, "same line of words\ny", 5, 6, 7, 8, 9)], "doc_id long, text string, at_id int, at_fp int, AT int, fp int, n_removed int")
    out = line_dedup.remove_repeated_lines(df)
    assert out.columns == [*df.columns, "_n_removed"]
    assert {(r.doc_id, r.text, r._n_removed, r.at_id, r.n_removed) for r in out.collect()} == {(1, "same line of words\nx", 0, 5, 9), (2, "", 2, 5, 9)}
    copies = df.withColumn("own", F.lit("k")).withColumn("rep", F.lit(1))
    assert minhash.deduplicate(copies).columns == copies.columns
