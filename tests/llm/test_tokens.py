import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanwright.llm import bpe_codec, bytebpe, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'x", "!", "1", "23", "½", "é", "ß", " ", " ", "中", "🙂", "<|endoftext|>", "<|", "|>", "İ", "_", "s", "A", "́", "\x1c", "\x85", "\0", "====", "x" * 60]
TEXT = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
LIBRARY = Tokenizer.from_file(JSON)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


def utf8(t):
    return t.encode("utf-8", "ignore").decode()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_encoders_equal_the_libraries(texts):
    texts = [utf8(t) for t in texts]
    for coder, want in ((bytebpe.library_encoder(JSON), lambda t: LIBRARY.encode(t, add_special_tokens=False).ids), (bytebpe.ranks_encoder(RANKS), OWN.encode_ordinary)):
        ids, off = coder.ids(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [want(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_every_prefix_has_its_exact_count(text):
    text = utf8(text)
    got = token_counts.prefix_encoder(JSON).prefixes(text)
    assert got == [len(LIBRARY.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_long_pieces():
    rng = random.Random(3)
    texts = ["=" * 5000, "ab" * 700, "".join(rng.choices("abcdefgh", k=3000)), " " * 999 + "x"]
    assert token_counts.prefix_encoder(JSON).counts(pa.array(texts)).tolist() == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def rows(spark):
    data = [(1, "Hello wörld, it's 42!", "x"), (2, None, None), (3, "", "y"), (1, "Hello wörld, it's 42!", "x"), (4, "<|endoftext|>" * 3 + "🙂" * 600, "z"), (None, "no id", "q")]
    return spark.createDataFrame(data, "doc_id long, text string, ids string")


def test_counts_with_nulls_and_limits(spark):
    got = token_counts.count_tokens(rows(spark), JSON, limit=1024).collect()
    assert len(got) == 6
    for r in got:
        n = len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(rows(spark).limit(0), JSON).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_files_are_counted_by_their_library(spark, name):
    got = token_counts.count_tokens(rows(spark).filter("text IS NOT NULL"), P.path(name)).collect()
    if name.endswith(".model"):
        import sentencepiece

        want = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(t))
    else:
        want = lambda t: len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids)
    assert all(r.n_tokens == want(r.text) for r in got)


def test_truncation_from_stored_counts(spark):
    t = "Don't stop  here\nplease"
    df = token_counts.prefix_counts(spark.createDataFrame([(t,), (None,)], "text string"), JSON)
    for budget in range(9):
        got = token_counts.truncate(df, budget).filter("text IS NOT NULL").first().truncated
        assert got == max((t[:i] for i in range(len(t) + 1) if len(LIBRARY.encode(t[:i], add_special_tokens=False).ids) <= budget), key=len)


def test_codec_round_trip_and_offsets(spark):
    enc = bpe_codec.encode(rows(spark), RANKS, ids="ids", offsets="starts")
    assert enc.columns == ["doc_id", "text", "ids", "_ids", "starts"]
    out = bpe_codec.decode(bpe_codec.decode(enc, RANKS, "_ids"), RANKS, "_ids", "again", text=True).collect()
    for r in out:
        ids = np.frombuffer(r._ids, "<u4").tolist()
        assert ids == OWN.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode() and r.again == (r.text or "")
        assert len(r.starts) == len(ids) and (not ids or r.starts[0] == 0) and r.starts == sorted(r.starts)
    assert bpe_codec.encode(rows(spark).limit(0), RANKS).count() == 0


def test_split_character_decodes(spark):
    ids = np.array(OWN.encode_ordinary("🙂")[:1], "<u4").tobytes()
    df = spark.createDataFrame([(bytearray(ids),), (None,)], "ids binary")
    got = bpe_codec.decode(bpe_codec.decode(df, RANKS), RANKS, out="text", text=True).orderBy(F.length("ids")).collect()
    assert bytes(got[0].decoded) == b"" and "🙂".encode().startswith(bytes(got[1].decoded)) and got[1].text == "�"
