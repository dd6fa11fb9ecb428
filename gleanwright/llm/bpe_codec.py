"""Byte-level BPE encoding and decoding of whole columns.

encode() runs the tokenizers library, with a model made from a rank file, over the distinct pieces of each Arrow batch; decode()
looks ids up in the table of token bytes. Ids travel as packed little-endian unsigned 32-bit integers, so a row costs four bytes
a token. Defined cases: a null text is an empty text (no ids, empty bytes); a null or empty id column decodes to empty bytes; a
token sequence that ends inside a character decodes to the bytes as they are, and in text the broken character is U+FFFD. A very
long text is encoded whole; repeated rows are encoded one by one; an empty table stays empty; other columns pass unchanged, and
new ones whose names are taken get an underscore in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bytebpe
from .common import fresh, ready, texts


def packed(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each text: its ids, four bytes each."""
    data = ids.astype("<u4").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


@lru_cache(4)
def token_table(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in one array, and each token's offset and size."""
    ranks = bytebpe.read_ranks(ranks_path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    size = np.fromiter(map(len, by_id), np.int64, len(by_id))
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(size) - size, size


def token_bytes(ids: np.ndarray, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids, one after another, and where each id's end."""
    flat, off, size = token_table(ranks_path)
    n = size[ids]
    end = np.cumsum(n)
    if not len(end):
        return np.zeros(0, np.uint8), end
    return flat[np.repeat(off[ids] - (end - n), n) + np.arange(end[-1])], end


def added(df: DataFrame, names: list[str], types: list[T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in zip(names, types, strict=True))])


def encode(docs: DataFrame, ranks_path: str, column: str = "text", ids: str = "ids", offsets: str | None = None, keep: bool = True) -> DataFrame:
    """docs with packed ids of `column`; offsets, if named: for each id the code point where its first byte lies. keep=False leaves `column` out."""
    ready(docs.sparkSession)
    names = [fresh(ids, docs.columns)] + ([fresh(offsets, docs.columns)] if offsets else [])
    stay = [c for c in docs.columns if keep or c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytebpe.ranks_encoder(ranks_path)
        for b in texts(batches, column):
            col = b.column(column)
            flat, off = coder.ids(col)
            out = [*map(b.column, stay), packed(flat, off)]
            if offsets:
                raw, text_off = bytebpe.column_bytes(col)
                lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                _, end = token_bytes(flat, ranks_path)
                start = np.concatenate([[0], end])[: len(flat)]
                before = np.concatenate([[0], lead])[text_off[:-1]]
                at = lead[start] - 1 - np.repeat(before, np.diff(off)) if len(flat) else np.zeros(0, np.int64)
                out.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(at, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=[*stay, *names])

    return docs.mapInArrow(run, added(docs.select(*stay), names, [T.BinaryType(), T.ArrayType(T.IntegerType())][: len(names)]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded", text: bool = False) -> DataFrame:
    """df with the bytes, or with text=True the text, of the packed ids in `ids`."""
    ready(df.sparkSession)
    name = fresh(out, df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches, ids):
            col = pa.compute.fill_null(b.column(ids).cast(pa.large_binary()), b"")
            off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
            flat = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view("<u4")
            data, end = token_bytes(flat, ranks_path)
            at = np.concatenate([[0], end])[(off - off[0]) // 4]
            got = pa.Array.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            got = pa.array([x.decode("utf-8", "replace") for x in got.to_pylist()], pa.string()) if text else got.cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, name])

    return df.mapInArrow(run, added(df, [name], [T.StringType() if text else T.BinaryType()]))
