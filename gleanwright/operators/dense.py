"""Exact dense retrieval: the vectors with the highest cosine for each query, by matrix products of blocks.

Vectors and queries become blocks of bounded bytes, these are dealt over a grid, and each block of queries meets each block of
vectors of its length in one cell; only a cell's best of each query leave it. Vectors (and queries) that are null or hold null or
non-finite components take no part; vectors of different lengths have no score with each other; a zero vector scores 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import finite
from ..session import by_size, ready, written
from .lexical import top

#: Bytes of a block of vectors, queries in a block, queries that are scored at once, and blocks (on average) in a row or column of the grid.
BLOCK_BYTES, QUERY_BLOCK, SLICE, GROUP = 1 << 21, 2048, 512, 16
#: Rows of a block of vectors that meet all queries of a label, queries in a block that meets them, and pairs that leave at once.
PAIR_ROWS, PAIR_QUERIES, PAIRS = 512, 256, 1 << 16
#: How far a score may be from the one that it rounds to, with room for floating sums.
SLACK = 2e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _blocks(df: DataFrame, key: str, vector: str, most: int | None = None) -> DataFrame:
    """(dim, keys, mat): unit vectors in blocks of one length, of at most BLOCK_BYTES bytes and `most` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                part = b.filter(pa.array(sizes == dim))
                rows = max(1, min(BLOCK_BYTES // (8 * dim), most or part.num_rows))
                for lo in range(0, part.num_rows, rows):
                    some = part.slice(lo, rows)
                    mat = _unit(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    keys = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), keys, pa.array([mat.astype("<f8").tobytes()], pa.binary())], names=["dim", "keys", "mat"])

    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("keys", T.ArrayType(df.schema[key].dataType)), T.StructField("mat", T.BinaryType())])
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite(vector)).select(key, F.transform(vector, lambda x: x.cast("double"))).mapInArrow(run, schema)


def _same(asked: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row of asked, row of names) of equal keys."""
    order = np.argsort(names, kind="stable")
    lo, hi = (np.searchsorted(names, asked, side, sorter=order) for side in ("left", "right"))
    run = np.repeat(np.arange(len(asked)), hi - lo)
    return run, order[np.repeat(lo, hi - lo) + np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]


def _best(k: int, names: list[str], others: bool):
    """The k best of each query among the vectors of a cell. A pair is rounded and ranked only if it reaches the query's k-th best score so far."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for a in left.to_batches():
            for i in range(a.num_rows):
                dim, asked, ask = a.column("dim")[i].as_py(), a.column("keys")[i].values, a.column("mat")[i]
                q_all, id_all = np.frombuffer(ask.as_buffer(), "<f8").reshape(-1, dim), np.array(asked.to_pylist())
                for lo in range(0, len(q_all), SLICE):
                    q, ids = q_all[lo : lo + SLICE], id_all[lo : lo + SLICE]
                    floor = np.full(len(q), -np.inf)
                    row, key, score = np.zeros(0, np.int64), None, np.zeros(0)
                    for b in right.to_batches():
                        for j in range(b.num_rows):
                            if b.column("dim")[j].as_py() != dim:
                                continue
                            of = np.array(b.column("keys")[j].values.to_pylist())
                            s = q @ np.frombuffer(b.column("mat")[j].as_buffer(), "<f8").reshape(-1, dim).T
                            if others:
                                s[_same(ids, of)] = -np.inf
                            open_ = np.flatnonzero(np.isneginf(floor))
                            least = floor.copy()
                            if len(open_) and s.shape[1] > k:
                                least[open_] = np.partition(s[open_], -k, axis=1)[:, -k]
                            r, c = np.nonzero((s >= least[:, None] - SLACK) & (s > -np.inf))
                            if not len(r):
                                continue
                            row, score = np.concatenate([row, r]), np.concatenate([score, np.round(s[r, c], 6)])
                            key = of[c] if key is None else np.concatenate([key, of[c]])
                            order = np.lexsort((key, -score, row))
                            order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
                            row, key, score = row[order], key[order], score[order]
                            size = np.bincount(row, minlength=len(q))
                            full = size >= k
                            floor[full] = score[np.cumsum(size)[full] - 1]
                    if key is not None:
                        out.append(pa.table([asked.take(pa.array(row + lo)), pa.array(key, right.schema.field("keys").type.value_type), pa.array(score)], names=names))
        none = [pa.array([], t) for t in (left.schema.field("keys").type.value_type, right.schema.field("keys").type.value_type, pa.float64())]
        return pa.concat_tables(out) if out else pa.table(none, names=names)

    return run


def vector_top(vectors: DataFrame, queries: DataFrame, key: str, k: int, query_key: str = "query_id", vector: str = "vector", others: bool = False) -> DataFrame:
    """The k vectors with the highest cosine (six decimals, ties by smaller key) for each query; others=True leaves out a query's own key.

    Blocks of queries and of vectors are dealt over the rows and columns of a grid with GROUP blocks a row or column, or fewer where
    that leaves cores idle, so a block is copied once a column (or row) and not once a block of the other side."""
    spark = vectors.sparkSession
    ready(spark)
    rows, asked = written(_blocks(vectors, key, vector)), written(_blocks(queries, query_key, vector, QUERY_BLOCK))
    n_rows, n_asked = rows.count(), asked.count()
    side = max(1, min(GROUP, math.isqrt(n_rows * n_asked // (spark.sparkContext.defaultParallelism * 4))))
    down, across = max(1, -(-n_asked // side)), max(1, -(-n_rows // side))
    place = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("mat", "keys"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = place(asked, "down", down, "across", across), place(rows, "across", across, "down", down)
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    cells = left.groupBy("down", "across").cogroup(right.groupBy("down", "across"))
    return top(cells.applyInArrow(_best(k, schema.names, others), schema), query_key, "score", key, k)


def _labelled(df: DataFrame, key: str, label: str, vector: str, most: int, names: tuple[str, str, str]) -> DataFrame:
    """(label, and by `names`: keys, length, unit vectors) in blocks of one label and length; a vector that is null or holds a null has length -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            of = b.column(1).dictionary_encode()
            codes = of.indices.to_numpy(zero_copy_only=False)
            for code, dim in sorted(set(zip(codes.tolist(), sizes.tolist(), strict=True))):
                part = b.filter(pa.array((codes == code) & (sizes == dim)))
                for lo in range(0, part.num_rows, most):
                    some = part.slice(lo, most)
                    mat = _unit(some.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)).astype("<f8").tobytes() if dim > 0 else b""
                    keys = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                    yield pa.RecordBatch.from_arrays([some.column(1).slice(0, 1), keys, pa.array([dim], pa.int32()), pa.array([mat], pa.binary())], names=[label, *names])

    kinds = (df.schema[label].dataType, T.ArrayType(df.schema[key].dataType), T.IntegerType(), T.BinaryType())
    schema = T.StructType([T.StructField(n, k) for n, k in zip((label, *names), kinds, strict=True)])
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.transform(vector, lambda x: x.cast("double")))
    return df.filter(F.col(label).isNotNull()).select(key, label, whole.alias("v")).mapInArrow(run, schema)


def pair_scores(vectors: DataFrame, queries: DataFrame, key: str, label: str, query_key: str = "query_id", vector: str = "vector") -> DataFrame:
    """(query_key, key, score): the cosine of each pair with an equal label, by matrix products of blocks; null where a vector is null or holds a null, or lengths differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, dim, mat, asked, ask_dim, ask = (b.column(c)[i] for c in ("keys", "dim", "mat", "asked", "ask_dim", "ask"))
                names, asked, dim, fits = keys.values, asked.values, dim.as_py(), dim.as_py() == ask_dim.as_py() >= 0
                block = lambda m, n: np.frombuffer(m.as_buffer(), "<f8").reshape(n, dim) if dim > 0 else np.zeros((n, 0))  # noqa: B023, E731
                x, q = (block(mat, len(names)), block(ask, len(asked)).T) if fits else (None, None)
                step = max(1, PAIRS // len(asked))
                for lo in range(0, len(names), step):
                    part = names.slice(lo, step)
                    n, m = len(part), len(asked)
                    score = pa.array((x[lo : lo + step] @ q).ravel()) if fits else pa.nulls(n * m, pa.float64())
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.tile(np.arange(m), n))), part.take(pa.array(np.repeat(np.arange(n), m))), score], names=schema.names)

    ready(vectors.sparkSession)
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    rows = _labelled(vectors, key, label, vector, PAIR_ROWS, ("keys", "dim", "mat"))
    asked = _labelled(queries, query_key, label, vector, PAIR_QUERIES, ("asked", "ask_dim", "ask"))
    return rows.join(by_size(asked, 1_000), label).drop(label).mapInArrow(run, schema)
