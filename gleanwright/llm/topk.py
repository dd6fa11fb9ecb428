"""Exact top-k by inner product: distributed histogram selection.

Every query is scored against every row, block of queries by block of rows. No score leaves its block at first: each block only
reports, for each query, how many of its k highest scores in the query's interval lie in which bin.
Summed over all blocks these histograms tell which bin holds the k-th highest score; that bin is the next interval, until it is
one value wide. A last pass keeps what reaches that value, at most k of a block, ties by smaller id. So what is shuffled grows
with queries times blocks, and no group holds more than k rows of a block.

Vectors become integers, floor(scale * x), and scores are exact, whatever their size; one beyond a long is the nearest long. Defined cases: vectors (or ids) that are null or hold null or
non-finite components take no part; vectors of different lengths have no score with each other; of rows that share a query's id
the smallest vector is the query, and none of them is its candidate; repeated candidate rows count each; columns beside id_col and
vector are not read, whatever their names; without queries or candidates there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, ready

BINS, ROW_BLOCK, QUERY_BLOCK = 1 << 16, 4096, 512
#: The largest score; its negative is the least.
TOP = (1 << 63) - 1


def usable(vector: str):
    """Whether a vector column is free of nulls and of components that are null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def integers(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger doubles are integers
    v = F.transform(vector, lambda x: whole(F.greatest(F.least(x.cast("double") * scale, F.lit(1.7e308)), F.lit(-1.7e308))))
    return df.filter(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _packed(rows: int):
    """Blocks of at most `rows` vectors of one length, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(n):
                part = b.filter(pa.array(n == dim))
                for lo in range(0, part.num_rows, rows):
                    some = part.slice(lo, rows)
                    mat = some.column("v").flatten().to_numpy(zero_copy_only=False)
                    rest = {c: some.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in some.schema.names if c != "v"}
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([int(dim)], pa.int32()), "v": [mat.astype("<f8").tobytes()], **{c: [x] for c, x in rest.items()}})

    return run


def _grid(queries: DataFrame, rows: DataFrame, slots: int) -> DataFrame:
    """Each block of queries beside each block of rows of its length; slots: as many as the blocks of rows were dealt over.

    By merge join: Spark guesses blocks at a hundred bytes, and else sends the queries' copies for all slots through the driver.
    """
    q = queries.mapInArrow(_packed(QUERY_BLOCK), "dim int, v binary, id binary, lo binary, step binary, above binary").withColumnRenamed("v", "qv").withColumnRenamed("id", "qid")
    q = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return q.join(rows.hint("merge"), ["dim", "slot"]).select("qid", "qv", "lo", "step", "above", "id", "v", "dim")


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers (as doubles), in longs; beyond these the nearest."""
    dim = q.shape[1]
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    with np.errstate(over="ignore"):
        size_q, size_v = np.abs(q).max(1), np.abs(v).max(1)
        most = size_q.max() * size_v.max() * dim
        if most < 2**53:
            return (q @ v.T).astype(np.int64)
        if most < 2**62:
            return q.astype(np.int64) @ v.astype(np.int64).T
        far = size_q[:, None] * size_v * dim >= 2**62
    near = lambda x, size: np.where(size[:, None] < 2.0**62, x, 0.0).astype(np.int64)
    s = near(q, size_q) @ near(v, size_v).T
    for i in np.flatnonzero(far.any(1)):  # products that no long is sure to hold, by Python's integers
        at = np.flatnonzero(far[i])
        own = [*map(int, q[i])]
        s[i, at] = [max(-TOP, min(TOP, sum(map(mul, own, map(int, row))))) for row in v[at]]
    return s


def _scores(b: pa.RecordBatch) -> Iterator[tuple]:
    """Of each row of the grid: the query's columns, the rows' ids, and the scores with the query's own rows at the lowest value."""
    for i in range(b.num_rows):
        x = {c: b.column(c)[i].as_py() for c in b.schema.names}
        qid, lo, step, above, ids = (np.frombuffer(x[c], "<i8") for c in ("qid", "lo", "step", "above", "id"))
        q, v = np.frombuffer(x["qv"], "<f8").reshape(len(qid), x["dim"]), np.frombuffer(x["v"], "<f8").reshape(len(ids), x["dim"])
        yield qid, lo, step, above, ids, inner(q, v), ids[None, :] != qid[:, None]


def _histogram(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qid, lo, step, above, _, s, other in _scores(b):
                none = np.iinfo(np.int64).min
                above_lo = s.view(np.uint64) - lo[:, None].view(np.uint64)  # right also where a long would overflow
                s[~(other & (s >= lo[:, None]) & (above_lo < np.uint64(width)))] = none
                # a score below k others of this block cannot decide where the k-th of all lies
                high = np.partition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else s
                rows, at = np.nonzero(high > none)
                code, n = np.unique(rows * BINS + ((high[rows, at].view(np.uint64) - lo[rows].view(np.uint64)) // step[rows].view(np.uint64)).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"id": qid[code // BINS], "bin": code % BINS, "n": n})

    return run


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qid, lo, _, _, ids, s, other in _scores(b):
                rows, cols = np.nonzero(other & (s >= lo[:, None]))
                score, vec = s[rows, cols], ids[cols]
                order = np.lexsort((vec, -score, rows))
                rows, score, vec = rows[order], score[order], vec[order]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                keep = nth < k
                yield pa.RecordBatch.from_pydict({"query_id": qid[rows[keep]], "vec_id": vec[keep], "score": score[keep]})

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each row of `queries`; both have id_col and vector."""
    spark = vectors.sparkSession
    ready(spark)
    slots = spark.sparkContext.defaultParallelism * 4  # asked once: it falls when an executor is lost, and each pass must meet every block
    ints = integers(vectors, id_col, vector, scale)
    rows = cut(ints.mapInArrow(_packed(ROW_BLOCK), "dim int, v binary, id binary").withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)).cast("int")))
    dealt = rows.repartition(slots, "dim", "slot")  # a stated number, so that few blocks still meet all cores
    asked = cut(integers(queries, id_col, vector, scale).groupBy("id").agg(F.min("v").alias("v")))
    norm = lambda df: df.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    far = float(np.sqrt(norm(asked))) * float(np.sqrt(norm(ints)))
    top = int(far * (1 + 1e-9)) + 1 if far < 2**62 else TOP  # no score is beyond
    n = asked.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    state = asked.select("id", F.lit(-top).cast("long").alias("lo"), F.lit(-(-(2 * top + 1) // BINS)).cast("long").alias("step"), F.lit(0).cast("long").alias("above"))
    width = 2 * top + 1
    beside = lambda df: df.hint("merge")  # noqa: E731  what grows with the queries is not broadcast, however small its files look
    while width > 1:
        grid = _grid(asked.join(beside(state), "id").repartition(parts), dealt, slots)
        counts = grid.mapInArrow(_histogram(k, width), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        run = counts.withColumn("so_far", F.sum("n").over(down))
        found = run.join(beside(state), "id").filter((F.col("above") + F.col("so_far") >= k) & (F.col("above") + F.col("so_far") - F.col("n") < k))
        step = F.greatest(F.ceil(F.col("step") / BINS), F.lit(1)).cast("long")
        low = (F.col("lo").cast("decimal(38,0)") + F.col("bin").cast("decimal(10,0)") * F.col("step").cast("decimal(20,0)")).cast("long")
        found = found.select("id", low.alias("lo"), step.alias("step"), (F.col("above") + F.col("so_far") - F.col("n")).alias("above"))
        # fewer than k candidates in all: everything from the lowest value on
        short = state.join(beside(found), "id", "left_anti").select("id", F.lit(-top).cast("long").alias("lo"), F.lit(1).cast("long").alias("step"), F.lit(k).cast("long").alias("above"))
        width = -(-width // BINS)
        old, state = state, cut(found.unionByName(short))
        forget(old)
    best = _grid(asked.join(beside(state), "id").repartition(parts), dealt, slots).mapInArrow(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
