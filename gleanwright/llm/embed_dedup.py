"""Near-duplicate vectors by collision counting over many one-dimensional projections.

Vectors are normalised and projected on PROJECTIONS random lines. Two vectors whose cosine is at the bound are a fixed distance
apart, so their difference on each line is normal with that spread; a window of this half-width around a query's value holds
such a partner with chance 0.68, a chance partner with far less. In each pair of blocks the lines are sorted, the collisions of
every query's windows are counted per pair, and pairs that reach the count are verified by their cosine. The count is the largest
that keeps a pair at the bound with chance RECALL. The first LEADS lines also cut space into cells, wide enough that a partner is
in the same or the next cell with chance over 0.999 a line; only neighbouring cells of one label meet, in blocks of bounded size.

Vectors are first multiplied by powers of two, so very large and very small entries do no harm. Equal vectors of a label are one class. A block pair returns, for each vector, how many it is linked with, and a spanning forest
of its links; so a group of thousands costs no list of all its pairs. Defined cases: rows with a null id or label, or a vector
that is null, zero, or holds null or non-finite components, are linked with nothing; rows without an id have no component and
are kept; repeated rows are linked with one another; vectors of different lengths are not compared; other columns are not read,
whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, ready
from .components import components
from .topk import usable

PROJECTIONS, LEADS, RECALL, BLOCK = 64, 2, 0.9999, 768


def calibrated(projections: int = PROJECTIONS, recall: float = RECALL, width: float = 1.0) -> int:
    """The largest count that a pair at the bound reaches with chance `recall`; width: half-window in spreads."""
    p, chance = erf(width / sqrt(2)), 0.0
    for count in range(projections, -1, -1):
        chance += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if chance >= recall:
            return count
    return 0


@lru_cache(8)
def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(20230517).standard_normal((dim, PROJECTIONS))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest entry is about one: squares neither overflow nor vanish, and cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _project(spread: float):
    """Adds the cells of each vector on the leading lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(n):
                part = b.filter(pa.array(n == dim))
                x = scaled(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                p = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ lines(int(dim))[:, :LEADS]
                cells = np.floor(p / (3.5 * spread)).astype("i4")
                cols = {c: part.column(c) for c in part.schema.names} | {f"c{k}": pa.array(cells[:, k]) for k in range(LEADS)}
                yield pa.RecordBatch.from_pydict(cols | {"dim": pa.array(np.full(len(x), dim, "i4"))})

    return run


def _links(bound: float):
    spread, enough = sqrt(2 - 2 * bound), calibrated()

    def found(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the linked pairs of two blocks."""
        a, b = scaled(a), scaled(b)
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        pa_, pb = (a / na[:, None]) @ lines(a.shape[1]), (b / nb[:, None]) @ lines(a.shape[1])
        count = np.zeros((len(a), len(b)), np.int16)
        rows = np.arange(len(a))
        for k in range(PROJECTIONS):
            order = np.argsort(pb[:, k])
            line = pb[order, k]
            hit = np.zeros((len(a), len(b) + 1), np.int8)
            np.add.at(hit, (rows, np.searchsorted(line, pa_[:, k] - spread, "left")), 1)
            np.add.at(hit, (rows, np.searchsorted(line, pa_[:, k] + spread, "right")), -1)
            count[:, order] += np.cumsum(hit[:, :-1], axis=1, dtype=np.int8)
        i, j = np.nonzero(count >= enough)
        if same:
            i, j = i[i < j], j[i < j]
        ok = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j]) >= bound
        return i[ok], j[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["same"]
                ia, ib, ma, mb = (np.frombuffer(r[c], "<i8") for c in ("ids", "ids2", "mult", "mult2"))
                a, b = (np.frombuffer(r[c], "<f8").reshape(-1, r["dim"]) for c in ("mat", "mat2"))
                i, j = found(a, b, same)
                n = np.concatenate([np.bincount(i, mb[j], len(ia)), np.bincount(j, ma[i], len(ib))]).astype("i8")
                ids = np.concatenate([ia, ib])
                some = n > 0
                # a spanning forest: each vector hangs on the first that it meets, if that joins two trees
                root: dict[int, int] = {}

                def top(x: int, root: dict[int, int] = root) -> int:
                    while (y := root.setdefault(x, x)) != x:
                        root[x] = x = root.setdefault(y, y)
                    return x

                edges = []
                for x, y in zip(ia[i].tolist(), ib[j].tolist(), strict=True):
                    if (s := top(x)) != (t := top(y)):
                        root[max(s, t)] = min(s, t)
                        edges.append((x, y))
                ex, ey = (np.array([e[k] for e in edges], "i8") for k in (0, 1))
                none = lambda k: pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), none(int(some.sum())), pa.array(n[some])], names=["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(ex), pa.array(ey), none(len(ex))], names=["a", "b", "n"])

    return run


def _pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    names = ["label", "dim", "c0", "c1", "blk"]
    mat = np.stack(p["v"].to_numpy()).astype("<f8").tobytes() if len(p) else b""
    return pd.DataFrame([(*key, p["rep"].to_numpy("<i8").tobytes(), p["mult"].to_numpy("<i8").tobytes(), mat)], columns=[*names, "ids", "mult", "mat"])


def near_duplicates(vectors: DataFrame, bound: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; links join vectors of one label whose cosine is at least `bound`."""
    ready(vectors.sparkSession)
    all_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    good = F.coalesce(usable("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = all_rows.withColumn("good", good)
    some = rows.filter("good").select("vec_id", "label", "v")
    classes = cut(some.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")))
    cells = classes.mapInArrow(_project(sqrt(2 - 2 * bound)), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}, c0 int, c1 int, dim int")
    cells = cut(cells)
    cell = ["label", "dim", "c0", "c1"]
    sizes = cells.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    dealt = cells.join(sizes, cell).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    kind = classes.schema["label"].dataType.simpleString()
    blocks = cut(dealt.groupBy(*cell, "blk").applyInPandas(_pack, f"label {kind}, dim int, c0 int, c1 int, blk int, ids binary, mult binary, mat binary"))
    # a block meets those of its own cell once, and those of the next cells: half of all neighbours, so that no two meet twice
    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) >= (0, 0)]
    to = F.explode(F.array(*(F.struct((F.col("c0") + x).alias("c0"), (F.col("c1") + y).alias("c1"), F.lit((x, y) == (0, 0)).alias("own")) for x, y in steps)))
    one = blocks.withColumn("to", to).select("label", "dim", "to.c0", "to.c1", "to.own", "blk", "ids", "mult", "mat")
    two = blocks.select(*cell, F.col("blk").alias("blk2"), F.col("ids").alias("ids2"), F.col("mult").alias("mult2"), F.col("mat").alias("mat2"))
    met = one.join(two, cell).filter("NOT own OR blk <= blk2").withColumn("same", F.expr("own AND blk = blk2"))
    out = cut(met.select("dim", "same", "ids", "mult", "mat", "ids2", "mult2", "mat2").mapInArrow(_links(bound), "a long, b long, n long"))
    forget(cells, blocks)
    counts = out.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(out.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    told = classes.join(counts, "rep", "left").join(comp, "rep", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    full = some.join(told, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
