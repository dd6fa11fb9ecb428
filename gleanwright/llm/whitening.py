"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Components become integers x, floor(scale * c) + shift, and n rows with sums S have the scatter of n * x - S. Its entries are sums
of products that no double holds, so each partition computes them modulo several primes: residues below 2**21 are multiplied by
the double-precision matrix product in runs of ROWS rows, which is exact. Sums of residues over partitions are reduced by Spark,
and Chinese remaindering gives each entry as the exact integer; as many primes are taken as its proven bound asks for. Divided by
n**3 that is the covariance, correctly rounded, of which eigh gives the components. What reaches the driver is one matrix of the
vectors' length, whatever the number of rows.

Defined cases: rows whose vector is null or has a component that is null or not finite are left out; vectors of each length are a
fit of their own, with their own n, and empty vectors have no components; a null or repeated id stays and counts as a row;
integers beyond 2**61 stop there; a component whose variance is zero in double precision has null `whitened` (of a single row,
say); without rows there are none; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready
from .topk import usable

BITS, ROWS, FAR = 21, 4096, 1 << 61


def primes(least: int) -> list[int]:
    """The largest primes below 2**BITS, as many as make a product of at least `least`."""
    out, product, p = [], 1, (1 << BITS) - 1
    while product < least:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def chinese(residues: list[int], moduli: list[int]) -> int:
    """The integer nearest to zero that has these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def by_length(batches: Iterator[pa.RecordBatch], scale: int, shift: int, rows: int = ROWS) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Integers of the vectors in column v, in runs of at most `rows` of one length, with their batch."""
    for b in batches:
        n = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(n[n > 0]):
            part = b.filter(pa.array(n == dim))
            for lo in range(0, part.num_rows, rows):
                some = part.slice(lo, rows)
                c = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                with np.errstate(over="ignore"):
                    yield np.clip(np.floor(c * scale), -FAR, FAR).astype(np.int64) + shift, some


def _totals(scale: int, shift: int):
    """Of each length and place: rows, sum, least and largest integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for x, _ in by_length(batches, scale, shift):
            high, low = (x >> 31).sum(0), (x & (2**31 - 1)).sum(0)
            sums = [h * 2**31 + w for h, w in zip(high.tolist(), low.tolist(), strict=True)]
            old = got.get(x.shape[1])
            got[x.shape[1]] = [len(x), sums, x.min(0), x.max(0)] if old is None else [old[0] + len(x), [a + b for a, b in zip(old[1], sums, strict=True)], np.minimum(old[2], x.min(0)), np.maximum(old[3], x.max(0))]
        for dim, (n, sums, lo, hi) in got.items():
            yield pa.RecordBatch.from_pydict({"dim": np.full(dim, dim, "i4"), "i": np.arange(dim, dtype="i4"), "n": np.full(dim, n), "s": pa.array(map(Decimal, sums), pa.decimal128(38, 0)), "lo": lo, "hi": hi})

    return run


@dataclass(frozen=True)
class Totals:
    """Of all vectors of one length: rows, exact sums, and the integers' range at each place."""

    n: int
    sums: list[int]
    lo: list[int]
    hi: list[int]

    @property
    def moduli(self) -> list[int]:
        most = max(abs(self.n * x - s) for e in (self.lo, self.hi) for x, s in zip(e, self.sums, strict=True))
        return primes(2 * self.n * most * most + 1)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: in longs where these hold it, else in Python's integers."""
        if self.n * max(map(abs, [*self.lo, *self.hi])) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)


def _scatter(totals: dict[int, Totals], scale: int, shift: int, most: int):
    """Of each length the upper triangle of this partition's scatter, modulo each prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {}
        for x, _ in by_length(batches, scale, shift):
            dim = x.shape[1]
            t = totals[dim]
            own = got.setdefault(dim, [np.zeros((dim, dim), np.int64) for _ in t.moduli])
            for k, p in enumerate(t.moduli):
                r = (x % p * (t.n % p) - np.array([s % p for s in t.sums])) % p
                r = np.where(r > p // 2, r - p, r).astype(np.float64)  # at most 2**20, so ROWS products stay below 2**53
                own[k] = (own[k] + (r.T @ r).astype(np.int64)) % p
        for dim, own in got.items():
            i, j = np.triu_indices(dim)
            full = [m[i, j] for m in own] + [np.zeros(len(i), np.int64)] * (most - len(own))
            for lo in range(0, len(i), 100_000):
                s = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_pydict({"dim": np.full(len(i[s]), dim, "i4"), "i": i[s].astype("i4"), "j": j[s].astype("i4"), **{f"r{k}": r[s] for k, r in enumerate(full)}})

    return run


def _rebuilt(moduli: dict[int, list[int]], n: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            exact = [chinese([r[f"r{k}"] % p for k, p in enumerate(moduli[r["dim"]])], moduli[r["dim"]]) for r in rows]
            value = [e / n[r["dim"]] ** 3 for e, r in zip(exact, rows, strict=True)]  # Python rounds this quotient once
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("dim", "i", "j")), pa.array(map(str, exact), pa.string()), pa.array(value, pa.float64())], names=["dim", "i", "j", "scatter", "covariance"])

    return run


def totals(vectors: DataFrame, scale: int, shift: int) -> dict[int, Totals]:
    """Totals by length of vectors (v array<double>)."""
    rows = vectors.select("v").mapInArrow(_totals(scale, shift), "dim int, i int, n long, s decimal(38,0), lo long, hi long")
    found = rows.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim", "i").collect()  # a row a component
    out: dict[int, Totals] = {}
    for r in found:
        t = out.setdefault(r.dim, Totals(int(r.n), [], [], []))
        t.sums.append(int(r.s))
        t.lo.append(r.lo)
        t.hi.append(r.hi)
    return out


def scatter(vectors: DataFrame, known: dict[int, Totals], scale: int, shift: int) -> DataFrame:
    """(dim, i, j, scatter, covariance) for i <= j: the exact scatter of n * x - S in digits, and it over n**3."""
    moduli = {dim: t.moduli for dim, t in known.items()}
    most = max(map(len, moduli.values()), default=1)
    names = [f"r{k}" for k in range(most)]
    parts = vectors.select("v").mapInArrow(_scatter(known, scale, shift, most), ", ".join(["dim int, i int, j int", *(f"{r} long" for r in names)]))
    sums = parts.groupBy("dim", "i", "j").agg(*(F.sum(r).alias(r) for r in names))
    return sums.mapInArrow(_rebuilt(moduli, {dim: t.n for dim, t in known.items()}), "dim int, i int, j int, scatter string, covariance double")


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length: their totals, and the leading eigenvalues and eigenvectors (columns)."""

    totals: Totals
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared deviations (longs, or Python's integers) and whitened components (NaN where there is no variance) of integers x."""
        d = self.totals.centred(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 1 << 63:
            far = d.astype(object)
            square = (far * far).sum(1)
        else:
            square = (d * d).sum(1)
        ok = self.values > self.trace * len(self.axes) * 2.0**-52
        y = d.astype(np.float64) / self.totals.n @ self.axes
        return square, np.where(ok, y / np.sqrt(np.where(ok, self.values, 1.0)), np.nan)


def fit(vectors: DataFrame, components: int, scale: int, shift: int) -> dict[int, Fit]:
    """A fit for each length of vectors (v array<double>)."""
    known, out = totals(vectors, scale, shift), {}
    if not known:
        return out
    table = scatter(vectors, known, scale, shift).select("dim", "i", "j", "covariance").toArrow()
    dims, i, j, c = (table.column(k).to_numpy() for k in range(4))
    for dim, t in known.items():
        own, v = dims == dim, np.zeros((dim, dim))
        v[i[own], j[own]] = v[j[own], i[own]] = c[own]
        values, axes = np.linalg.eigh(v)
        axes = axes[:, ::-1][:, :components]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])  # the largest entry is positive
        out[dim] = Fit(t, values[::-1][:components], axes, float(np.trace(v)))
    return out


def _apply(fits: dict[int, Fit], scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, b in by_length(batches, scale, shift):
            dim = x.shape[1]
            square, w = fits[dim].whitened(x)
            square = pa.array([Decimal(s) if s < 10**38 else None for s in square.tolist()], pa.decimal128(38, 0)) if square.dtype == object else pa.array(square).cast(pa.decimal128(38, 0))
            flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(len(x), dim, "i4")), square, lists], names=["id", "dim", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each vector and each of its leading components.

    deviation: sum of (n * x - S)**2, exact, as decimal(38,0), null beyond that. explained: the component's share of the variance.
    identity_error: the largest absolute entry of the whitened components' covariance less the identity, of vectors of that length.
    """
    spark = vectors.sparkSession
    ready(spark)
    good = vectors.filter(F.coalesce(usable(vector), F.lit(False)) & (F.size(vector) > 0)).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    fits = fit(good, components, scale, shift)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = cut(good.mapInArrow(_apply(fits, scale, shift), f"id {kind}, dim int, deviation decimal(38,0), w array<double>"))
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    at = lambda k: F.try_element_at("w", F.lit(k + 1))
    found = rows.groupBy("dim").agg(*(F.covar_pop(at(a), at(b)).alias(f"c{a}_{b}") for a, b in pairs)).collect() if fits else []  # a row a length
    told = []
    for r in found:
        f = fits[r["dim"]]
        off = [abs(c - (a == b)) for a, b in pairs if (c := r[f"c{a}_{b}"]) is not None]
        told += [(r["dim"], k, f.totals.n, float(e / f.trace) if f.trace else None, max(off, default=None)) for k, e in enumerate(f.values.tolist())]
    side = spark.createDataFrame(told, "dim int, k int, n long, explained double, identity_error double")
    each = rows.select("id", "dim", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.join(F.broadcast(side), ["dim", "k"]).select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error")  # `components` rows a length
