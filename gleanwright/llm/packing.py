"""Packing of documents into sequences of a fixed window, by non-negative least squares over length combinations.

A document's ids, closed by an end id, are cut into full windows and one rest. The rests' lengths make a histogram of at most
WINDOW bins. Shallow combinations, all pairs of lengths and triples with one length on a grid, fill a window exactly; the counts
of their repeats solve a non-negative least-squares problem against the histogram on the driver, whose size is fixed by the
window. Rounded and cut to what the histogram has, then topped up greedily, they give each combination a range of ranks of each
of its lengths. Rests that no combination takes are packed greedily: laid end to end, longest first, and cut at window borders;
since rests of a length are alike, each one's place follows from the histogram and its rank alone. The last window, if it is not
full, becomes sequences of powers of two. So nothing is padded, and only rests at those borders are cut.

Ranks within a length are counted in groups that rows are dealt to one by one, so rows that are alike in everything are spread too.
Ids are encoded once; only documents that a border cuts are encoded again. Defined cases: a null or empty text is its end id alone;
a very long text is packed whole; repeated rows are packed one by one; a null doc_id stays null; other columns are not read,
whatever their names; no rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytebpe
from .common import by_size, cut, forget, ready, texts

WINDOW, GRID, GROUP_ROWS, GROUPS = 1024, 32, 50_000, 1024


def combinations(window: int = WINDOW, grid: int = GRID) -> np.ndarray:
    """Rows of three lengths that fill the window, ascending; a pair has 0 first."""
    pairs = [(0, a, window - a) for a in range(1, window // 2 + 1)]
    triples = [(a, b, window - a - b) for a in range(grid, window // 3 + 1, grid) for b in range(a, (window - a) // 2 + 1)]
    return np.array(pairs + triples, np.int64)


def least_squares(combos: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that makes the lengths used by x repeats of each combination nearest to counts (accelerated projected gradient)."""
    n = len(counts)

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(combos.ravel(), np.repeat(x, 3), n)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(used(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(used(y) - counts) / (size * 1.01))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, int]:
    """For counts of rests by length: ranges (length, first rank, end rank, first sequence, offset), ranks used of each length, windows filled."""
    combos = combinations(window)
    x = least_squares(combos, counts.astype(float))
    left, times = counts.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    left[0] = np.iinfo(np.int64).max
    order = np.argsort(-x, kind="stable")
    for want in (np.rint(x).astype(np.int64), np.full(len(x), np.iinfo(np.int64).max)):  # rounded, then what still fits
        for c in order.tolist():
            a, b, d = combos[c].tolist()
            need: dict[int, int] = {}
            for k in (a, b, d):
                if k:
                    need[k] = need.get(k, 0) + 1
            n = min(int(want[c]), *(int(left[k]) // m for k, m in need.items()))
            if n > 0:
                times[c] += n
                for k, m in need.items():
                    left[k] -= n * m
    ranges, rank, seq = [], np.zeros(len(counts), np.int64), 0
    for c in np.flatnonzero(times).tolist():
        n, offset = int(times[c]), 0
        for k in combos[c].tolist():
            if k:
                ranges.append((k, int(rank[k]), int(rank[k]) + n, seq, offset))
                rank[k] += n
                offset += k
        seq += n
    return ranges, rank, seq


def _encoded(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = bytebpe.library_encoder(path), TaskContext.get().partitionId() << 40
        for b in texts(batches, "text"):
            flat, off = coder.ids(b.column("text"))
            crcs = []
            for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                data = np.append(flat[lo:hi], end_id).astype("<u4").tobytes()
                crcs.append([zlib.crc32(data[k : k + 4 * window]) for k in range(0, len(data), 4 * window)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fp"), pa.array(np.diff(off) + 1), pa.array(crcs, pa.list_(pa.int64())), pa.array(np.arange(row, row + b.num_rows))], names=["doc_id", "fp", "n", "crcs", "row"])
            row += b.num_rows

    return run


def _cut_crcs(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytebpe.library_encoder(path)
        for b in texts(batches, "text"):
            flat, off = coder.ids(b.column("text"))
            at, start, length, crc = [], [], [], []
            for i, wanted in enumerate(b.column("parts").to_pylist()):
                data = np.append(flat[off[i] : off[i + 1]], end_id).astype("<u4").tobytes()
                for w in wanted:
                    s, n = w["start"], w["length"]
                    at.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("fp").take(at), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "fp", "start", "length", "crc"])

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ready(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    rows = cut(docs.mapInArrow(_encoded(path, end_id, window), f"doc_id {kind}, fp long, n long, crcs array<long>, row long"))
    by_rest = rows.groupBy((F.col("n") % window).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr(f"n div {window}")).alias("full")).collect()
    counts = np.zeros(window, np.int64)
    for x in by_rest:
        counts[x.r] = x.rows
    total, n_full = int(counts.sum()), sum(x.full for x in by_rest)
    counts[0] = 0
    ranges, used, filled = plan(counts, window)

    # where the greedy rest begins for each length, longest first, and the borders of its last, partial window
    over = (counts - used) * np.arange(window)
    base = np.zeros(window, np.int64)
    base[1:] = (np.cumsum(over[::-1])[::-1] - over)[1:]
    whole, tail = divmod(int(over.sum()), window)
    borders = [whole * window]
    for bit in reversed(range(window.bit_length())):
        if tail >> bit & 1:
            borders.append(borders[-1] + (1 << bit))

    groups = max(64, -(-total // GROUP_ROWS))
    keyed = rows.withColumns({"r": (F.col("n") % window).cast("int"), "q": F.expr(f"n div {window}"), "salt": F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")})
    before = Window.partitionBy("salt").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keyed.withColumn("q_in", F.sum("q").over(before) - F.col("q")).withColumn("r_in", F.row_number().over(Window.partitionBy("salt", "r").orderBy("row")) - 1)
    sums = cut(keyed.groupBy("salt", "r").agg(F.count(F.lit(1)).alias("c"), F.sum("q").alias("f")))
    by_salt = sums.groupBy("salt").agg(F.sum("f").alias("f"))
    # sums of sums: no task sees more rows than GROUPS, or groups / GROUPS
    by_salt = by_salt.withColumn("block", F.expr(f"salt div {GROUPS}"))
    blocks = by_salt.groupBy("block").agg(F.sum("f").alias("f"))
    blocks = blocks.select("block", (F.sum("f").over(Window.orderBy("block")) - F.col("f")).alias("block_at"))
    inside = F.sum("f").over(Window.partitionBy("block").orderBy("salt")) - F.col("f")
    starts = by_salt.withColumn("inside", inside).join(blocks, "block").select("salt", (F.col("block_at") + F.col("inside")).alias("q_at"))
    ranks = sums.select("salt", "r", (F.sum("c").over(Window.partitionBy("r").orderBy("salt")) - F.col("c")).alias("r_at"))
    ranked = cut(ranked.join(by_size(starts), "salt").join(by_size(ranks), ["salt", "r"]).select("doc_id", "fp", "n", "crcs", "r", "q", (F.col("q_at") + F.col("q_in")).alias("first"), (F.col("r_at") + F.col("r_in")).alias("rank")))
    forget(rows)

    window_pieces = ranked.filter("q > 0").select("doc_id", "n", "first", F.posexplode(F.slice("crcs", F.lit(1), F.col("q").cast("int"))).alias("k", "crc"))
    window_pieces = window_pieces.select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "crc", "n", (F.col("first") + F.col("k")).alias("seq"), F.lit(0).cast("long").alias("offset"))

    # both tables are bounded by the number of combinations and by the window
    rests = ranked.filter("r > 0").select("doc_id", "fp", "n", "r", "rank", (F.col("n") - F.col("r")).alias("from"), F.element_at("crcs", -1).alias("crc"))
    allotted = F.broadcast(spark.createDataFrame(ranges, "len int, lo long, hi long, seq0 long, at long"))
    known = F.broadcast(spark.createDataFrame([(k, int(used[k]), int(base[k])) for k in range(1, window)], "len int, used long, base long"))
    joined = rests.join(known, F.col("r") == F.col("len")).drop("len")
    combined = joined.filter("rank < used").join(allotted, (F.col("r") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    combined = combined.select("doc_id", F.col("from").alias("start"), F.col("r").cast("long").alias("length"), "crc", "n", (F.lit(n_full) + F.col("seq0") + F.col("rank") - F.col("lo")).alias("seq"), F.col("at").alias("offset"))

    x, end = F.col("x"), F.col("x") + F.col("r")
    greedy = joined.filter("rank >= used").withColumn("x", F.col("base") + (F.col("rank") - F.col("used")) * F.col("r"))
    next_border = F.least((F.floor(x / window) + 1) * window, F.lit(whole * window)).cast("long")
    inside = F.filter(F.array_distinct(F.concat(F.array(next_border), F.array(*(F.lit(b).cast("long") for b in borders)))), lambda b: (b > x) & (b < end))
    marks = F.concat(F.array(x), F.array_sort(inside), F.array(end.cast("long")))
    parts = greedy.withColumn("marks", marks).withColumn("parts", F.size("marks") - 1)
    parts = parts.select("doc_id", "fp", "n", "from", "x", "crc", "parts", F.explode(F.transform(F.slice("marks", F.lit(1), F.size("marks") - 1), lambda b, i: F.struct(b.alias("s"), F.get("marks", i + 1).alias("e")))).alias("p"))
    seq = F.floor(F.col("p.s") / window)
    offset = F.col("p.s") % window
    for k, b in enumerate(borders[:-1]):
        seq, offset = (F.when(F.col("p.s") >= b, new).otherwise(old) for new, old in ((F.lit(whole + k), seq), (F.col("p.s") - b, offset)))
    parts = parts.select("doc_id", "fp", "n", "crc", "parts", (F.col("from") + F.col("p.s") - F.col("x")).alias("start"), (F.col("p.e") - F.col("p.s")).alias("length"), (F.lit(n_full + filled) + seq).cast("long").alias("seq"), offset.cast("long").alias("offset"))
    parts = cut(parts)
    uncut = parts.filter("parts = 1").select("doc_id", "start", "length", "crc", "n", "seq", "offset")
    split = parts.filter("parts > 1").drop("crc")
    wanted = split.groupBy(F.col("doc_id").alias("id2"), F.col("fp").alias("fp2")).agg(F.collect_set(F.struct("start", "length")).alias("parts"))
    same = lambda a, b: a.eqNullSafe(b)
    again = docs.join(by_size(cut(wanted), 200_000), same(F.col("doc_id"), F.col("id2")) & (F.col("fp") == F.col("fp2"))).select("doc_id", "fp", "text", "parts").dropDuplicates(["doc_id", "fp"])
    crcs = cut(again.mapInArrow(_cut_crcs(path, end_id), f"doc_id {kind}, fp long, start long, length long, crc long")).select(F.col("doc_id").alias("id2"), F.col("fp").alias("fp2"), F.col("start").alias("s2"), F.col("length").alias("l2"), "crc")
    on = same(F.col("doc_id"), F.col("id2")) & (F.col("fp") == F.col("fp2")) & (F.col("start") == F.col("s2")) & (F.col("length") == F.col("l2"))
    cut_pieces = split.join(crcs, on).select("doc_id", "start", "length", "crc", "n", "seq", "offset")
    out = window_pieces.unionByName(combined).unionByName(uncut).unionByName(cut_pieces)
    return out.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("seq").cast("long").alias("sequence_id"), "offset")
