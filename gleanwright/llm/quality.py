"""Document quality by an interpolated modified Kneser-Ney model of code points of order ORDER, trained on trusted text.

Every code point is a symbol of its own. An n-gram is a pair of exact integers of at most three symbols each, so the tables have no
bound but the text: a row for each n-gram and each context that occurs in the trusted text. Counts, continuation counts, discounts,
context totals and interpolated probabilities are joins of count tables on n-gram, context and suffix, sharded by these.

A text's perplexity is over all of its characters. If the model's counted rows are at most MODEL_ROWS it is broadcast and texts are
scored where they lie; otherwise the distinct n-grams of each text are joined to the sharded tables. Both give the same numbers.

A text is kept if its perplexity is at most a threshold: the QUANTILE of the trusted texts of its language and of its size (a power
of two of characters, since the mean of few characters strays further). Where these are fewer than LEAST, it is the quantile over
texts of that size in all languages; where these are too few, over all sizes of the language; then over all texts. The trusted texts
that are measured are held out: half of them, by a model of the other half, if both halves have texts. Quantiles are read off
histograms of log-perplexity in steps of 0.001.

Defined cases: a null or empty text has a null perplexity and is not kept; a very long text is scored whole; without any trusted
text there is no threshold and every text with characters is kept; a null language is a language of its own; repeated rows are
scored one by one; an empty table stays empty; other columns pass unchanged, and new ones whose names are taken get an underscore
in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .bpe_codec import added
from .common import by_size, cut, few, forget, fresh, ready, texts

BITS, HALF, ORDER = 21, 3, 5
SYMBOLS = 1 << BITS
#: Rows of the model up to which it is broadcast (20 bytes each), and of thresholds.
MODEL_ROWS, LANGUAGES = 6_000_000, 10_000
QUANTILE, LEAST, STEP = 0.999, 100, 0.001


def symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after another, and where each text's begin (one more entry); a symbol is a code point plus one."""
    raw, offsets = bytebpe.column_bytes(col)
    buf = np.frombuffer(raw, np.uint8)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    sym = buf[lead].astype(np.int64)
    wide = np.flatnonzero(sym >= 0xC0)
    if len(wide):
        pad = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64)
        at, w = lead[wide], sym[wide]
        t1, t2, t3 = pad[at + 1] & 63, pad[at + 2] & 63, pad[at + 3] & 63
        sym[wide] = np.where(w < 0xE0, (w & 31) << 6 | t1, np.where(w < 0xF0, (w & 15) << 12 | t1 << 6 | t2, (w & 7) << 18 | t1 << 12 | t2 << 6 | t3))
    return sym + 1, np.searchsorted(lead, offsets)


def grams(sym: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams that end at the places `at`, as pairs of numbers; 0 stands before each text."""
    begin = starts[np.searchsorted(starts, at, "right") - 1]
    one = lambda back: np.where(at - back >= begin, sym[np.maximum(at - back, 0)], 0) << BITS * (back % HALF)
    return sum(map(one, range(HALF, ORDER)), np.zeros(len(at), np.int64)), sum(map(one, range(HALF)), np.zeros(len(at), np.int64))


def _before(x: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """The entry `back` places before, in the same text, or 0."""
    out = np.zeros_like(x)
    out[back:] = x[:-back] if len(x) > back else 0
    for k in range(back):
        at = starts[:-1] + k
        out[at[at < starts[1:]]] = 0
    return out


def distinct(sym: np.ndarray, starts: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The distinct ORDER-grams (of each group): the place of one of each, which of them each place has, and their counts."""
    used = np.zeros(SYMBOLS + 1, bool)
    used[sym] = True
    rank = np.cumsum(used)[sym]  # from 1 on; 0 is where nothing stands before
    bits = int(used.sum()).bit_length()
    key, size = rank.copy(), bits
    for back in range(1, ORDER):
        if size + bits > 62:  # many symbols: what there is so far becomes a rank
            one, key = np.unique(key, return_inverse=True)
            size = len(one).bit_length()
        key = _before(rank, starts, back) << size | key
        size += bits
    if group is not None:
        one, key = np.unique(key, return_inverse=True)
        key = group * len(one) + key
    _, at, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return at, which, n


def _count(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for b in texts(batches, column):
        sym, starts = symbols(b.column(column))
        at, _, n = distinct(sym, starts)
        hi, lo = grams(sym, starts, at)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_pydict({"hi": hi[k : k + 100_000], "lo": lo[k : k + 100_000], "n": n[k : k + 100_000]})


@dataclass(frozen=True)
class KneserNey:
    """Of each order, from 1: (hi, lo, p) of n-grams and (hi, lo, w), the weight of the lower order after a context; None without trusted text."""

    levels: list[tuple[DataFrame, DataFrame]] | None


def _suffix(k: int, hi, lo):
    """The last k symbols of a gram, for columns and for arrays."""
    cut_at = lambda x, n: (x.bitwiseAND(F.lit((1 << BITS * n) - 1)) if isinstance(x, Column) else x & ((1 << BITS * n) - 1))
    return (cut_at(hi, k - HALF), lo) if k > HALF else (hi * 0, cut_at(lo, k))


def _context(hi, lo):
    """A gram without its last symbol, for columns and for arrays."""
    if isinstance(hi, Column):
        return F.shiftright(hi, BITS), F.shiftleft(hi.bitwiseAND(F.lit(SYMBOLS - 1)), BITS * (HALF - 1)).bitwiseOR(F.shiftright(lo, BITS))
    return hi >> BITS, (hi & (SYMBOLS - 1)) << BITS * (HALF - 1) | lo >> BITS


def _named(pair, names=("hi", "lo")):
    return [c.cast("long").alias(n) for c, n in zip(pair, names, strict=True)]


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and more (modified Kneser-Ney); where a count of counts is missing, the plain discount or 0.75."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*(F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4))).first())
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
    raw = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.75, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.75, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.75]
    return [min(max(d, 0.01), k - 0.01) for k, d in zip((1, 2, 3), raw, strict=True)]


def train(trusted: DataFrame, column: str = "text") -> KneserNey:
    """The model of all rows of `trusted`."""
    ready(trusted.sparkSession)
    hi, lo = F.col("hi"), F.col("lo")
    counts = cut(trusted.select(column).mapInArrow(lambda b: _count(b, column), "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n")))
    if counts.isEmpty():
        return KneserNey(None)
    levels = [counts]  # ORDER, then continuation counts of lower orders
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, cut(levels[0].groupBy(*_named(_suffix(k, hi, lo))).agg(F.count(F.lit(1)).alias("n"))))
    done: list[tuple[DataFrame, DataFrame]] = []
    for k, level in enumerate(levels, 1):
        d1, d2, d3 = _discounts(level)
        cost = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ctx = level.withColumns(dict(zip(("chi", "clo"), _context(hi, lo), strict=True)))
        totals = cut(ctx.groupBy("chi", "clo").agg(F.sum("n").alias("total"), F.sum(cost).alias("free")))
        seen = ctx.select("hi", "lo", "chi", "clo", (F.col("n") - cost).alias("rest")).join(totals, ["chi", "clo"])
        if k == 1:  # below the lowest order: uniform
            seen = seen.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            low = done[-1][0].select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("q"))
            seen = seen.withColumns(dict(zip(("shi", "slo"), _suffix(k - 1, hi, lo), strict=True))).join(low, ["shi", "slo"])
        p = cut(seen.select("hi", "lo", ((F.col("rest") + F.col("free") * F.col("q")) / F.col("total")).alias("p")))
        done.append((p, totals.select(F.col("chi").alias("hi"), F.col("clo").alias("lo"), (F.col("free") / F.col("total")).alias("w"))))
    forget(*levels)
    return KneserNey(done)


class Table:
    """Values of grams in sorted arrays: ranks of both halves make one key."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, value: np.ndarray):
        self.his, a = np.unique(hi, return_inverse=True)
        self.los, b = np.unique(lo, return_inverse=True)
        key = a.astype(np.int64) * len(self.los) + b
        order = np.argsort(key)
        self.key, self.value = key[order], value[order].astype(np.float32)

    def get(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each gram is here, and its value or any other."""
        a, b = (np.minimum(np.searchsorted(t, x), len(t) - 1) for t, x in ((self.his, hi), (self.los, lo)))
        key = a * len(self.los) + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.his[a] == hi) & (self.los[b] == lo) & (self.key[at] == key), self.value[at]


def _log_p(tables: list[tuple[Table, Table]], hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """log p of the last symbol of each gram of as many symbols as there are tables."""
    if not tables:
        return np.full(len(hi), -np.log(float(SYMBOLS)))
    k = len(tables)
    found, value = tables[-1][0].get(hi, lo)
    out = value.astype(np.float64)
    rest = np.flatnonzero(~found)
    if len(rest):
        hi, lo = hi[rest], lo[rest]
        known, weight = tables[-1][1].get(*_context(hi, lo))
        below = _log_p(tables[:-1], *_suffix(k - 1, hi, lo)) if k > 1 else _log_p([], hi, lo)
        out[rest] = below + np.where(known, weight, 0.0)
    return out


def _collected(levels: list[tuple[DataFrame, DataFrame]]) -> list[tuple[Table, Table]]:
    def table(df: DataFrame) -> Table:
        got = df.toArrow()
        return Table(*(got.column(c).to_numpy() for c in ("hi", "lo")), np.log(got.column(2).to_numpy()))

    return [(table(p), table(w)) for p, w in levels]


def score(docs: DataFrame, model: KneserNey, column: str = "text", names: tuple[str, str] = ("n_symbols", "perplexity"), most: int | None = None) -> DataFrame:
    """docs with the number of characters of `column` and their perplexity; most: rows of the model that are broadcast, MODEL_ROWS if not given."""
    ready(docs.sparkSession)
    names = tuple(fresh(n, docs.columns) for n in names)
    if model.levels and sum(p.count() + w.count() for p, w in model.levels) > (MODEL_ROWS if most is None else most):
        return _score_sharded(docs, model.levels, column, names)
    tables = docs.sparkSession.sparkContext.broadcast(_collected(model.levels) if model.levels else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches, column):
            sym, starts = symbols(b.column(column))
            n = np.diff(starts)
            total = np.zeros(len(sym) + 1)
            if tables.value is not None and len(sym):
                at, which, _ = distinct(sym, starts)
                np.cumsum(_log_p(tables.value, *grams(sym, starts, at))[which], out=total[1:])
            value = np.exp(-(total[starts[1:]] - total[starts[:-1]]) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(value, pa.float64(), mask=(n == 0) | (tables.value is None))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, added(docs, list(names), [T.LongType(), T.DoubleType()]))


def _score_sharded(docs: DataFrame, levels: list[tuple[DataFrame, DataFrame]], column: str, names: tuple[str, str]) -> DataFrame:
    """score() by joins: the distinct grams of all texts get their log p from the tables, and those of each text take it from there."""
    row = fresh("_row", [*docs.columns, *names])
    kept = cut(docs.withColumn(row, F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches, column):
            sym, starts = symbols(b.column(column))
            text = np.repeat(np.arange(b.num_rows), np.diff(starts))
            at, _, n = distinct(sym, starts, text)
            (hi, lo), ids = grams(sym, starts, at), b.column(row).to_numpy()[text[at]]
            for k in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_pydict({row: ids[k : k + 100_000], "hi": hi[k : k + 100_000], "lo": lo[k : k + 100_000], "n": n[k : k + 100_000]})

    each = kept.select(row, column).mapInArrow(run, f"{row} long, hi long, lo long, n long")
    hi, lo = F.col("hi"), F.col("lo")
    some = each.select("hi", "lo").distinct().select("hi", "lo", F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("lp"))
    for k in range(len(levels), 0, -1):
        p, w = levels[k - 1]
        at = some.withColumns(dict(zip(("ghi", "glo"), _suffix(k, hi, lo), strict=True)))
        at = at.withColumns(dict(zip(("chi", "clo"), _context(F.col("ghi"), F.col("glo")), strict=True)))
        at = at.join(p.select(F.col("hi").alias("ghi"), F.col("lo").alias("glo"), "p"), ["ghi", "glo"], "left")
        at = at.join(w.select(F.col("hi").alias("chi"), F.col("lo").alias("clo"), F.col("w").alias("v")), ["chi", "clo"], "left")
        lower = F.col("lp").isNull() & F.col("p").isNull()
        some = at.select("hi", "lo", (F.col("w") + F.when(lower, F.coalesce(F.log("v"), F.lit(0.0))).otherwise(0.0)).alias("w"), F.coalesce("lp", F.col("w") + F.log("p")).alias("lp"))
    some = cut(some.select("hi", "lo", F.coalesce("lp", F.col("w") - float(np.log(SYMBOLS))).alias("lp")))
    sums = each.join(some, ["hi", "lo"]).groupBy(row).agg(F.sum("n").alias(names[0]), F.sum(F.col("n") * F.col("lp")).alias("_sum"))
    out = kept.join(sums.withColumnRenamed(row, "_r"), F.col(row) == F.col("_r"), "left")
    return out.select(*docs.columns, F.coalesce(names[0], F.lit(0)).cast("long").alias(names[0]), F.exp(-F.col("_sum") / F.col(names[0])).alias(names[1]))


def size_class(symbols: str) -> Column:
    """The power of two that a number of characters reaches."""
    return F.floor(F.log2(F.greatest(F.col(symbols), F.lit(1)))).cast("int")


#: Which texts a threshold is taken from, in order of preference: those of the language, and those of the size.
POOLS = ((True, True), (False, True), (True, False), (False, False))


def thresholds(scored: DataFrame, lang: str = "lang", symbols: str = "n_symbols", perplexity: str = "perplexity", quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """(pool, lang, size, threshold): a row for each of POOLS (by place) and each language and size of it that has enough texts; the last always has."""
    step = F.floor(F.log(perplexity) / STEP).alias("step")
    counts = cut(scored.filter(F.col(perplexity).isNotNull()).groupBy(F.col(lang).alias("lang"), size_class(symbols).alias("size"), step).agg(F.count(F.lit(1)).alias("n")))
    pool = F.explode(F.array(*(F.struct(F.lit(k).alias("pool"), (F.col("lang") if by_lang else F.lit(None)).alias("lang"), (F.col("size") if by_size else F.lit(None)).cast("int").alias("size")) for k, (by_lang, by_size) in enumerate(POOLS))))
    run = counts.select(pool.alias("p"), "step", "n").groupBy("p.pool", "p.lang", "p.size", "step").agg(F.sum("n").alias("n"))
    group = ["pool", "lang", "size"]
    up = Window.partitionBy(*group).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumns({"so_far": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy(*group))})
    at = run.filter((F.col("so_far") >= quantile * F.col("total")) & ((F.col("pool") == len(POOLS) - 1) | (F.col("total") >= least)))
    return at.groupBy(*group).agg(F.exp((F.min("step") + 1) * STEP).alias("threshold"))


def classify(docs: DataFrame, trusted_ids: DataFrame, column: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """docs with n_symbols, perplexity, threshold and kept; trusted_ids: one column `key` of the trusted rows."""
    ids = by_size(trusted_ids.select(key).filter(F.col(key).isNotNull()).distinct())
    trusted = docs.join(ids, key, "left_semi").select(F.col(column).alias("text"), F.col(lang).alias("lang"))
    model = train(trusted)
    names = [fresh(n, docs.columns) for n in ("n_symbols", "perplexity", "threshold", "kept")]
    # by text, so that copies are on one side
    side = F.pmod(F.xxhash64("text"), F.lit(2))
    half = train(trusted.filter(side == 0))
    limit = cut(thresholds(score(trusted.filter(side == 1), half)))
    if limit.isEmpty():
        limit = cut(thresholds(score(trusted, model)))
    out = score(docs, model, column, (names[0], names[1]))
    found = []
    for k, (by_lang, by_length) in enumerate(POOLS):
        of_lang, of_size, of = (fresh(f"{n}_{k}", [*docs.columns, *names]) for n in ("lang", "size", "limit"))
        own = limit.filter(F.col("pool") == k).select(F.col("lang").alias(of_lang), F.col("size").alias(of_size), F.col("threshold").alias(of))
        on = F.lit(True)
        if by_lang:
            on = on & F.col(lang).eqNullSafe(F.col(of_lang))
        if by_length:
            on = on & (size_class(names[0]) == F.col(of_size))
        out = out.join(F.broadcast(own) if not by_lang or few(own, LANGUAGES) else own, on, "left")  # without languages: a row a size at most
        found.append(F.col(of))
    out = out.withColumn(names[2], F.coalesce(*found))
    kept = (F.col(names[0]) > 0) & F.coalesce(F.col(names[1]) <= F.col(names[2]), F.lit(limit.isEmpty()))
    return out.withColumn(names[3], kept).select(*docs.columns, *names)


def keep_good(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, with their own columns."""
    kept = fresh("kept", docs.columns)
    return classify(docs, trusted_ids).filter(F.col(kept)).select(*docs.columns)
