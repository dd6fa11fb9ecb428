"""A stored lexical index: segments of posting blocks, exact top-k by block bounds, updates and deletes, merging.

Documents are dealt into blocks of BLOCK, neighbours by their most frequent term (so a block is mostly of one language) and length. A segment is one table with a row for each block and term (which of
the block's documents hold the term, how often, and their lengths; the largest count and the least length) and one row for each
block, under the empty term, with the documents' keys and lengths. It is built where the texts lie, without a shuffle. A row's
largest count and least length bound what the term can add to the score of any document of the block, whatever the corpus'
average length is by now, so segments stay as they are when others come.

search() reads the rows of the queries' terms alone, brings those of a block together, and scores blocks in Arrow batches. Each task
keeps the k best of each query so far; a block whose bounds add up to less than the k-th of them is skipped for that query, and
its postings are not looked at. A task returns k rows a query at most, so what is merged at the end does not grow with the hits.

An update is a new segment and a tombstone for each key; a tombstone hides the key in segments before its own. Document
frequencies, number and lengths of live documents are those of the segments less those of hidden documents, which are looked up in
their own blocks only. merge() writes the live postings as one segment; it gives what a new index of the live documents would give.
States are commits of `sources.versions`: readers see an index before or after a change.

Defined cases: a null text has no terms but counts as a document; documents with a null key can be found but not deleted; keys that
are there twice are two documents, and deleting the key hides both; a query without known terms has no rows; an empty index, too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import by_size, delete, forget, ready, spread, written
from ..sources import versions
from .lexical import K1, PIECE, B, idf, lengths, pieces

BLOCK = 32
#: Rows (query, term) that are sent to all tasks at once; more queries are met in several passes. Scores that are held at once in a task.
AT_ONCE, HELD = 1_000_000, 1 << 19
#: Bits of a block's number within a partition, and of both.
RUN, PART = 24, 48
#: What scores are rounded to, and how far a sum of floating numbers may be from another order of it.
DIGITS, SLACK = 6, 1e-6


def _schema(key: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    fields = [("block", T.LongType()), ("term", T.StringType()), ("n", T.IntegerType()), ("top_tf", T.IntegerType()), ("least_dl", T.IntegerType()), ("slots", ints), ("tfs", ints), ("dls", ints), ("keys", T.ArrayType(key))]
    return T.StructType([T.StructField(n, k) for n, k in fields])


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _blocks(segment: int):
    """Rows of a segment from (key, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = (segment << PART) + (TaskContext.get().partitionId() << RUN), 0
        for b in (x.slice(lo, hi - lo) for x in batches for lo, hi in pieces(lengths(x.column("tokens")), PIECE)):
            tok = b.column("tokens")
            dl = lengths(tok)
            flat, count = tok.flatten().dictionary_encode(), len(dl)
            words, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            many = max(1, len(words))
            order = np.lexsort((dl, _most_frequent(code, dl, many)))
            rank = np.empty(count, np.int64)
            rank[order] = np.arange(count)
            sized, place = dl[order], np.repeat(rank, dl)
            at, tf = np.unique((place // BLOCK * many + code) * BLOCK + place % BLOCK, return_counts=True)
            pair, slot = at // BLOCK, at % BLOCK
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(pair))
            own = sized[pair // many * BLOCK + slot]
            for lo in range(0, len(starts), 50_000):
                s, e = starts[lo : lo + 50_000], ends[lo : lo + 50_000]
                some = slice(s[0], e[-1])
                bounds = np.append(s, e[-1]) - s[0]
                head = pair[s]
                yield _batch(base + done + head // many, words.take(pa.array(head % many)), e - s, np.maximum.reduceat(tf[some], bounds[:-1]), np.minimum.reduceat(own[some], bounds[:-1]), _lists(slot[some], bounds), _lists(tf[some], bounds), _lists(own[some], bounds), pa.nulls(len(s), pa.list_(b.column("key").type)))
            lo = np.arange(0, count, BLOCK)
            bounds = np.append(lo, count)
            keys = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), b.column("key").take(pa.array(order)))
            none = pa.nulls(len(lo), pa.list_(pa.int32()))
            yield _batch(base + done + np.arange(len(lo)), pa.array([""] * len(lo)), np.diff(bounds), np.zeros(len(lo), "i4"), np.minimum.reduceat(sized, lo) if count else lo, none, none, _lists(sized, bounds), keys)
            done += len(lo)

    return run


def _most_frequent(code: np.ndarray, dl: np.ndarray, many: int) -> np.ndarray:
    """Each document's most frequent term, as its number among all by frequency; empty documents have none."""
    common = np.empty(many, np.int64)
    common[np.argsort(-np.bincount(code, minlength=many), kind="stable")] = np.arange(many)
    at, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * many + common[code], return_counts=True)
    best = np.full(len(dl), many, np.int64)
    order = np.lexsort((-(at % many), tf))  # the last of a document is its most frequent, then its most common
    best[(at // many)[order]] = (at % many)[order]
    return best


def _batch(block, term, n, top_tf, least_dl, slots, tfs, dls, keys) -> pa.RecordBatch:
    ints = lambda x: pa.array(np.asarray(x), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), term.cast(pa.string()), ints(n), ints(top_tf), ints(least_dl), slots, tfs, dls, keys], names=["block", "term", "n", "top_tf", "least_dl", "slots", "tfs", "dls", "keys"])


def segment(docs: DataFrame, key: str, text: str, number: int) -> DataFrame:
    """Rows of segment `number` for docs."""
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("tokens"))
    return rows.mapInArrow(_blocks(number), _schema(docs.schema[key].dataType))


@dataclass(frozen=True)
class Work:
    """Of each query, the postings of its terms and how many of them were read; a table."""

    rows: DataFrame


class Index:
    """The index at a path; its state is looked up at each call, so an object may be kept."""

    def __init__(self, spark: SparkSession, path: str, k1: float = K1, b: float = B):
        ready(spark)
        self.spark, self.path, self.k1, self.b = spark, path, k1, b

    # what is stored

    def state(self) -> dict:
        """Segments by number, with their folders, tombstone folders, and the next segment's number."""
        return versions.version(self.spark, self.path)[1] or {"segments": {}, "tombstones": [], "next": 0}

    def _commit(self, change) -> None:
        number, state = versions.version(self.spark, self.path)
        state = state or {"segments": {}, "tombstones": [], "next": 0}
        versions.commit(self.spark, self.path, number, change(state))

    def _tombstones(self, keys: DataFrame, before: int) -> str:
        folder = f"dead-{uuid.uuid4().hex}"
        keys.filter(F.col(keys.columns[0]).isNotNull()).select(F.col(keys.columns[0]).alias("key"), F.lit(before).alias("before")).distinct().write.parquet(f"{self.path}/{folder}")
        return folder

    def add(self, docs: DataFrame, key: str, text: str, replace: bool = False) -> None:
        """Add docs as a segment; replace=True hides earlier documents with their keys, in the same step."""
        number = self.state()["next"]
        folder = f"segment-{number}-{uuid.uuid4().hex}"
        segment(docs, key, text, number).write.parquet(f"{self.path}/{folder}")
        dead = [self._tombstones(docs.select(key), number)] if replace else []

        def change(state: dict) -> dict:
            if state["next"] != number:
                raise versions.Outrun("another segment was added meanwhile")
            return {"segments": {**state["segments"], str(number): folder}, "tombstones": [*state["tombstones"], *dead], "next": number + 1}

        self._commit(change)

    def delete(self, keys: DataFrame) -> None:
        """Hide the documents of all segments so far whose keys are in the first column of `keys`."""
        number = self.state()["next"]
        folder = self._tombstones(keys, number)

        def change(state: dict) -> dict:
            if state["next"] != number:
                raise versions.Outrun("a segment was added meanwhile")
            return {**state, "tombstones": [*state["tombstones"], folder]}

        self._commit(change)

    def _rows(self, state: dict) -> DataFrame | None:
        folders = [f"{self.path}/{f}" for f in state["segments"].values()]
        return self.spark.read.parquet(*folders) if folders else None

    def _hidden(self, state: dict, rows: DataFrame) -> DataFrame | None:
        """(block, dead): of blocks with hidden documents, these documents' slots; none without tombstones."""
        if not state["tombstones"]:
            return None
        dead = self.spark.read.parquet(*(f"{self.path}/{f}" for f in state["tombstones"])).groupBy("key").agg(F.max("before").alias("before"))
        each = rows.filter("term = ''").select("block", F.posexplode("keys").alias("slot", "key"))
        found = each.join(by_size(dead), "key").filter(F.shiftright("block", PART) < F.col("before"))
        return written(found.groupBy("block").agg(F.collect_set("slot").alias("dead")))  # BLOCK entries at most

    @staticmethod
    def _alive(rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
        """rows without hidden documents; a block's bounds stay, since they can only be too high."""
        if hidden is None:
            return rows
        keep = lambda values: F.when(F.col("dead").isNull(), F.col(values)).otherwise(F.transform(F.filter(F.arrays_zip("slots", values), lambda x: ~F.array_contains("dead", x["slots"])), lambda x: x[values]))
        own = rows.withColumn("slots", F.when(F.col("term") == "", F.sequence(F.lit(0), F.size("dls") - 1)).otherwise(F.col("slots"))).join(by_size(hidden), "block", "left")
        done = own.withColumns({"tfs2": F.when(F.col("term") == "", F.col("tfs")).otherwise(keep("tfs")), "dls2": keep("dls"), "slots2": F.when(F.col("dead").isNull(), F.col("slots")).otherwise(F.array_except("slots", "dead"))})
        done = done.select("block", "term", F.size("dls2").alias("n"), "top_tf", "least_dl", F.col("slots2").alias("slots"), F.col("tfs2").alias("tfs"), F.col("dls2").alias("dls"), "keys")
        return done.filter("n > 0")

    # what is known of live documents

    def live(self) -> DataFrame | None:
        """The rows of live documents: all segments, less what is hidden."""
        state = self.state()
        rows = self._rows(state)
        return None if rows is None else self._alive(rows, self._hidden(state, rows))

    def frequency(self) -> DataFrame:
        """(term, df) over live documents: counts of whole rows, less those of hidden documents in their own blocks."""
        return self._counts()[0]

    def stats(self) -> DataFrame:
        """One row (n, avgdl) of live documents."""
        return self._counts()[1]

    def _counts(self) -> tuple[DataFrame, DataFrame]:
        state = self.state()
        rows = self._rows(state)
        if rows is None:
            return self.spark.createDataFrame([], "term string, df long"), self.spark.createDataFrame([(0, 0.0)], "n long, avgdl double")
        return self._frequency(rows, hidden := self._hidden(state, rows)), self._stats(rows, hidden)

    @staticmethod
    def _frequency(rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
        counts = rows.filter("term <> ''").select("term", "n")
        if hidden is not None:
            less = rows.filter("term <> ''").join(by_size(hidden), "block").select("term", (-F.size(F.array_intersect("slots", "dead"))).alias("n"))
            counts = counts.unionByName(less)
        return counts.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    @staticmethod
    def _stats(rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
        total = lambda dls: F.aggregate(dls, F.lit(0).cast("long"), lambda s, x: s + x)
        sums = rows.filter("term = ''").select("block", F.col("n").cast("long").alias("n"), total("dls").alias("dl"), "dls")
        if hidden is not None:
            less = sums.join(by_size(hidden), "block").select("block", (-F.size("dead")).cast("long").alias("n"), (-total(F.transform("dead", lambda i: F.get("dls", i)))).alias("dl"))
            sums = sums.drop("dls").unionByName(less)
        told = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
        return told.select("n", F.when(F.col("n") > 0, F.col("dl") / F.col("n")).otherwise(0.0).alias("avgdl"))

    # search

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", query: str = "query", key: str = "key") -> tuple[DataFrame, Work]:
        """(query_key, key, score, rank): the k best live documents of each query, ties by smaller key; and the work done for it.

        Scores are rounded to DIGITS, as everywhere. Both tables are written; what was needed on the way is deleted.
        """
        state = self.state()
        rows = self._rows(state)
        kind = queries.schema[query_key].dataType.simpleString()
        if rows is None:
            empty = self.spark.createDataFrame([], f"{query_key} {kind}, {key} string, score double, rank int")
            return empty, Work(self.spark.createDataFrame([], f"{query_key} {kind}, postings long, read long"))
        hidden = self._hidden(state, rows)
        terms = written(queries.select(F.col(query_key).alias("q"), F.explode(tokens(query)).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times")))
        numbered = written(terms.select("q").distinct().withColumn("qn", F.monotonically_increasing_id()))
        mine = self._alive(rows.join(by_size(terms.select("term").distinct()), "term", "left_semi"), hidden)
        heads = self._alive(rows.filter("term = ''"), hidden)
        known = self._frequency(rows.join(by_size(terms.select("term").distinct()), "term", "left_semi"), hidden)
        n, avgdl = self._stats(rows, hidden).first()
        weighted = terms.join(by_size(known), "term").select("q", "term", (F.col("times") * idf(F.lit(n), F.col("df")) * (self.k1 + 1)).alias("w"))
        weighted = written(weighted.join(by_size(numbered), "q").select("qn", "term", "w"))
        passes = -(-weighted.count() // AT_ONCE)
        out_kind = f"q long, key {rows.schema['keys'].dataType.elementType.simpleString()}, score double, postings long, read long"
        done = []
        for k_pass in range(passes):
            own = weighted.filter(F.pmod(F.xxhash64("qn"), F.lit(passes)) == k_pass)
            plan = _Plan.of(own.toArrow(), k, self.k1, self.b, max(float(avgdl), 1e-12))  # AT_ONCE rows about
            shared = self.spark.sparkContext.broadcast(plan)
            some = mine.join(by_size(own.select("term").distinct()), "term", "left_semi") if passes > 1 else mine
            some = some.unionByName(heads)
            dealt = some.select("block", "term", "n", "top_tf", "least_dl", "slots", "tfs", "dls", "keys").repartition("block").sortWithinPartitions("block")
            done.append(written(dealt.mapInArrow(_search(shared), out_kind)))
        empty = self.spark.createDataFrame([], out_kind)
        got = empty
        for d in done:
            got = got.unionByName(d)
        names = by_size(numbered.withColumnRenamed("q", "query"))
        got = got.join(names, F.col("q") == F.col("qn")).drop("q")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        best = got.filter("score IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = written(best.select(F.col("query").alias(query_key), F.col("key").alias(key), "score", "rank"))
        work = written(got.filter("score IS NULL").groupBy(F.col("query").alias(query_key)).agg(F.sum("postings").alias("postings"), F.sum("read").alias("read")))
        forget(terms, numbered, weighted, *done, *([hidden] if hidden is not None else []))
        return out, Work(work)

    # merging

    def merge(self) -> None:
        """Write all live documents as one segment, in blocks by length anew, and make it the index."""
        number, state = versions.version(self.spark, self.path)
        rows = self._rows(state) if state else None
        if rows is None:
            return
        into, live = state["next"], self._alive(rows, hidden := self._hidden(state, rows))
        heads = live.filter("term = ''").withColumn("slots", F.coalesce("slots", F.sequence(F.lit(0), F.size("dls") - 1)))
        docs = heads.select("block", "keys", F.explode(F.arrays_zip("slots", "dls")).alias("x")).select("block", F.col("x.slots").alias("slot"), F.col("x.dls").alias("dl"), F.get("keys", F.col("x.slots")).alias("key"))
        placed = written(docs.mapInArrow(_placed(into), T.StructType([*docs.schema.fields, T.StructField("block2", T.LongType()), T.StructField("slot2", T.IntegerType())])))
        each = live.filter("term <> ''").select("block", "term", F.explode(F.arrays_zip("slots", "tfs")).alias("x")).select("block", "term", F.col("x.slots").alias("slot"), F.col("x.tfs").alias("tf"))
        again = each.join(placed.select("block", "slot", "block2", "slot2", "dl"), ["block", "slot"])
        entry = F.sort_array(F.collect_list(F.struct(F.col("slot2").alias("slot"), "tf", "dl")))  # BLOCK entries at most
        posts = again.groupBy(F.col("block2").alias("block"), "term").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("top_tf"), F.min("dl").alias("least_dl"), entry.alias("e"))
        kind = rows.schema["keys"].dataType
        posts = posts.select("block", "term", "n", "top_tf", "least_dl", F.col("e.slot").alias("slots"), F.col("e.tf").alias("tfs"), F.col("e.dl").alias("dls"), F.lit(None).cast(kind).alias("keys"))
        heads = placed.groupBy(F.col("block2").alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("slot2").alias("slot"), "key", "dl"))).alias("e"))
        none = F.lit(None).cast("array<int>")
        heads = heads.select("block", F.lit("").alias("term"), F.size("e").alias("n"), F.lit(0).alias("top_tf"), F.array_min("e.dl").alias("least_dl"), none.alias("slots"), none.alias("tfs"), F.col("e.dl").alias("dls"), F.col("e.key").alias("keys"))
        folder = f"segment-{into}-{uuid.uuid4().hex}"
        posts.unionByName(heads).write.parquet(f"{self.path}/{folder}")
        versions.commit(self.spark, self.path, number, {"segments": {str(into): folder}, "tombstones": [], "next": into + 1})
        delete(self.spark, *(f"{self.path}/{f}" for f in [*state["segments"].values(), *state["tombstones"]]))
        forget(placed, *([hidden] if hidden is not None else []))


@dataclass(frozen=True)
class _Plan:
    """What tasks need of the queries: for each term its queries and weights, one after another."""

    terms: list[str]
    starts: np.ndarray
    queries: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    k: int
    k1: float
    b: float
    avgdl: float

    @classmethod
    def of(cls, rows: pa.Table, k: int, k1: float, b: float, avgdl: float) -> _Plan:
        rows = rows.sort_by("term")
        term = rows.column("term").combine_chunks().dictionary_encode()
        ids, q = np.unique(rows.column("qn").to_numpy(), return_inverse=True)
        code = term.indices.to_numpy(zero_copy_only=False)
        starts = np.searchsorted(code, np.arange(len(term.dictionary) + 1))
        return cls(term.dictionary.to_pylist(), starts, q, rows.column("w").to_numpy(), ids, k, k1, b, avgdl)

    def part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: which run each place belongs to, and the place in it."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def _chunks(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.Table]:
    """Runs of whole blocks, about `blocks` of them at a time; rows come by block."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        at = batch.column("block").to_numpy()
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        new = bool(held and len(at) and held[-1].column("block")[-1].as_py() != at[0])
        lo = 0
        for c in [*([0] if new else []), *cuts.tolist()]:
            count += 1
            if count >= blocks:
                if c > lo:
                    held.append(batch.slice(lo, c - lo))
                yield pa.Table.from_batches(held)
                held, count, lo = [], 0, c
        if lo < len(at):
            held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def _search(shared):
    """The k best of each query among this task's blocks, and rows that tell the work: (q, key, score, postings, read)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: _Plan = shared.value
        n_q, terms = len(p.ids), pa.array(p.terms, pa.string())
        floor, best = np.full(n_q, -np.inf), None
        postings, read = np.zeros(n_q, np.int64), np.zeros(n_q, np.int64)
        for t in _chunks(batches, max(1, HELD // (max(1, n_q) * BLOCK))):
            head = t.filter(pa.compute.equal(t.column("term"), ""))
            t = t.append_column("t", pa.compute.index_in(t.column("term"), value_set=terms)).filter(pa.compute.is_valid(pa.compute.index_in(t.column("term"), value_set=terms)))
            if not t.num_rows:
                continue
            ids, blk = np.unique(t.column("block").to_numpy(), return_inverse=True)
            term, n = t.column("t").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            bound = p.part(t.column("top_tf").to_numpy().astype(float), t.column("least_dl").to_numpy().astype(float))
            row, nth = _spread(p.starts[term + 1] - p.starts[term])  # each row beside each query of its term
            at = p.starts[term][row] + nth
            q, w = p.queries[at], p.weights[at]
            most = np.bincount(q * len(ids) + blk[row], w * bound[row], n_q * len(ids)).reshape(n_q, -1)
            postings += np.bincount(q, n[row], n_q).astype(np.int64)
            column = lambda c, t=t: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            slot, part = column("slots"), p.part(column("tfs").astype(float), column("dls").astype(float))
            first, width = np.cumsum(n) - n, len(ids) * BLOCK
            names = head.column("keys").combine_chunks()
            start = np.concatenate([[0], np.cumsum(names.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            mine = np.argsort(head.column("block").to_numpy())
            block = mine[np.searchsorted(head.column("block").to_numpy(), ids, sorter=mine)]
            names = names.flatten()
            high = np.partition(most, -2, axis=1)[:, -2:].min(1) if len(ids) > 2 else np.zeros(n_q)
            done = np.zeros(most.shape, bool)
            for least in (high, np.zeros(n_q)):  # blocks of the highest bounds first, since they raise the floor
                need = (most + SLACK >= floor[:, None]) & (most >= least[:, None]) & ~done
                done |= need
                ok = need[q, blk[row]]
                rows, qs, ws = row[ok], q[ok], w[ok]
                if not len(rows):
                    continue
                read += np.bincount(qs, n[rows], n_q).astype(np.int64)
                each, nth = _spread(n[rows])
                at = first[rows][each] + nth
                score = np.round(np.bincount(qs[each] * width + blk[rows][each] * BLOCK + slot[at], ws[each] * part[at], n_q * width).reshape(n_q, width), DIGITS)
                kth = np.partition(score, -p.k, axis=1)[:, -p.k] if width > p.k else np.zeros(n_q)
                qs, docs = np.nonzero((score >= np.maximum(kth, floor)[:, None]) & (score > 0))
                keys = names.take(pa.array(start[block[docs // BLOCK]] + docs % BLOCK))
                some = pa.table({"q": qs, "key": keys, "score": score[qs, docs]})
                best = _kept(some if best is None else pa.concat_tables([best, some]), p.k)
                size = np.bincount(best.column("q").to_numpy(), minlength=n_q)
                full = size >= p.k
                floor[full] = best.column("score").to_numpy()[np.cumsum(size)[full] - 1]
        if best is not None:
            long = lambda x: pa.array(x, pa.int64())
            none = pa.nulls(best.num_rows, pa.int64())
            for b in pa.table({"q": long(p.ids[best.column("q").to_numpy()]), "key": best.column("key"), "score": best.column("score"), "postings": none, "read": none}).combine_chunks().to_batches():
                yield b
            yield pa.RecordBatch.from_pydict({"q": long(p.ids), "key": pa.nulls(n_q, best.column("key").type), "score": pa.nulls(n_q, pa.float64()), "postings": long(postings), "read": long(read)})

    return run


def _kept(rows: pa.Table, k: int) -> pa.Table:
    """The k best of each query, by query, score and key."""
    rows = rows.take(pa.compute.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start")).combine_chunks()
    q = rows.column("q").to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _placed(segment: int):
    """Adds each document's block and slot in a new segment, neighbours by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = (segment << PART) + (TaskContext.get().partitionId() << RUN), 0
        for b in batches:
            order = np.argsort(b.column("dl").to_numpy(zero_copy_only=False), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + done + rank // BLOCK, pa.int64()), pa.array(rank % BLOCK, pa.int32())], names=[*b.schema.names, "block2", "slot2"])
            done += -(-len(order) // BLOCK)

    return run
