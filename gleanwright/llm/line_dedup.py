"""Removal of lines that repeat an earlier line, exactly or within one edit, by a deletion-neighbourhood join.

A line is compared without outer spaces; blank lines, and lines under min_chars characters (0 if not given), are left alone. The
earliest place of a line, by doc_id and line number, stays; every other place goes. Rows that share a doc_id but not their text
have places of their own, by a hash of the text after the line number. A line also goes if some earlier line is one edit away
(one character inserted, deleted or replaced), whether or not that line itself stays. One edit is the contract; with edits=0 only
exact repeats go.

Two lines are one edit apart if and only if they agree outside a window of one character of the longer one. So a line of n
characters emits, as hashed keys, what is left of it without each window, for itself as the longer line (length n) and as the
shorter one (length n + 1). Lines that share a key are verified by their edit distance, and the smallest place of a key is kept.
To emit few keys the windows shrink in steps: halves for all distinct lines, SEGMENTS parts for lines that share a half with
another line, single characters for lines that share all but such a part. Each step only leaves out lines that no line can be
near to. Keys meet by grouping with sums before the shuffle and are never paired with one another, so a key that very many lines
share costs one row a line. Lines travel as hashes and places; only the text of lines that may be near another is fetched again.

Defined cases: a null text stays null; rows with a null doc_id stay as they are and are compared with nothing; rows that share
doc_id and text are one document, and all of them keep what one keeps; blank lines stay; a very long line or text is taken whole;
an empty table stays empty; other columns pass unchanged, and n_removed gets an underscore in front if that name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytebpe
from .common import by_size, cut, few, forget, fresh, ready

SEGMENTS, CHARACTERS = 8, 0
U64 = np.uint64
MOST_KEYS = 200_000


def window_keys(line: str, parts: int) -> np.ndarray:
    """Hashes of a line without each of `parts` windows (CHARACTERS: of one character each), as the longer and as the shorter line."""
    code = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(U64)
    n = len(code)
    at = np.arange(n)
    ahead, behind = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
    np.cumsum(bytebpe.drawn(at, code, 21), out=ahead[1:])
    np.cumsum(bytebpe.drawn(at + (1 << 42), code[::-1], 21), out=behind[1:])
    out = []
    for size in (n, n + 1):
        m = min(parts, size) if parts else size
        j = np.arange(m)
        head, tail = j * size // m, size - (j + 1) * size // m
        out.append(bytebpe.mixed(ahead[head] + behind[tail] + (U64(size) << U64(32)) + j.astype(U64)))
    return np.concatenate(out).view(np.int64)


def _keys(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, at, size = [], [], 0
            for i, line in enumerate(b.column("line").to_pylist()):
                k = window_keys(line, parts)
                got.append(k)
                at.append(np.full(len(k), i))
                size += len(k)
                if size >= MOST_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), b.column("place").take(pa.array(np.concatenate(at)))], names=["key", "place"])
                    got, at, size = [], [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), b.column("place").take(pa.array(np.concatenate(at)))], names=["key", "place"])

    return run


def _halves(line: Column, n: Column) -> Column:
    """window_keys of two parts, in SQL functions, for the many lines that share no half with another."""
    keys = []
    for size in (n, n + 1):
        half = F.floor(size / 2).cast("int")
        keys += [F.xxhash64(size, F.lit(0), F.substring(line, -(size - half), size - half)), F.xxhash64(size, F.lit(1), F.substring(line, F.lit(1), half))]
    return F.array(*keys)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each line that takes part: its document, number, place in the order of all lines, trimmed text, and two hashes of that."""
    out = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "fp", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = out.withColumn("line", F.trim("line")).filter(F.length("line") >= max(1, min_chars))
    tie = F.shiftrightunsigned("fp", 32)
    place = (F.col("doc_id").cast("decimal(38,0)") * F.lit(Decimal(1 << 63)) + (F.col("pos").cast("long") * F.lit(1 << 32) + tie)).cast("decimal(38,0)")
    return out.select("doc_id", "fp", "pos", "line", place.alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _edited(docs: DataFrame, distinct: DataFrame, min_chars: int) -> DataFrame:
    """Hashes (h1, h2) of distinct lines that have an earlier line one edit away."""
    # lines that share a half, then all but an eighth, then all but a character
    keyed = distinct.select("h1", F.explode(F.array(*(f"k{k}" for k in range(4)))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    near = keyed.join(shared, "key", "left_semi").select("h1").distinct()
    some = cut(distinct.join(near, "h1", "left_semi").select("h1", "h2", "place"))
    text = cut(_lines(docs, min_chars).join(by_size(some), ["h1", "h2", "place"], "left_semi").select("place", "line").distinct())
    keyed = cut(text.mapInArrow(_keys(SEGMENTS), "key long, place decimal(38,0)"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    near = keyed.join(shared, "key", "left_semi").select("place").distinct()
    close = cut(text.join(near, "place", "left_semi"))
    forget(some, text, keyed)
    keyed = cut(close.mapInArrow(_keys(CHARACTERS), "key long, place decimal(38,0)"))
    shared = keyed.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("key", "first")
    pairs = keyed.join(shared, "key").filter("first < place").select("place", "first").distinct()
    pairs = pairs.join(close, "place").join(close.select(F.col("place").alias("first"), F.col("line").alias("other")), "first")
    edited = cut(pairs.filter(F.levenshtein("line", "other", 1) >= 0).select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).distinct())
    forget(close, keyed)
    return edited


def repeated_lines(docs: DataFrame, min_chars: int = 0, edits: int = 1) -> DataFrame:
    """(doc_id, fp, pos) of the lines of docs (doc_id, fp, text) that repeat an earlier one."""
    if edits not in (0, 1):
        raise ValueError("lines are compared within 0 or 1 edits")
    ready(docs.sparkSession)
    n, halves = F.length("line"), [f"k{k}" for k in range(4)] if edits else []
    keys = _halves(F.col("line"), n)
    lines = cut(_lines(docs, min_chars).select("doc_id", "fp", "pos", "place", "h1", "h2", *(keys[int(k[1])].alias(k) for k in halves)))
    distinct = cut(lines.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), *(F.min(k).alias(k) for k in halves)))
    first = cut(distinct.filter("n > 1").select("h1", "h2", F.col("place").alias("first")))
    again = lines.join(by_size(first), ["h1", "h2"]).filter("place <> first").select("doc_id", "fp", "pos")
    if edits:
        edited = _edited(docs, distinct, min_chars)
        again = again.unionByName(lines.join(by_size(edited), ["h1", "h2"], "left_semi").select("doc_id", "fp", "pos"))  # wherever the line stands
    out = cut(again.distinct())
    forget(lines, distinct, first, *([edited] if edits else []))
    return out


def remove_repeated_lines(docs: DataFrame, removed: str = "n_removed", min_chars: int = 0, edits: int = 1) -> DataFrame:
    """docs with their repeated lines taken out of `text`, and the number of lines taken from each."""
    fp, at, at_id, at_fp, lines, removed = (fresh(x, docs.columns) for x in ("fp", "at", "at_id", "at_fp", "lines", removed))
    marked = docs.withColumn(fp, F.xxhash64("text"))
    gone = repeated_lines(marked.select("doc_id", F.col(fp).alias("fp"), "text"), min_chars, edits)
    small = few(gone)
    gone = gone.groupBy(F.col("doc_id").alias(at_id), F.col("fp").alias(at_fp)).agg(F.collect_set("pos").alias(at))
    # texts pass the join as lines, so that each line is then taken by its number in constant time
    split = marked.withColumn(lines, F.split("text", "\n")).drop("text")
    out = split.join(F.broadcast(gone) if small else gone, (F.col("doc_id") == F.col(at_id)) & (F.col(fp) == F.col(at_fp)), "left")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at), lambda i: F.get(lines, i))
    text = F.array_join(F.when(F.col(at).isNull(), F.col(lines)).otherwise(stay), "\n")
    n = F.when(F.col(at).isNull(), F.lit(0)).otherwise(F.size(at)).cast("long")
    return out.withColumns({"text": text, removed: n}).select(*docs.columns, removed)


def clean(docs: DataFrame, min_chars: int = 0, edits: int = 1) -> DataFrame:
    """docs with repeated lines taken out and n_chars, if there, set anew; documents of which nothing but blanks is left go."""
    n = fresh("n_removed", docs.columns)
    out = remove_repeated_lines(docs, n, min_chars, edits).filter((F.col(n) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
