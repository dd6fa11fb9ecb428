"""Merkle manifest of a dataset: a tree over the rows of each group, a tree over the groups' roots, and a proof for every row.

A leaf is the SHA-256 of a row's columns, each as its UTF-8 length and value. Leaves of a group stand by key; every `fanout`
consecutive nodes become the hash of their hexadecimal digests, level by level, until one is left; the groups' roots, by group,
are reduced alike. A proof lists, level by level up to the dataset's root, the place of the node in its run and the other digests.

The tree is built by superblocks. Leaves are numbered by one range partitioning: places within a partition, and the sums of the
partitions before it. Numbers are bucketed by fanout^k, applyInPandas collapses k levels of one bucket, and the buckets' roots
are the leaves of the next reduction; so a group of any size is met in pieces of at most fanout^k nodes, and its proofs are those
of its bucket followed by those of the bucket's root.

Defined cases: a null value has a mark of its own, so it differs from an empty one; rows with a null group are a group of their
own and come first, rows with a null key come first in their group; rows that share a key stand by leaf, and equal rows in any
order; a text is hashed whole, whatever its length; a group of one row is its own root; an empty table has no rows; columns that
are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_codec import added
from .common import by_size, cut, forget, ready

#: Nodes of a bucket at most; digests are 32 bytes.
BUCKET, SIZE = 1024, 32


def leaf(*values: Column) -> Column:
    """The digest of a row: of each value its UTF-8 length, a colon and itself, or a hyphen for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def depth(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def numbered(df: DataFrame, order: Sequence[str], name: str = "at") -> DataFrame:
    """df with each row's place from 0 in the order of the named columns, nulls first; written once. No task holds more than a range of rows."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), pa.array(range(n, n + b.num_rows), pa.int64())], names=[*b.schema.names, "_part", name])
            n += b.num_rows

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ranged.mapInArrow(run, added(df, ["_part", name], [T.LongType(), T.LongType()])))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col(name)).alias(name))  # a row a partition


def _collapse(fanout: int, levels: int):
    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        nodes, m = list(p["hash"]), int(p["m"].iloc[0])
        proofs: list[list[bytes]] = [[] for _ in nodes]
        span = 1
        for _ in range(min(levels, depth(m, fanout))):
            above = []
            for lo in range(0, len(nodes), fanout):
                of = nodes[lo : lo + fanout]
                above.append(hashlib.sha256(b"".join(of).hex().encode()).digest())
                for j in range(len(of)):
                    step = bytes([j]) + b"".join(of[:j] + of[j + 1 :])
                    for below in proofs[(lo + j) * span : (lo + j + 1) * span]:
                        below.append(step)
            nodes, span = above, span * fanout
        n = len(p)
        return pd.DataFrame({"grp": [key[0]] * (n + 1), "bucket": [key[1]] * (n + 1), "idx": pd.array([*p["idx"], None], dtype="Int64"), "m": [m] * (n + 1), "hash": [*p["hash"], nodes[0]], "proof": [*proofs, []]})

    return run


def proofs(nodes: DataFrame, most: int, fanout: int = 2) -> DataFrame:
    """(grp, idx, root, proof) of each node (grp, idx, m, hash): m nodes of a group, numbered from 0; most: the largest m.

    proof: for each level one binary value, the node's place in its run (a byte) and the digests of the run's other nodes.
    """
    if most <= 1:
        return nodes.select("grp", "idx", F.col("hash").alias("root"), F.array().cast("array<binary>").alias("proof"))
    levels = max(1, next(k for k in range(BUCKET) if fanout ** (k + 1) > BUCKET))
    size = fanout**levels
    bucket = F.floor(F.col("idx") / size).cast("long").alias("bucket")
    done = cut(nodes.select("grp", bucket, "idx", "m", "hash").groupBy("grp", "bucket").applyInPandas(_collapse(fanout, levels), "grp long, bucket long, idx long, m long, hash binary, proof array<binary>"))
    roots = done.filter("idx IS NULL").select("grp", F.col("bucket").alias("idx"), F.ceil(F.col("m") / size).cast("long").alias("m"), "hash")
    above = proofs(roots, -(-most // size), fanout).select("grp", F.col("idx").alias("bucket"), "root", F.col("proof").alias("rest"))
    return done.filter("idx IS NOT NULL").join(by_size(above), ["grp", "bucket"]).select("grp", "idx", "root", F.concat("proof", "rest").alias("proof"))


def fold(digest: bytes, proof: Sequence[bytes]) -> bytes:
    """The root that a leaf's digest and its proof give."""
    for step in proof:
        at = 1 + SIZE * step[0]
        digest = hashlib.sha256((step[1:at] + digest + step[at:]).hex().encode()).digest()
    return digest


def folded(df: DataFrame, digest: str, proof: str, names: tuple[str, str] = ("again", "proof_sha256")) -> DataFrame:
    """df with the root that `digest` and `proof` give, and the hash of the proof's digests, both as hexadecimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = b.column(proof).to_pylist()
            again = [fold(d, s).hex() for d, s in zip(b.column(digest).to_pylist(), steps, strict=True)]
            text = [hashlib.sha256(b"".join(x[1:] for x in s).hex().encode()).hexdigest() for s in steps]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(again, pa.string()), pa.array(text, pa.string())], names=[*b.schema.names, *names])

    return df.mapInArrow(run, added(df, list(names), [T.StringType(), T.StringType()]))


def manifest(docs: DataFrame, columns: Sequence[str], group: str, key: str, fanout: int = 2, changed: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, proof_sha256, again) of each row: digests as hexadecimal text, proof as in proofs().

    columns: those that a leaf covers, in this order. proof_sha256: of the proof's digests as text. again: the root that the row's
    proof gives for its leaf with the columns of `changed` replaced, to see whether a change would be found; else the root itself.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("fanout is from 2 to 255")
    changed = changed or {}
    rows = docs.select(
        F.col(group).cast("string").alias("g"), F.col(key).alias("k"), leaf(*(F.col(c) for c in columns)).alias("leaf"), leaf(*(changed.get(c, F.col(c)) for c in columns)).alias("other"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    rows = rows.withColumns({"leaf": F.unhex("leaf"), "other": F.when(F.col("leaf") != F.col("other"), F.unhex("other"))})
    hashed = cut(rows)  # texts are read once
    placed = numbered(hashed, ["g", "k", "leaf", "salt"])
    groups = cut(numbered(placed.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m")), ["first"], "grp"))
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("m")).first()
    g = groups.withColumnRenamed("g", "g2")
    leaves = cut(placed.join(by_size(g), F.col("g").eqNullSafe(F.col("g2"))).select("grp", (F.col("at") - F.col("first")).alias("idx"), "m", "leaf", "other", "k"))
    forget(hashed)
    low = proofs(leaves.select("grp", "idx", "m", F.col("leaf").alias("hash")), most or 0, fanout)
    low = low if (most or 0) <= 1 else cut(low)
    tops = low.filter("idx = 0").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(n_groups).cast("long").alias("m"), F.col("root").alias("hash"))
    top = proofs(tops, n_groups, fanout).select(F.col("idx").alias("grp"), F.col("root").alias("all_root"), F.col("proof").alias("rest"))
    full = leaves.join(low, ["grp", "idx"]).join(by_size(top), "grp").select("k", "leaf", F.col("root").alias("sub"), "all_root", F.concat("proof", "rest").alias("proof"), F.coalesce("other", "leaf").alias("digest"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    told = folded(full, "digest", "proof").withColumns({"subroot": F.col("sub"), "root": F.col("all_root")})
    return told.select(F.col("k").alias(key), text("leaf"), text("subroot"), text("root"), "proof", "proof_sha256", "again")
