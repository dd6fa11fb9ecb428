"""Connected components by alternating large-star and small-star, on edge tables only.

Edges run from the larger id to the smaller. Large-star hangs every larger neighbour of a node on the smallest id that the node
knows; small-star hangs a node and its smaller neighbours on the smallest of them. When a round changes nothing, the edges are a
forest of stars whose centres are the smallest ids. Minima are summed up before the shuffle, so a node with very many neighbours
is no task of its own, and each round is a written table, so a lost executor repeats no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each id in edges: the smallest id that it reaches. Self-edges, nulls and repeats do no harm; no edges, no rows."""
    u, v = F.greatest(a, b), F.least(a, b)
    now = cut(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.cast("long").alias("u"), v.cast("long").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        then = cut(_small(_large(now).distinct()).distinct())
        forget(now)
        now, was, mark = then, mark, _mark(then)
        if mark == was:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
