"""Which strings hold which others, by an index of q-grams instead of a loop over all pairs.

A pattern of at least Q characters is held only by texts that have all its grams of Q characters, so it waits under the one that
fewest texts have; a shorter pattern waits under itself. Texts are looked up by all their grams, and what meets is checked. Texts
and patterns are names and labels: distinct strings, each short enough to be cut into its grams in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_size

Q = 3


def grams(s: Column, q: Column) -> Column:
    """The distinct runs of q characters in s; none if it is shorter."""
    n = F.length(s) - q + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, q)))).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): the distinct strings of the first columns, where the text has the pattern inside, or is it. Nulls and empty patterns meet nothing."""
    t = texts.select(F.col(texts.columns[0]).alias("text")).filter(F.length("text") > 0).distinct()
    p = patterns.select(F.col(patterns.columns[0]).alias("pattern")).filter(F.length("pattern") > 0).distinct()
    waiting = p.select("pattern", F.explode(grams(F.col("pattern"), F.least(F.length("pattern"), F.lit(Q)))).alias("gram"))
    looked = t.select("text", F.explode(F.concat(*(grams(F.col("text"), F.lit(q)) for q in range(1, Q + 1)))).alias("gram"))
    looked = looked.join(by_size(waiting.select("gram").distinct()), "gram", "left_semi")
    often = looked.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = waiting.join(often, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.max(F.col("n").isNull()).alias("absent"))
    key = rarest.filter("NOT absent").select("pattern", "gram")
    return looked.join(by_size(key), "gram").filter(F.contains("text", "pattern")).select("text", "pattern")
