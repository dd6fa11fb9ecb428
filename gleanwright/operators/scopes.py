"""Filters over a hierarchy that widen until enough rows are there, before anything is cut.

A scope is a node of a tree, such as a supplier in a nation in a region. A query asks for rows of its own scope; if these are fewer
than it wants, for rows of the next scope above, and so on up to everything. The best of the rows in the narrowest scope that is
wide enough are given, so a good row from far away does not push out one from near.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import by_size, written

LIMIT = "spark.sql.cteRecursionRowLimit"


@contextmanager
def _unlimited(spark: SparkSession):
    old = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(LIMIT, old)


def closure(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance): every node with itself and all above it; nodes without a parent are tops. Written once.

    A node whose parent is not there ends there; a cycle is an error (Spark's limit of recursion levels)."""
    spark, view = nodes.sparkSession, f"nodes_{uuid.uuid4().hex}"
    nodes.filter(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("parent")).distinct().createOrReplaceTempView(view)
    try:
        with _unlimited(spark):
            return written(
                spark.sql(f"""WITH RECURSIVE up(node, ancestor, distance) AS (
                  SELECT node, node, 0 FROM {view}
                  UNION ALL SELECT up.node, n.parent, up.distance + 1 FROM up JOIN {view} n ON n.node = up.ancestor WHERE n.parent IS NOT NULL)
                SELECT node, ancestor, distance FROM up""")
            )
    finally:
        spark.catalog.dropTempView(view)


def widened(hits: DataFrame, scopes: DataFrame, above: DataFrame, k: int, query: str = "query_id", tie: str = "knowledge_id", score: str = "score") -> DataFrame:
    """(query, tie, score, level, reach, rank): the k best hits of each query in the narrowest scope that holds k of them.

    hits: (query, tie, score, node). scopes: (query, node), a node a query. above: closure of the nodes. level: how many steps above the
    query's node the smallest scope is that holds the hit too, null if none does; reach: the level that the query was widened to,
    null for everything.
    """
    asked = by_size(scopes.select(F.col(query).alias("_q"), F.col("node").alias("at"))).join(above.withColumnRenamed("node", "at"), "at")
    wide = asked.groupBy("_q").agg(F.collect_set(F.struct(F.col("distance").alias("level"), "ancestor")).alias("wide"))  # the scopes above one node
    ups = above.groupBy(F.col("node").alias("_node")).agg(F.collect_set("ancestor").alias("ups"))
    met = hits.join(by_size(wide), F.col(query) == F.col("_q"), "left").join(by_size(ups), F.col("node") == F.col("_node"), "left")
    level = F.array_min(F.transform(F.filter("wide", lambda a: F.array_contains("ups", a["ancestor"])), lambda a: a["level"]))
    met = met.select(query, tie, score, level.alias("level"))
    counts = met.filter("level IS NOT NULL").groupBy(query, "level").agg(F.count(F.lit(1)).alias("n"))
    upward = Window.partitionBy(query).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # a row a level
    enough = counts.withColumn("so_far", F.sum("n").over(upward)).filter(F.col("so_far") >= k).groupBy(query).agg(F.min("level").alias("reach"))
    kept = met.join(by_size(enough), query, "left").filter(F.col("reach").isNull() | (F.col("level") <= F.col("reach")))
    order = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query, tie, score, "level", "reach", "rank")
