"""Two levels of chunks: parents that are read, and children inside them that are searched.

A parent is a run of a text's tokens, and its children are overlapping windows of the parent's tokens, so no child crosses its
parent's border. A search finds children; each parent is given once, with the child that found it best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .chunking import check_sizes, chunk_id, windows

PARENT, CHILD, OVERLAP = 1400, 650, 100


def parents_and_children(records: DataFrame, key: str = "knowledge_id", text: str = "content", parent: int = PARENT, child: int = CHILD, overlap: int = OVERLAP) -> DataFrame:
    """(key, parent_id, child_id, parent_start, parent_end, child_start, child_end, content): a row for each child, ends exclusive, in tokens of the text.

    A text without words has none; one shorter than a child is a parent with one child.
    """
    check_sizes(child, overlap, child, 0)
    if not child <= parent:
        raise ValueError(f"a child of {child} tokens does not fit into a parent of {parent}")
    tk = records.select(key, words(text).alias("tk")).filter(F.size("tk") > 0)
    p = tk.select(key, F.posexplode(windows(F.col("tk"), parent, 0)).alias("parent", "p")).select(key, "parent", F.col("p.start").alias("parent_start"), F.col("p.tokens").alias("own"))
    c = p.select(key, "parent", "parent_start", F.size("own").alias("n"), F.posexplode(windows(F.col("own"), child, overlap)).alias("child", "c"))
    start = F.col("parent_start") + F.col("c.start")
    name = chunk_id(key, "parent")
    return c.select(
        key, name.alias("parent_id"), F.format_string("%s.%02d", name, "child").alias("child_id"), "parent_start", (F.col("parent_start") + F.col("n")).alias("parent_end"), start.alias("child_start"),
        (start + F.size("c.tokens")).alias("child_end"), F.array_join("c.tokens", " ").alias("content"),
    )


def best_parents(hits: DataFrame, children: DataFrame, k: int, query: str = "query_id", score: str = "score") -> DataFrame:
    """(query, parent_id, child_id, score, spans, n_children, rank): the k best parents of hits (query, child_id, score), each with its best child.

    n_children: how many children of the parent were hit. Ties go to the smaller id. The hits are met with the children's spans, not their texts."""
    spans = children.select("child_id", "parent_id", "parent_start", "parent_end", "child_start", "child_end")
    best = F.struct((-F.col(score)).alias("low"), "child_id", "parent_start", "parent_end", "child_start", "child_end")
    one = hits.select(query, "child_id", score).join(spans, "child_id").groupBy(query, "parent_id").agg(F.min(best).alias("b"), F.count(F.lit(1)).alias("n_children"))
    told = one.select(query, "parent_id", "b.child_id", (-F.col("b.low")).alias(score), "b.parent_start", "b.parent_end", "b.child_start", "b.child_end", "n_children")
    order = Window.partitionBy(query).orderBy(F.desc(score), "parent_id")
    return told.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
